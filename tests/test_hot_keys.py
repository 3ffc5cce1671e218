"""Cutting a key into blocks must not change any result."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions.ordered import index_block, running, count_rows, previous, following, Running, split_if_hot, time_block
from threadloom.operators import batching, context, events, messages, spans, steps
from threadloom.sources.tables import event_log_from_table, messages_from_turns, read_table

D = "/root/testdata/sf0.001"


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def turns(spark):
    return read_table(spark, D, "conversations").withColumn("marked", F.col("turn") % 3 == 2)


@pytest.fixture(scope="module")
def log(spark):
    """All events of one agent, so the agent is far above the limit."""
    e = event_log_from_table(read_table(spark, D, "events")).limit(400)
    return e.withColumn("agent_id", F.when(F.col("event_id") % 4 == 0, F.col("agent_id")).otherwise(F.lit(1))).withColumn("model", F.col("event_id") % 2).persist()


def kind(name):
    return F.col("event_type") == name


def by_time():
    return time_block(F.col("ts"), 7200)


def test_split_is_decided_by_the_largest_key(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "k int, i int")
    assert split_if_hot(df, ["k"], F.col("i"), 5) is None
    assert split_if_hot(df, ["k"], F.col("i"), 4) is not None


@pytest.mark.parametrize("size", [1, 2, 7])
def test_running_kinds(spark, size):
    rows = [(k, i, None if (i * 7 + (k or 0)) % 3 == 0 else (i * 5) % 11) for k in (1, 2, None) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    columns = {
        "n": count_rows(), "back": count_rows(inclusive=False, reverse=True), "s": Running("sum", F.col("v")),
        "lo": Running("min", F.col("v")), "hi": Running("max", F.col("v"), inclusive=False), "prev": previous(F.struct("v")),
        "nxt": following(F.col("v")), "last": Running("last", F.col("v")),
    }
    same(running(df, ["k"], ["i"], None, **columns), running(df, ["k"], ["i"], index_block(F.col("i"), size), **columns))


def test_context(turns):
    same(context.merge_runs(turns), context.merge_runs(turns, rows_per_task=2))
    same(context.compact_history(turns, 1), context.compact_history(turns, 1, rows_per_task=2))
    same(context.cap_markers(turns), context.cap_markers(turns, rows_per_task=2))


def test_messages(turns):
    m = messages_from_turns(turns)
    cursors = m.groupBy("channel_id", F.col("sender").alias("reader")).agg(F.count(F.lit(1)).alias("last_index"))
    same(messages.unread(m, cursors), messages.unread(m, cursors, rows_per_task=2))
    q = m.withColumn("recipient", F.lit("r")).withColumn("seq", F.col("channel_id") * 100 + F.col("seq")).withColumn("priority", F.col("sender") == "user")
    same(messages.queue_order(q), messages.queue_order(q, rows_per_task=10))
    is_marker = F.col("sender") == "system"
    same(messages.marker_batches(q, is_marker, max_size=4), messages.marker_batches(q, is_marker, max_size=4, rows_per_task=10))
    people = m.select(F.col("sender").alias("klass"), (F.col("channel_id") * 100 + F.col("seq")).alias("agent_id"))
    same(messages.group_agents(people), messages.group_agents(people, rows_per_task=10))


def test_events(log):
    args = dict(block=by_time(), rows_per_task=10)
    same(events.pair_start_end(log, ["agent_id"], kind("view"), kind("purchase")),
         events.pair_start_end(log, ["agent_id"], kind("view"), kind("purchase"), **args))
    same(events.call_depth(log, kind("click"), kind("error")), events.call_depth(log, kind("click"), kind("error"), **args))
    same(events.number_calls(log, kind("view")), events.number_calls(log, kind("view"), **args))
    flags = (kind("view"), kind("purchase"), "model", kind("click"), kind("error"), kind("signup"))
    same(events.attribute_parents(log, *flags), events.attribute_parents(log, *flags, **args))
    invites, answers = log.filter(kind("view")), log.filter(kind("click")).withColumn("accepted", F.lit(True))
    same(events.await_responses(invites, answers, ["agent_id"], 9000), events.await_responses(invites, answers, ["agent_id"], 9000, **args))
    same(events.error_report(log, kind="event_type"), events.error_report(log, kind="event_type", rows_per_task=2))


def test_batches_spans_steps(spark, log):
    args = ("agent_id", ["ts", "event_id"], kind("signup"), 3600, 9000)
    same(batching.rolling_batches(log, *args), batching.rolling_batches(log, *args, block=by_time(), rows_per_task=10))
    sp = log.select(F.col("event_id").alias("span_id"), F.col("agent_id").alias("trace_id"), F.col("ts").alias("start"), F.col("ts").alias("created"))
    same(spans.chronological(sp, "start", "created"), spans.chronological(sp, "start", "created", rows_per_task=10))
    numbers = spark.createDataFrame([("d", n) for n in ("01", "01.01", "01.02", "01.02.01", "02", "10", "02.01")], "doc_id string, step_no string")
    same(steps.dense_steps(numbers), steps.dense_steps(numbers, rows_per_task=2))


def test_exact_quantiles_from_brackets(spark):
    """A key with ten times as many values as another, many of them equal, and keys with few or no values."""
    log = spark.range(330_000).selectExpr(
        "if(id % 11 = 0, 'rare', 'hot') AS k", "if(id % 3 = 0, 7.0D, pmod(xxhash64(id), 1000003) / 7D) AS v", "timestamp_seconds(id) AS ts")
    few = spark.sql("SELECT * FROM VALUES ('one', 3.0D, timestamp'2024-01-01'), ('none', NULL, timestamp'2024-01-01'), (NULL, 1.0D, timestamp'2024-01-01') AS t(k, v, ts)")
    log = log.unionAll(few)
    same(events.latency_stats(log, "k", "v", small_key=1_000_000), events.latency_stats(log, "k", "v", small_key=20_000))
    got = {r.k: r for r in events.latency_stats(log, "k", "v").collect()}
    values = sorted(r.v for r in log.filter("k = 'hot'").collect())
    n = len(values)
    j, d = 99 * (n + 1) // 100, 99 * (n + 1) % 100
    assert got["hot"].p99_latency == round((values[j - 1] * (100 - d) + values[j] * d) / 100, 6)
    assert got["hot"].p50_latency == round((values[(n + 1) // 2 - 1] + values[n // 2]) / 2, 6)
    assert (got["one"].p50_latency, got["one"].p99_latency, got["none"].p50_latency, set(got)) == (3.0, 3.0, None, {"hot", "rare", "one", "none"})
