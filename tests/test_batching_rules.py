import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.operators import batching
from threadloom.streaming import batches, live

T0 = dt.datetime(2024, 1, 1)


def messages(spark, offsets, senders=None):
    rows = [("r", i, T0 + dt.timedelta(seconds=s), (senders or {}).get(i, "agent")) for i, s in enumerate(offsets)]
    return spark.createDataFrame(rows, "recipient string, id long, ts timestamp, sender string")


def sizes(spark, offsets, gap, wait, senders=None):
    df = batching.rolling_batches(messages(spark, offsets, senders), "recipient", ["ts", "id"], F.col("sender") == "human", gap, wait)
    out = df.groupBy("segment", "batch").agg(F.min("id").alias("i"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    return [r.n for r in out]


def test_close_messages_are_one_batch(spark):
    assert sizes(spark, [i * 0.05 for i in range(5)], 0.2, 10) == [5]


def test_quiet_time_closes(spark):
    assert sizes(spark, [0, 0.1, 1.0, 1.1], 0.2, 10) == [2, 2]


def test_long_flow_is_bounded(spark):
    got = sizes(spark, [i * 0.08 for i in range(6)], 0.1, 0.3)
    assert 3 <= got[0] <= 5 and sum(got) == 6


def test_urgent_message_closes_at_once_and_is_included(spark):
    assert sizes(spark, [0, 0.05, 0.1, 0.15], 0.5, 2, {1: "human"}) == [2, 2]


def test_message_past_the_wait_closes(spark):
    # the timer (gap 5) would end at 5, the message at 4 is past max_wait 3
    assert sizes(spark, [0, 4, 4.5], 5, 3) == [2, 1]


@pytest.mark.parametrize("files", [1, 3])
def test_live_equals_stored(spark, tmp_path, files):
    import random

    rng = random.Random(files)
    at, rows = 0.0, []
    for i in range(120):
        at += rng.choice([0.05, 0.2, 0.6, 3.0])
        rows.append((f"r{i % 3}", i, T0 + dt.timedelta(seconds=at), rng.choice(["agent"] * 6 + ["human"])))
    end = [("end", 999, T0 + dt.timedelta(hours=5), "agent")]
    schema = "recipient string, id long, ts timestamp, sender string"
    cuts = [rows[i::files] if files == 1 else rows[i * 40:(i + 1) * 40] for i in range(files)]
    for i, part in enumerate([*cuts, end]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    human = F.col("sender") == "human"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = live.run_available(batches.rolling_batches_live(stream, "recipient", "ts", "id", human, 0.5, 2.0, "1 minute"), "t")
    stored = batching.rolling_batches(spark.createDataFrame(rows, schema), "recipient", ["ts", "id"], human, 0.5, 2.0)
    want = stored.groupBy("recipient", "segment", "batch").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    a = sorted((r.key, tuple(int(i) for i in r.ids)) for r in got.collect())
    b = sorted((r.recipient, tuple(r.ids)) for r in want.collect())
    assert a == b


def test_streams_need_a_start(spark):
    rows = [(1, 0, "start", None), (1, 1, "chunk", "a"), (1, 2, "chunk", "b"), (1, 3, "complete", None), (1, 4, "chunk", "late"),
            (2, 0, "chunk", "x"), (2, 1, "complete", None), (3, 0, "start", None), (3, 1, "chunk", "open")]
    good, errors = batching.assemble_streams(spark.createDataFrame(rows, "stream_id int, seq long, kind string, chunk string"), rows_per_block=2)
    assert [(r.stream_id, r.text, r.chunks) for r in good.collect()] == [(1, "ab", 2)]
    assert sorted((r.stream_id, r.seq, r.error) for r in errors.collect()) == [
        (1, 4, "already completed"), (2, 0, "no start"), (2, 1, "no start")]


def test_live_responses_and_durations(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    spark.createDataFrame([("a", at(0)), ("b", at(5)), ("c", at(9)), ("end", at(9999))], "invite string, ts timestamp").write.parquet(f"{tmp_path}/i")
    spark.createDataFrame([("a", at(10), True), ("b", at(6), False), ("c", at(100), True), ("end", at(9999), True)], "invite string, ts timestamp, accepted boolean").write.parquet(f"{tmp_path}/r")
    read = lambda n, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}")
    invites, responses = read("i", "invite string, ts timestamp"), read("r", "invite string, ts timestamp, accepted boolean")
    out = live.run_available(live.await_responses_live(invites, responses, "invite"), "resp")
    got = {r.invite: r.status for r in out.collect()}
    assert got == {"a": "accepted", "b": "rejected", "c": "timeout", "end": "accepted"}
    starts = invites.withWatermark("ts", "10 seconds")
    ends = responses.select("invite", F.col("ts").alias("end_ts")).withWatermark("end_ts", "10 seconds")
    spans = live.run_available(batching.span_durations(starts, ends, "invite", "30 seconds"), "dur")
    assert {r.invite: r.duration_us for r in spans.collect()} == {"a": 10_000_000, "b": 1_000_000, "end": 0}
