"""Event-log analytics: pairing, depth, parents by time, numbering, usage, latency, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.ordered import (
    ROWS_PER_TASK, Running, count_rows, following, running, settle, split_if_hot, stack_depth, time_block,
)
from threadloom.functions.skew import salted_join

ORDER = ["ts", "event_id"]

# Names of the recency spans and their length in days (None = no limit).
RECENCY_DAYS = {"all": None, "1d": 1, "7d": 7, "30d": 30, "1m": 30, "90d": 90, "3m": 90, "180d": 180, "360d": 360}


def recent(df: DataFrame, span: str, reference: Column, ts: str = "ts") -> DataFrame:
    """Rows not older than a named span before ``reference``."""
    days = RECENCY_DAYS[span]
    return df if days is None else df.filter(F.col(ts) >= reference - F.make_dt_interval(days=F.lit(days)))


def _block(events, keys, block, rows_per_task):
    return split_if_hot(events, keys, time_block(F.col("ts")) if block is None else block, rows_per_task)


def pair_start_end(
    events: DataFrame, keys: list[str], is_start: Column, is_end: Column,
    block: Column | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every start with the first later end of the same keys; an end closes all open starts.

    Starts without a later end stay open (null ``end_id``).
    """
    block = _block(events, keys, block, rows_per_task)
    end = F.when(is_end, F.struct(*ORDER))
    paired = running(events, keys, ORDER, block, _end=following(end))
    return paired.filter(is_start).select(
        *events.columns,
        F.col("_end.event_id").alias("end_id"), F.col("_end.ts").alias("end_ts"),
        (F.unix_micros("_end.ts") - F.unix_micros("ts")).alias("duration_us"),
    )


def call_depth(
    events: DataFrame, is_push: Column, is_pop: Column, key: str = "agent_id",
    block: Column | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Stack depth at each event, and for each push the pop that closes it (last in, first out).

    A pop on an empty stack is ignored and gets lane 0.  Inside a lane (one stack level of an agent)
    pushes and pops alternate, so the next event of the lane is the matching pop.
    """
    block = _block(events, [key], block, rows_per_task)
    step = F.when(is_push, 1).when(is_pop, -1).otherwise(0)
    deep = stack_depth(events, [key], ORDER, block, step)
    moves = deep.withColumn("lane", F.greatest("depth_before", "depth_after"))
    paired = running(
        settle(moves.filter(is_push | is_pop), block), [key, "lane"], ORDER, block, _next=following(F.col("event_id")),
    )
    return paired.withColumn(
        "closed_by", F.when(is_push, F.col("_next"))
    ).drop("_next")


def attribute_parents(
    events: DataFrame, is_call: Column, is_call_end: Column, model: str, is_push: Column, is_pop: Column, is_root: Column,
    key: str = "agent_id", block: Column | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Parent of each event: the current open call, else the innermost open frame, else the agent's root event.

    The current call is the last one started; it is open until the next end of its model.
    """
    block = _block(events, [key], block, rows_per_task)
    flags = events.withColumns({
        "_call": is_call, "_call_end": is_call_end, "_push": is_push, "_pop": is_pop, "_root": is_root,
    })
    ends = running(
        flags, [key, model], ORDER, block, _closed=following(F.when(F.col("_call_end"), F.struct(*ORDER))),
    )
    call = F.when(F.col("_call"), F.struct("event_id", "_closed"))
    seen = running(
        settle(ends, block), [key], ORDER, block,
        _current=Running("last", call, inclusive=False),
        _root_id=Running("last", F.when(F.col("_root"), F.col("event_id")), inclusive=False),
    )
    still_open = F.col("_current._closed").isNull() | (F.col("_current._closed") >= F.struct(*ORDER))
    seen = seen.withColumn("_open_call", F.when(still_open, F.col("_current.event_id")))
    deep = stack_depth(settle(seen, block), [key], ORDER, block, F.when(F.col("_push"), 1).when(F.col("_pop"), -1).otherwise(0))
    # one row asks for the top of the stack it sees, a push also offers itself as top of its level
    roles = F.explode(F.array_compact(F.array(
        F.struct(F.col("depth_before").alias("lane"), F.lit(True).alias("asks")),
        F.when(F.col("_push"), F.struct(F.col("depth_after").alias("lane"), F.lit(False).alias("asks"))),
    )))
    lanes = deep.withColumn("_r", roles).withColumns({"_lane": F.col("_r.lane"), "_asks": F.col("_r.asks")})
    offered = F.when(~F.col("_asks"), F.col("event_id"))
    topped = running(
        settle(lanes, block), [key, "_lane"], ORDER, block, _frame=Running("last", offered, inclusive=False),
    ).filter(F.col("_asks"))
    frame = F.when(F.col("_lane") > 0, F.col("_frame"))
    return topped.select(
        *events.columns, F.coalesce("_open_call", frame, "_root_id").alias("parent_id"),
    )


def number_calls(
    events: DataFrame, is_call: Column, key: str = "agent_id", block: Column | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sequence number of each call per agent."""
    calls = events.filter(is_call)
    return running(calls, [key], ORDER, _block(calls, [key], block, rows_per_task), call_number=count_rows())


def relative_time(events: DataFrame, granularity: int, key: str = "agent_id") -> DataFrame:
    """Integer time since the first event of a session, in units of 10^-granularity seconds."""
    if not -3 <= granularity <= 6:
        raise ValueError("granularity must be between -3 and 6")
    starts = events.groupBy(key).agg(F.unix_micros(F.min("ts")).alias("_start"))
    elapsed = F.unix_micros("ts") - F.col("_start")
    return events.join(starts, key).withColumn(
        "relative", F.floor(elapsed / F.lit(10 ** (6 - granularity))).cast("bigint")
    ).drop("_start")


def usage_by_model(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, cache hits and errors per agent and model."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        flag("cache_hit").alias("cache_hits"), flag("is_error").alias("errors"),
    )


#: Error of the rank sketch as a share of the rows is 1 / RANK_ACCURACY; a bracket reaches BRACKET to both sides of a rank.
RANK_ACCURACY = 100_000
BRACKET = 1e-4
#: A key with at most so many values is ranked as a whole.
SMALL_KEY = 50_000


def latency_stats(
    calls: DataFrame, key: str, latency: str, ts: str = "ts", is_error: str | None = None, small_key: int = SMALL_KEY,
) -> DataFrame:
    """min, max, mean, p50, p99, throughput and errors per key; both quantiles are exact.

    p99 is the exclusive quantile above 100 values, else the maximum.  The first read gives totals and, from a rank
    sketch of fixed size, a bracket of values around each rank.  The second one counts what is below a bracket and the
    values inside it, some 0.02 % of the rows, and only those are ranked.  Null latencies do not count; a key without any
    has no quantiles, and a null key is none.
    """
    value = F.col(latency)
    calls = calls.filter(F.col(key).isNotNull())
    span = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
    edges = [0.5 - BRACKET, 0.5 + BRACKET, 0.99 - BRACKET, 0.99 + BRACKET]
    totals = calls.groupBy(key).agg(
        F.count(latency).alias("n"), F.min(latency).alias("min_latency"), F.max(latency).alias("max_latency"),
        F.round(F.sum(value.cast("decimal(38,6)")).cast("double") / F.count(latency), 6).alias("avg_latency"),
        F.when(span > 0, F.round(F.count(F.lit(1)) * 1e6 / span, 6)).otherwise(F.lit(0.0)).alias("throughput"),
        (F.count_if(F.col(is_error)) if is_error else F.lit(0).cast("bigint")).alias("errors"),
        F.percentile_approx(latency, edges, RANK_ACCURACY).alias("_edges"),
    )
    n = F.col("n")
    # four ranks: the two in the middle, and the two around the 99th hundredth
    hundredths = (n + 1) * 99
    j = F.floor(hundredths / 100)
    ranks = totals.select(
        F.col(key).alias("_key"), F.when(n > small_key, F.col("_edges")).alias("_edges"),
        F.floor((n + 1) / 2).alias("_m1"), (F.floor(n / 2) + 1).alias("_m2"), F.least(j, n).alias("_q1"), F.least(j + 1, n).alias("_q2"))
    near = salted_join(calls.filter(value.isNotNull()).select(F.col(key).alias("_key"), value.alias("_v")), ranks, ["_key"], merge=False)
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_edges")[2 * i].alias("low"), F.col("_edges")[2 * i + 1].alias("high")) for i in (0, 1)])
    near = near.select("_key", "_v", "_m1", "_m2", "_q1", "_q2", F.inline(sides)).filter(F.col("high").isNull() | (F.col("_v") <= F.col("high")))
    inside = F.when(F.col("low").isNull() | (F.col("_v") >= F.col("low")), F.col("_v"))  # null: below the bracket
    held = near.groupBy("_key", "i", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m1").alias("_m1"), F.min("_m2").alias("_m2"), F.min("_q1").alias("_q1"), F.min("_q2").alias("_q2"))
    to = F.sum("_n").over(W.partitionBy("_key", "i").orderBy(F.col("_v").asc_nulls_first()))
    held = held.withColumn("_to", to)
    at = lambda i, rank: F.max(F.when((F.col("i") == i) & (F.col("_to") - F.col("_n") < F.col(rank)) & (F.col(rank) <= F.col("_to")), F.col("_v")))
    found = held.groupBy("_key").agg(at(0, "_m1").alias("_a1"), at(0, "_m2").alias("_a2"), at(1, "_q1").alias("_b1"), at(1, "_q2").alias("_b2"))
    joined = totals.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    delta = hundredths - j * 100
    p99 = F.when(n > 100, (F.col("_b1") * (F.lit(100) - delta) + F.col("_b2") * delta) / 100).otherwise(F.col("max_latency"))
    whole = (n == 0) | F.col("_a1").isNotNull() & F.col("_a2").isNotNull() & F.col("_b1").isNotNull() & F.col("_b2").isNotNull()
    exact = lambda c: F.when(whole, c).otherwise(F.raise_error(F.lit("a rank lies outside of its bracket")))
    return joined.select(
        key, "n", "min_latency", "max_latency", "avg_latency",
        exact(F.round((F.col("_a1") + F.col("_a2")) / 2, 6)).alias("p50_latency"), exact(F.round(p99, 6)).alias("p99_latency"),
        "throughput", "errors",
    )


def run_summary(steps: DataFrame, entity: str = "entity") -> DataFrame:
    """Totals per entity of its pipeline steps; an entity is complete when every step completed."""
    return steps.groupBy(entity).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.bool_and(F.col("status") == "completed").alias("is_complete"),
    )


def error_report(
    errors: DataFrame, key: str = "agent_id", kind: str = "error_type", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Errors per agent and type, most frequent first, with the agent's total."""
    counts = errors.groupBy(key, kind).agg(F.count(F.lit(1)).alias("errors"))
    counts = counts.withColumn("_rank", -F.col("errors"))
    block = split_if_hot(counts, [key], F.col("_rank"), rows_per_task)
    return running(
        counts, [key], ["_rank", kind], block,
        position=count_rows(), _before=Running("sum", F.col("errors")),
        _after=Running("sum", F.col("errors"), inclusive=False, reverse=True),
    ).select(key, kind, "errors", "position", (F.col("_before") + F.col("_after")).alias("agent_errors"))


def health(agents: DataFrame, errors: DataFrame, key: str = "agent_id") -> DataFrame:
    """Every agent with its number of errors and whether it is healthy."""
    counts = errors.groupBy(key).agg(F.count(F.lit(1)).alias("errors"))
    joined = agents.join(counts, key, "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return joined.withColumn("is_healthy", F.col("errors") == 0)


def throughput(events: DataFrame, width: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Events per time window and type; also valid on a stream once a watermark is set."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "events")


def listen_windows(messages: DataFrame, is_targeted: Column, key: str = "recipient", ts: str = "ts") -> DataFrame:
    """Batches a reader would take: a targeted reader waits 0.5 seconds, a passive one 5 seconds."""
    gap = F.when(is_targeted, F.lit("0.5 seconds")).otherwise(F.lit("5 seconds"))
    return messages.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("messages")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "messages"
    )


def await_responses(
    invites: DataFrame, responses: DataFrame, keys: list[str], timeout_seconds: int = 30,
    block: Column | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Status per invite from its first response inside the time limit: accepted, rejected or timeout.

    The first response is the nearest one in time, so invites and responses are put in one order
    instead of being joined pair by pair.
    """
    both = invites.select(*keys, *ORDER, F.lit(0).alias("_side"), F.lit(None).cast("boolean").alias("accepted")).unionByName(
        responses.select(*keys, *ORDER, F.lit(1).alias("_side"), "accepted")
    )
    answer = F.when(F.col("_side") == 1, F.struct("ts", "accepted"))
    seen = running(both, keys, ["ts", "_side", "event_id"], _block(both, keys, block, rows_per_task), _next=following(answer))
    in_time = F.unix_micros("_next.ts") - F.unix_micros("ts") <= timeout_seconds * 1_000_000
    status = F.when(in_time, F.when(F.col("_next.accepted"), F.lit("accepted")).otherwise(F.lit("rejected"))).otherwise(F.lit("timeout"))
    return seen.filter(F.col("_side") == 0).select(*keys, *ORDER, status.alias("status"))


def attendance_status(attendance: DataFrame, timeout_seconds: int = 30, as_of: Column | None = None) -> DataFrame:
    """Per meeting, in this order: no required attendee = ready, required rejected = failed, required not
    resolved in time = timeout, anything pending = pending, else ready.  Who has not answered is late once ``as_of``
    is past the limit; without ``as_of`` it stays pending."""
    required = F.col("role") == "required"
    resolved = F.coalesce(F.col("resolved_at"), as_of) if as_of is not None else F.col("resolved_at")
    late = F.unix_seconds(resolved) - F.unix_seconds("created_at") > timeout_seconds
    facts = attendance.groupBy("meeting_id").agg(
        F.bool_or(required).alias("_any"),
        F.coalesce(F.bool_or(required & (F.col("status") == "rejected")), F.lit(False)).alias("_rejected"),
        F.coalesce(F.bool_or(required & (F.col("status") != "rejected") & late), F.lit(False)).alias("_late"),
        F.coalesce(F.bool_or(F.col("status") == "pending"), F.lit(False)).alias("_pending"),
        F.count(F.lit(1)).alias("attendees"),
    )
    status = (
        F.when(~F.col("_any"), F.lit("ready")).when(F.col("_rejected"), F.lit("failed"))
        .when(F.col("_late"), F.lit("timeout")).when(F.col("_pending"), F.lit("pending")).otherwise(F.lit("ready"))
    )
    return facts.select("meeting_id", "attendees", status.alias("status"))


def missing_required(attendance: DataFrame) -> DataFrame:
    """Required attendees that did not join."""
    joined = attendance.filter(F.col("status") == "accepted").select("meeting_id", "agent_id").distinct()
    return attendance.filter(F.col("role") == "required").join(joined, ["meeting_id", "agent_id"], "left_anti")
