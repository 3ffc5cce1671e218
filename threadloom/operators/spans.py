"""Spans of a trace: parents, order, tree shape, nested export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import cut
from threadloom.functions.ordered import ROWS_PER_TASK, count_rows, running, split_if_hot


def attach_parents(spans: DataFrame) -> DataFrame:
    """Add ``has_parent`` and ``is_root``; an unknown parent makes a span a root."""
    known = spans.select(F.col("span_id").alias("parent_id"), F.lit(True).alias("_known"))
    joined = spans.join(known, "parent_id", "left")
    found = F.coalesce(F.col("_known"), F.lit(False))
    return joined.withColumn("is_root", ~found).select(*spans.columns, "is_root")


def chronological(
    spans: DataFrame, start: str, created: str, key: str = "trace_id", rows_per_task: int = ROWS_PER_TASK,
    seconds_per_block: int = 3600,
) -> DataFrame:
    """Position of each span in its trace by its first time, then id.

    The start counts when present, else the creation time; text times are parsed and unreadable ones
    come first, like missing ones.
    """
    shown = F.coalesce(F.col(start).cast("string"), F.col(created).cast("string"))
    # Fixed value: sorts before every real time.
    earliest = F.lit(-(1 << 62))
    timed = spans.withColumn("_at", F.coalesce(F.unix_micros(F.try_to_timestamp(shown)), earliest))
    block = split_if_hot(spans, [key], F.floor(F.col("_at") / (seconds_per_block * 1_000_000)).cast("bigint"), rows_per_task)
    return running(timed, [key], ["_at", "span_id"], block, position=count_rows()).drop("_at")


def span_tree(spans: DataFrame) -> DataFrame:
    """Root, depth and path of each span by doubling the known distance to an ancestor in every round.

    Takes log2(depth) rounds; finished spans leave the join.  Spans on or below a cycle never reach a
    root: they come back with null root, depth and path.
    """
    rooted = attach_parents(spans.select("span_id", "parent_id"))
    sid = F.col("span_id").cast("string")
    done = rooted.filter("is_root").select(
        "span_id", F.col("span_id").alias("root_id"), F.lit(0).cast("bigint").alias("depth"), sid.alias("path")
    )
    # up = an ancestor, hops = distance to it, tail = path below it
    open_ = rooted.filter("not is_root").select(
        "span_id", F.col("parent_id").alias("up"), F.lit(1).cast("bigint").alias("hops"), sid.alias("tail")
    )
    finished, open_ = cut(done), cut(open_)
    while True:
        at_root = open_.join(
            finished.select(F.col("span_id").alias("up"), "root_id", F.col("depth").alias("_d"), F.col("path").alias("_p")), "up"
        )
        fresh = cut(at_root.select(
            "span_id", "root_id", (F.col("_d") + F.col("hops")).alias("depth"), F.concat_ws("/", "_p", "tail").alias("path")
        ))
        if fresh.isEmpty():
            break
        finished = finished.unionByName(fresh)
        rest = open_.join(fresh.select("span_id"), "span_id", "left_anti")
        ahead = rest.select(
            F.col("span_id").alias("up"), F.col("up").alias("_up2"), F.col("hops").alias("_h2"), F.col("tail").alias("_t2")
        )
        # an ancestor that finished in this round is no longer ahead; its child finishes in the next one
        open_ = cut(rest.join(ahead, "up", "left").select(
            "span_id", F.coalesce("_up2", "up").alias("up"), (F.col("hops") + F.coalesce("_h2", F.lit(0))).alias("hops"),
            F.concat_ws("/", "_t2", "tail").alias("tail"),
        ))
    cyclic = open_.select(
        "span_id", F.lit(None).cast(rooted.schema["span_id"].dataType).alias("root_id"),
        F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("path"),
    )
    return finished.unionByName(cyclic)


def export_trace_rows(spans: DataFrame, key: str = "trace_id", start: str = "ts") -> DataFrame:
    """Spans as one JSON text per line, ordered inside each trace by position, with times redacted.

    A line carries its parent, so a reader can nest them; a trace of any size is a range of lines and
    never one row.
    """
    ordered = chronological(spans, start, start, key)
    return redact_times(ordered)


def redact_times(df: DataFrame) -> DataFrame:
    """Replace every timestamp column by a fixed word, so two runs can be compared."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")]
    return df.withColumns({t: F.lit("<datetime>") for t in times})
