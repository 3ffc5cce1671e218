"""Rolling message batches as a batch job; the live form is in ``streaming.batches``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.ordered import ROWS_PER_TASK, Running, previous, running, settle, split_if_hot, time_block


@dataclass
class Fold:
    """State of the open batch of one recipient; all times are integer microseconds.

    A batch closes after ``gap`` of quiet.  The timer is not moved any more once the batch is older than half
    of ``max_wait``; a message at or past ``max_wait`` and an urgent message close the batch and belong to it.
    """

    gap: int
    max_wait: int
    first: int | None = None
    deadline: int | None = None
    number: int = 0

    def expire(self, now: int) -> bool:
        """Close the open batch when its timer ended by ``now``."""
        if self.first is not None and self.deadline <= now:
            self.close()
            return True
        return False

    def close(self) -> None:
        self.first = self.deadline = None
        self.number += 1

    def add(self, at: int, urgent: bool) -> bool:
        """Add a message; True when it closes the batch."""
        if self.first is None:
            self.first = at
        age = at - self.first
        if urgent or age >= self.max_wait:
            return True
        if self.deadline is None or 2 * age < self.max_wait:
            self.deadline = at + self.gap
        return False


def rolling_batches(
    messages: DataFrame, key: str, order: list[str], is_urgent: Column, gap_seconds: float = 0.5, max_wait_seconds: float = 2.0,
    block: Column | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``segment`` and ``batch`` (number inside the segment) to each message.

    A quiet time of at least ``gap`` and an urgent message always end a batch, so a recipient is cut into
    independent segments there, by windows.  Only inside a segment the rule needs a fold; segments are
    spread over all tasks and folded as sorted streams of rows, never as whole groups.
    """
    gap, max_wait = round(gap_seconds * 1e6), round(max_wait_seconds * 1e6)
    ts = order[0]
    block = split_if_hot(messages, [key], time_block(F.col(ts)) if block is None else block, rows_per_task)
    flagged = messages.select(key, *order, F.coalesce(is_urgent, F.lit(False)).alias("_urgent"), F.unix_micros(ts).alias("_us"))
    before = running(flagged, [key], order, block, _prev=previous(F.struct("_us", "_urgent")))
    starts = F.col("_prev").isNull() | F.col("_prev._urgent") | (F.col("_us") - F.col("_prev._us") >= gap)
    cut = running(
        settle(before.withColumn("_start", starts.cast("bigint")), block), [key], order, block,
        segment=Running("sum", F.col("_start")),
    ).drop("_prev", "_start")
    spread = cut.repartition(key, "segment").sortWithinPartitions(key, "segment", *order)
    schema = T.StructType([*spread.schema.fields, T.StructField("batch", T.LongType())])

    def fold(batches):
        current, state = None, None
        for rows in batches:
            numbers = []
            for k, segment, at, urgent in zip(rows[key], rows["segment"], rows["_us"], rows["_urgent"]):
                if (k, segment) != current:
                    current, state = (k, segment), Fold(gap, max_wait)
                state.expire(at)
                number = state.number
                if state.add(at, urgent):
                    state.close()
                numbers.append(number)
            yield rows.assign(batch=numbers)

    return spread.mapInPandas(fold, schema).drop("_us", "_urgent")


def assemble_streams(chunks: DataFrame, rows_per_block: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(one message per completed stream, chunks that belong to no open stream).

    ``chunks(stream_id, seq, kind, chunk)`` with kind start, chunk or complete.  The text is joined per block
    of sequence numbers first, then per stream.
    """
    begins = chunks.filter(F.col("kind") == "start").groupBy("stream_id").agg(F.min("seq").alias("_from"))
    # the end is the first one after the start; an earlier one belongs to no stream
    ends = chunks.filter(F.col("kind") == "complete").join(begins, "stream_id").filter("seq >= _from").groupBy("stream_id").agg(F.min("seq").alias("_to"))
    bounds = chunks.select("stream_id").distinct().join(begins, "stream_id", "left").join(ends, "stream_id", "left")
    placed = chunks.join(bounds, "stream_id")
    seq = F.col("seq")
    is_open = F.col("_from").isNotNull() & (seq >= F.col("_from")) & (F.col("_to").isNull() | (seq <= F.col("_to")))
    errors = placed.filter(~is_open).select(
        "stream_id", "seq", "kind",
        F.when(F.col("_from").isNull() | (seq < F.col("_from")), F.lit("no start")).otherwise(F.lit("already completed")).alias("error"),
    )

    def joined(at: str, text: str):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda x: x[text]), "")

    inside = placed.filter(is_open & F.col("_to").isNotNull() & (F.col("kind") == "chunk"))
    pieces = inside.groupBy("stream_id", F.floor(seq / rows_per_block).alias("_at")).agg(
        joined("seq", "chunk").alias("text"), F.count(F.lit(1)).alias("_n")
    )
    texts = pieces.groupBy("stream_id").agg(joined("_at", "text").alias("text"), F.sum("_n").alias("chunks"))
    complete = bounds.filter(F.col("_from") <= F.col("_to")).select("stream_id")
    messages = complete.join(texts, "stream_id", "left").select(
        "stream_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("chunks", F.lit(0)).alias("chunks")
    )
    return messages, errors


def span_durations(starts: DataFrame, ends: DataFrame, key: str, bound: str) -> DataFrame:
    """Start/end pairs of one call key within a time bound; valid for stored and for live frames.

    Live frames need a watermark on ``ts`` (start) and ``end_ts`` (end).
    """
    limit = F.expr(f"ts + interval {bound}")
    right = ends.select(F.col(key).alias("_end_key"), F.col("end_ts"))
    joined = starts.join(right, (F.col(key) == F.col("_end_key")) & (F.col("end_ts") >= F.col("ts")) & (F.col("end_ts") <= limit))
    return joined.select(*starts.columns, "end_ts", (F.unix_micros("end_ts") - F.unix_micros("ts")).alias("duration_us"))
