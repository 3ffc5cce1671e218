"""Live rolling batches and live assembly of chunked messages, with typed keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from threadloom.operators.batching import Fold

BATCH_SCHEMA = "key string, first_us bigint, last_us bigint, messages bigint, ids array<string>"
STREAM_SCHEMA = "stream_id string, seq bigint, kind string, text string, chunks bigint, error string"
_OUT = Row("stream_id", "seq", "kind", "text", "chunks", "error")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed list and map state lives in RocksDB: outside the heap, written as changes."""
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


def _move_timer(handle, known: int | None, at: int | None) -> None:
    """The key's only timer, at ``known`` milliseconds so far, is at ``at`` now; None for no timer."""
    if known != at:
        if known is not None:
            handle.deleteTimer(known)
        if at is not None:
            handle.registerTimer(at)


class RollingProcessor(StatefulProcessor):
    """Messages of one recipient: those after the watermark wait, those before it are folded in order of time."""

    def __init__(self, gap: int, max_wait: int):
        self.gap, self.max_wait = gap, max_wait

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, id string, urgent boolean")
        self.open = handle.getListState("open", "us bigint, id string")
        # how many wait and are open, so that an empty list is not asked for
        self.status = handle.getValueState("status", "first bigint, deadline bigint, waiting int, open int, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        fresh = [(r.us, r.id, r.urgent) for r in rows]
        return self._advance(key, timerValues, fresh, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._advance(key, timerValues, [], True)

    def close(self) -> None:
        pass

    def _advance(self, key, timer_values, fresh, expired):
        mark = timer_values.getCurrentWatermarkInMs()
        now, closed = mark * 1000, []
        first, deadline, n_waiting, n_open, timer = self.status.get() or (None, None, 0, 0, None)
        fold = Fold(self.gap, self.max_wait, first, deadline)
        opened = list(self.open.get()) if n_open else []
        waiting = sorted([*(self.waiting.get() if n_waiting else []), *fresh], key=lambda w: (w[0], len(w[1]), w[1]))
        later = [w for w in waiting if w[0] >= now]

        def emit():
            if opened:
                closed.append((key[0], opened[0][0], opened[-1][0], len(opened), [i for _, i in opened]))
                opened.clear()

        for at, name, urgent in waiting[: len(waiting) - len(later)]:
            if fold.expire(at):
                emit()
            opened.append((at, name))
            if fold.add(at, urgent):
                fold.close()
                emit()
        if fold.expire(now):
            emit()
        for state, values, before in ((self.waiting, later, n_waiting), (self.open, opened, n_open)):
            if values:
                state.put([tuple(v) for v in values])
            elif before:
                state.clear()
        times = [w[0] for w in later[:1]] + ([fold.deadline] if opened else [])
        wanted = max(min(times) // 1000 + 1, mark + 1) if times else None
        _move_timer(self.handle, None if expired else timer, wanted)
        if times:
            self.status.update((fold.first, fold.deadline, len(later), len(opened), wanted))
        else:
            self.status.clear()
        yield from (Row(**dict(zip(("key", "first_us", "last_us", "messages", "ids"), c))) for c in closed)


def rolling_batches_live(
    messages: DataFrame, key: str, ts: str, message_id: str, is_urgent: Column,
    gap_seconds: float = 0.5, max_wait_seconds: float = 2.0, watermark: str = "10 seconds",
) -> DataFrame:
    """Closed batches of a live message stream, one row each.

    Messages wait in the state of their recipient until the watermark has passed them, so they are folded
    in time order however they arrive, and the result equals the stored form.  State per recipient covers the
    watermark delay plus one open batch; a timer at the batch's end closes it without a further message.  An end mark
    (``live.EndMarks``) closes the last batches of all recipients.
    """
    use_rocksdb(messages.sparkSession)
    rows = messages.select(
        F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.coalesce(F.col(message_id).cast("string"), F.lit("")).alias("id"),
        F.coalesce(is_urgent, F.lit(False)).alias("urgent"), F.unix_micros(ts).alias("us"),
    ).withWatermark("ts", watermark)
    processor = RollingProcessor(round(gap_seconds * 1e6), round(max_wait_seconds * 1e6))
    return rows.groupBy("key").transformWithState(processor, BATCH_SCHEMA, "Append", "EventTime")


class AssemblyProcessor(StatefulProcessor):
    """Chunks of one stream, kept until its message is whole or its patience ends."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq bigint, kind string, chunk string")
        # ``whole`` streams have no parts any more, only the numbers of their start and end
        self.status = handle.getValueState("status", "start bigint, complete bigint, whole boolean, held int, last_ms bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        start, complete, whole, held, last, timer = self.status.get() or (None, None, False, 0, 0, None)
        fresh, out = [], []
        for r in rows:
            fresh.extend(zip(r.seq, r.kind, r.chunk))
            last = max(last, r.ms)
        if whole:
            out = self._outside(key, fresh, start, complete)
        else:
            starts = [s for s, kind, _ in fresh if kind == "start"] + ([] if start is None else [start])
            ends = [s for s, kind, _ in fresh if kind == "complete"] + ([] if complete is None else [complete])
            start, complete = min(starts, default=None), min(ends, default=None)
            if starts and ends and start < complete <= start + held + len(fresh) - 1:  # there may be enough of them
                parts = [*(self.parts.get() if held else []), *fresh]
                whole = len({s for s, _, _ in parts if start <= s <= complete}) == complete - start + 1
            if whole:
                out = self._message(key, parts, start, complete)
                if held:
                    self.parts.clear()
                held = 0
            else:
                self.parts.appendList(fresh)
                held += len(fresh)
        wanted = max(last + self.patience, timerValues.getCurrentWatermarkInMs() + 1)
        _move_timer(self.handle, timer, wanted)
        self.status.update((start, complete, whole, held, last, wanted))
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The stream is given up, or forgotten when it was whole."""
        start, _, whole, held, _, _ = self.status.get()
        out = []
        if not whole:
            parts = sorted(self.parts.get(), key=lambda p: p[0])
            ends = [s for s, kind, _ in parts if kind == "complete" and start is not None and s > start]
            if ends:  # with holes
                out = self._message(key, parts, start, ends[0])
            else:
                out = [(key[0], s, kind, None, None, "no start") for s, kind, _ in parts if start is None or s < start]
                if start is not None:
                    out.append((key[0], None, None, None, sum(kind == "chunk" and s > start for s, kind, _ in parts), "not completed"))
            self.parts.clear()
        self.status.clear()
        yield from self._rows(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _outside(key, parts, start: int, complete: int) -> list[tuple]:
        return [(key[0], s, k, None, None, "no start" if s < start else "already completed") for s, k, _ in parts if s < start or s > complete]

    def _message(self, key, parts, start: int, complete: int) -> list[tuple]:
        parts = sorted(parts, key=lambda p: p[0])
        texts = [chunk or "" for seq, kind, chunk in parts if start < seq < complete and kind == "chunk"]
        return [(key[0], None, None, "".join(texts), len(texts), None), *self._outside(key, parts, start, complete)]

    @staticmethod
    def _rows(found: list[tuple]) -> list[Row]:
        return [_OUT(*f) for f in found]


def _packed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one stream that arrive next to each other as one row with lists, at their last time."""
    names = ["stream_id", "seq", "kind", "chunk", "ts"]
    for table in tables:
        lists = pa.Table.from_batches([table]).group_by("stream_id", use_threads=False).aggregate(
            [("seq", "list"), ("kind", "list"), ("chunk", "list"), ("ts", "max")]
        )
        yield from lists.select(["stream_id", "seq_list", "kind_list", "chunk_list", "ts_max"]).rename_columns(names).combine_chunks().to_batches()


def assemble_streams_live(chunks: DataFrame, ts: str = "ts", watermark: str = "10 seconds", patience_seconds: int = 60) -> DataFrame:
    """Messages of a live chunk stream (``text``, ``chunks``), and with ``error`` the rows that belong to no open stream.

    ``chunks(stream_id, seq, kind, chunk, ts)``, in any order.  A message is emitted as soon as its start, its end and
    all numbers between are there.  The stream is remembered then, so that later rows are known as such, and given up or
    forgotten when the watermark is ``patience_seconds`` past its last row: with holes a message of what is there, without
    an end one row "not completed", without a start an error for each row.  A row behind the watermark is kept when it
    arrives next to a later one of its stream.
    """
    use_rocksdb(chunks.sparkSession)
    rows = chunks.select(
        F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("bigint").alias("seq"), F.col("kind").cast("string").alias("kind"),
        F.col("chunk").cast("string").alias("chunk"), F.col(ts).alias("ts"))
    # a row costs Python far more than an element of a list: rows are packed before the state
    packed = rows.mapInArrow(_packed, f"stream_id string, seq array<bigint>, kind array<string>, chunk array<string>, ts {rows.schema['ts'].dataType.simpleString()}")
    timed = packed.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", watermark)
    return timed.groupBy("stream_id").transformWithState(AssemblyProcessor(patience_seconds * 1000), STREAM_SCHEMA, "Append", "EventTime")
