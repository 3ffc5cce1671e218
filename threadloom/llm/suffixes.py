"""Removal of repeated byte windows by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored, tidy
from threadloom.llm.common import bit_set, chunks, documents, in_bit_set, mix, utf8

#: Bytes of a window that must not repeat, and of the first digit of its anchored suffix.
THRESHOLD = 100
DIGIT = 32
#: Runs or windows that a task sorts at once, before they leave it, and the text bytes that it takes at once.
HELD_RUNS = 1 << 19
PART_BYTES = 1 << 20
#: The last pass sorts windows by the first bit of their hash, then each half for itself: half the shuffle at a time.
HALVES = 2

_RANDOM = np.random.default_rng(77001)
_LETTER = _RANDOM.integers(1, 1 << 62, (2, 256), dtype=np.uint64)
_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


class Ranges:
    """Hashes of any byte range of a buffer, by running sums."""

    def __init__(self, data: np.ndarray, which: int):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(data), _STEP[which], np.uint64), dtype=np.uint64)
            self.sums = np.r_[np.uint64(0), np.cumsum(_LETTER[which][data] * power, dtype=np.uint64)]
            self.inverse = np.cumprod(np.full(len(data) + 1, pow(_STEP[which], -1, 1 << 64), np.uint64), dtype=np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _digits(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from each place on."""
    h = mix(_LETTER[0][data])
    width = 1
    while width < size:
        h = mix(h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
        width *= 2
    return h


def _leftmost_minimum(h: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost smallest value among ``size`` values from each place on."""
    value, place = h, np.arange(len(h), dtype=np.int32)

    def joined(value, place, shift):
        later = value[shift:] < value[:-shift]
        return np.where(later, value[shift:], value[:-shift]), np.where(later, place[shift:], place[:-shift])

    width = 1
    while 2 * width <= size:
        value, place = joined(value, place, width)
        width *= 2
    if size > width:
        value, place = joined(value, place, size - width)
    return place


def anchored_runs(data: np.ndarray, offsets: np.ndarray, threshold: int, digit: int):
    """Runs of window starts with one anchor: (text number, first start, last start, digit of the anchor, class).

    A window's anchor is the place of the leftmost smallest digit in it: it depends on the window alone, so equal
    windows have equal anchors.  class: hash of all bytes of the run's windows and of the anchor's place in them.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < threshold:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    h = _digits(data, digit)
    anchor = _leftmost_minimum(h, threshold - digit + 1)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    start = np.flatnonzero(text[: len(anchor)] == text[threshold - 1: threshold - 1 + len(anchor)])
    chosen = anchor[start]
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[start[1:]] != text[start[:-1]]) | (np.diff(start) != 1)])
    low, at = start[new], chosen[new].astype(np.int64)
    high = start[np.r_[new[1:] - 1, len(start) - 1]]
    whole = Ranges(data, 0)(low, high + threshold)
    shape = ((at - low).astype(np.uint64) << np.uint64(32)) + (high - low).astype(np.uint64)
    return text[low].astype(np.int64), low, high, h[at], mix(mix(whole) + mix(shape))


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching intervals of one owner joined; input in order of (owner, start)."""
    if not len(start):
        return owner, start, end
    shift = owner.astype(np.int64) * (1 << 40)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.r_[True, start[1:] + shift[1:] > reach[:-1]])
    return owner[new], start[new], (reach - shift)[np.r_[new[1:] - 1, len(start) - 1]]


def _first_of(batch_rows: list, width: int):
    """Split collected rows into those first of their class in (doc_id, th, start) order, and the others.

    Rows equal to the first one in all three come from a repeated document: they are neither.  Rows are tuples of arrays (digit, class, doc_id, th, start, extent); a class is its digit and class.
    """
    columns = [np.concatenate(c) for c in zip(*batch_rows)]
    order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    first = np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]
    ends = columns[4] + columns[5] + width
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = np.logical_or.reduce([c != c[head] for c in columns[2:5]])
    rest = [c[later] for c in (columns[2], columns[3], columns[4])] + [ends[later]]
    order = np.lexsort((rest[2], rest[1], rest[0]))
    doc, th, start, end = (c[order] for c in rest)
    owner = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]) if len(doc) else np.zeros(0, np.int64)
    heads = np.flatnonzero(np.r_[True, np.diff(owner) != 0]) if len(doc) else np.zeros(0, np.int64)
    owner, start, end = _merged(owner, start, end)
    return [c[first] for c in columns], (doc[heads][owner] if len(doc) else doc, th[heads][owner] if len(doc) else th, start, end)


_SCHEMA = "kind int, digit long, class long, doc_id long, th long, start int, extent int"


def _rows(kept, gone):
    """kind 0: the first row of a class in this task; kind 1: bytes ``start`` to ``start + extent`` that repeat."""
    import pyarrow as pa

    digit, cls, doc, th, start, extent = kept
    doc2, th2, start2, end2 = gone
    n, m = len(digit), len(doc2)
    spread = mix(doc2.view(np.uint64) + th2.view(np.uint64)).view(np.int64)  # no digit: dealt at random
    columns = [
        np.r_[np.zeros(n, np.int32), np.ones(m, np.int32)], np.r_[digit.view(np.int64), spread], np.r_[cls.view(np.int64), spread],
        np.r_[doc, doc2], np.r_[th, th2], np.r_[start, start2].astype(np.int32), np.r_[extent, end2 - start2].astype(np.int32),
    ]
    names = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _pass(rows: DataFrame) -> DataFrame:
    """One pass over all tasks' rows: numbers each class's rows and counts a digit's classes; unique suffixes leave.

    Rows of a repeated document have one number.
    """
    dealt = rows.repartition("digit")
    ordered = Window.partitionBy("digit", "class").orderBy("doc_id", "th", "start")
    numbered = dealt.withColumn("number", F.dense_rank().over(ordered)).withColumn("row", F.row_number().over(ordered))
    numbered = numbered.withColumn("classes", F.sum(F.when(F.col("row") == 1, 1).otherwise(0)).over(Window.partitionBy("digit")))
    return numbered.drop("row").filter("kind = 1 or number > 1 or classes > 1")


def repeated(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """Rows (doc_id, th, spans): the byte ranges of each text that an earlier window of ``threshold`` bytes covers.

    Suffixes are sorted by digits, most significant first, and leave as soon as they are alone:

    1. Only suffixes at anchors are sorted, one for each run of windows that share it; the digit is the anchor's
       ``digit`` bytes.  An anchor whose digit is unique in the corpus has no repeated window.
    2. Within a digit, the run's whole bytes are the next digit: all runs of a class but the first repeat it.
    3. The first runs of different classes with one digit share some windows only: they are split into windows, and
       the last pass sorts these by their ``threshold`` bytes.

    Each task sends the first row of a class only, so a copied passage is one row for each task.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("th"), "text")

    def runs(batches):
        held, size = [], 0
        for part in chunks(batches, size=PART_BYTES):
            data, offsets = utf8(part.column("text"))
            text, low, high, digits, cls = anchored_runs(data, offsets, threshold, digit)
            ids, ths = part.column("doc_id").to_numpy(), part.column("th").to_numpy()
            held.append((digits, cls, ids[text], ths[text], low - offsets[text], high - low))
            size += len(low)
            if size > HELD_RUNS:
                yield _rows(*_first_of(held, threshold))
                held, size = [], 0
        if size:
            yield _rows(*_first_of(held, threshold))

    found = stored(_pass(keyed.mapInArrow(runs, _SCHEMA)), "runs")
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("extent")).alias("b"))
    whole = found.filter("kind = 1").select("doc_id", "th", span.alias("span")).unionAll(
        found.filter("kind = 0 and number > 1").select("doc_id", "th", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("extent") + threshold).alias("b")).alias("span")))
    split = found.filter("kind = 0 and number = 1 and classes > 1")
    split = stored(split.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "extent")).alias("runs")), "split-runs")
    together = with_texts(keyed, split)

    def windows(batches, half):
        held, size = [], 0
        for part in chunks(batches, size=PART_BYTES):
            data, offsets = utf8(part.column("text"))
            ids, ths = part.column("doc_id").to_numpy(), part.column("th").to_numpy()
            hashes = [Ranges(data, 0), Ranges(data, 1)]
            flat = part.column("runs").flatten()
            start, extent = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
            text = np.repeat(np.arange(part.num_rows), [len(x) for x in part.column("runs")])
            count = extent + 1
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            text = np.repeat(text, count)
            order = np.unique(text * (1 << 40) + at)
            text, at = order >> 40, order & ((1 << 40) - 1)
            begin = at + offsets[text]
            first = mix(hashes[0](begin, begin + threshold))
            own = np.flatnonzero(first % np.uint64(HALVES) == half)
            first, begin, text, at = first[own], begin[own], text[own], at[own]
            held.append((first, mix(hashes[1](begin, begin + threshold)), ids[text], ths[text], at, np.zeros(len(at), np.int64)))
            size += len(at)
            if size > HELD_RUNS:
                yield _rows(*_first_of(held, threshold))
                held, size = [], 0
        if size:
            yield _rows(*_first_of(held, threshold))

    order = Window.partitionBy("digit", "class").orderBy("doc_id", "th", "start")
    length = F.when(F.col("kind") == 1, F.col("extent")).otherwise(F.lit(threshold))
    for half in range(HALVES):
        rows = together.mapInArrow(lambda batches, half=half: windows(batches, half), _SCHEMA).repartition("digit")
        last = rows.withColumn("number", F.dense_rank().over(order)).filter("kind = 1 or number > 1")
        last = last.select("doc_id", "th", F.struct(F.col("start").alias("a"), (F.col("start") + length).alias("b")).alias("span"))
        whole = whole.unionAll(stored(last, "windows"))
    return whole.groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans"))


def with_texts(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """Joins texts by (doc_id, th); a fixed-size bit set keeps most other texts from being shuffled.

    Repeated rows come out each.
    """
    hashed = F.xxhash64("doc_id", "th")
    shared = keyed.sparkSession.sparkContext.broadcast(bit_set(parts.select(hashed.alias("hash")), "hash"))

    def let_through(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_bit_set(shared.value, batch.column("hash").to_numpy())))

    texts = keyed.withColumn("hash", hashed).mapInArrow(let_through, "doc_id long, th long, text string, hash long")
    return texts.drop("hash").join(parts, ["doc_id", "th"])


@tidy
def remove_repeated(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one for each input row.

    Every byte covered by a ``threshold``-byte string that also starts earlier (smaller doc_id, or the same text at an
    earlier place) goes; strings are judged on the input.  kept: the remaining bytes (binary, as a cut may split a
    character); n_spans: maximal removed runs.

    Null or short texts lose nothing (null: 0 bytes).  A null doc_id comes before all others.  Rows of one doc_id and
    text are one document and all get its result; different texts of one id are ordered by their hash.  Empty tables
    give no rows; other columns are ignored.
    """
    spans = stored(repeated(docs, threshold, digit), "spans")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("th"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("unnamed"),
    )
    hashed = F.xxhash64("doc_id", "th")
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(spans.select(hashed.alias("hash")), "hash"))

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            inside = in_bit_set(shared.value, batch.column("hash").to_numpy())
            columns = [*(batch.column(c) for c in ("doc_id", "th", "text", "unnamed")), pa.array(inside)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "text", "unnamed", "cut"])

    tested = keyed.withColumn("hash", hashed).mapInArrow(test, "doc_id long, th long, text string, unnamed boolean, cut boolean")
    empty = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    cut = tested.filter("cut").join(spans, ["doc_id", "th"], "left").withColumn("spans", F.coalesce("spans", empty))
    rows = cut.select("doc_id", "unnamed", "text", "spans").unionAll(tested.filter("not cut").select("doc_id", "unnamed", "text", empty.alias("spans")))

    def remove(batches):
        import pyarrow as pa

        for part in chunks(batches, size=PART_BYTES):
            data, offsets = utf8(part.column("text"))
            out = []
            for i, own in enumerate(part.column("spans")):
                text = data[offsets[i]: offsets[i + 1]]
                if not len(own):
                    out.append((len(text), 0, 0, text.tobytes()))
                    continue
                a, b = (own.values.field(j).to_numpy() for j in range(2))
                delta = np.zeros(len(text) + 1, np.int64)
                np.add.at(delta, a, 1)
                np.add.at(delta, b, -1)
                gone = np.cumsum(delta[:-1]) > 0
                out.append((len(text), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), text[~gone].tobytes()))
            named = pa.array([None if u else d for d, u in zip(part.column("doc_id").to_pylist(), part.column("unnamed").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [named, *(pa.array([o[j] for o in out], pa.int64()) for j in range(3)), pa.array([o[3] for o in out], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
SQL: dict[str, str] = {}
