"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored
from threadloom.llm.common import bit_set, chunks, documents, in_bit_set, shingles, utf8, words

#: Shortest tile, in words.
MIN_TILE = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def plain_words(array):
    """Hashes of the lower-cased runs of letters and digits of texts, and the n + 1 offsets of each text's words."""
    import pyarrow.compute as pc

    data, offsets = utf8(pc.utf8_lower(array))
    kept = (data >= 0x80) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    hashes, _, _, bounds = words(np.where(kept, data, np.uint8(32)), offsets)
    return hashes, bounds


def _windows(prefix, inverse, length, marked):
    """Running Karp-Rabin hashes of the windows of ``length`` unmarked words, and where they start."""
    n = len(inverse)
    if length > n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.flatnonzero(marked[length:] == marked[: n - length + 1])
    return (prefix[start + length] - prefix[start]) * inverse[start], start


def tile(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first, none overlapping.

    The longest common window of unmarked words is found by bisection over the length, as a common window of some
    length holds common windows of all smaller ones; all matches of that length are marked from left to right.
    """
    tiles: list[tuple[int, int, int]] = []
    sides = []
    for side in (item, text):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(side), _BASE, np.uint64), dtype=np.uint64)
            inverse = np.cumprod(np.full(len(side), _INVERSE, np.uint64), dtype=np.uint64)
            sides.append((np.r_[np.uint64(0), np.cumsum(side * power, dtype=np.uint64)], inverse, np.zeros(len(side), bool)))

    def common(length):
        found = []
        for prefix, inverse, used in sides:
            found.append(_windows(prefix, inverse, length, np.r_[0, np.cumsum(used)]))
        (a, at), (b, to) = found
        inside = np.isin(a, b)
        return at[inside], a[inside], b, to

    upper = min(len(item), len(text))
    while upper >= shortest:
        low, high = shortest - 1, upper
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < shortest:
            break
        at, hashes, b, to = common(low)
        order = np.argsort(b, kind="stable")
        b, to = b[order], to[order]
        marked = False
        for i, h in zip(at, hashes):
            if sides[0][2][i: i + low].any():
                continue
            for j in to[np.searchsorted(b, h, "left"): np.searchsorted(b, h, "right")]:
                if not sides[1][2][j: j + low].any() and (item[i: i + low] == text[j: j + low]).all():
                    sides[0][2][i: i + low] = sides[1][2][j: j + low] = True
                    tiles.append((int(i), int(j), int(low)))
                    marked = True
                    break
        upper = low if marked else low - 1
    return tiles


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item of whose words tiles cover at least ``coverage``.

    Rows (doc_id, item_id, item_words, covered, tiles, coverage).  Words are lower-cased runs of letters and digits;
    an item of fewer than ``shortest`` words must occur as a whole.  Reordered passages count, as tiles may stand in
    any order.

    1. Seeds are the items' windows of ``shortest`` words.  A bit set of fixed size over their hashes goes to every
       task; of each document only the runs of words under seeds leave its task.
    2. Seeds of runs and items are joined exactly; pairs whose seeds cannot cover enough are dropped.
    3. Each pair left is tiled.

    Null or empty texts and items without words match nothing; a null doc_id is reported as null; repeated rows of an
    id are one document, repeated items one item; empty tables give no rows; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext

    def read_items(batches):
        import pyarrow as pa

        for part in chunks(batches):
            hashes, bounds = plain_words(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
            size = np.minimum(np.diff(bounds), shortest)
            seeds = [[] for _ in size]
            for k in range(1, shortest + 1):
                value, at = shingles(hashes, bounds, k)
                for i in np.flatnonzero(size == k):
                    seeds[i] = value[at[i]: at[i + 1]].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id"), lists, pa.array(size, pa.int32()), pa.array(seeds, pa.list_(pa.int64()))], ["item_id", "item", "size", "seeds"],
            )

    item_type, id_type = benchmark.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").mapInArrow(read_items, f"item_id {item_type}, item array<long>, size int, seeds array<long>")
    items = stored(items.filter("size > 0").withColumn("item_key", F.xxhash64("item_id", "item")).dropDuplicates(["item_key"]), "items")
    seeds = items.select("item_key", "size", F.size("item").alias("item_words"), F.posexplode("seeds").alias("place", "seed"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``shortest`` numbers
    shared = context.broadcast((bit_set(seeds, "seed"), sizes))

    def read_runs(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        bits, lengths = shared.value
        for part in chunks(batches):
            hashes, bounds = plain_words(part.column("text"))
            under = np.zeros(len(hashes) + 1, np.int64)
            for k in lengths:
                value, at = shingles(hashes, bounds, k)
                text = np.repeat(np.arange(part.num_rows), np.diff(at))
                start = bounds[:-1][text] + np.arange(len(value)) - at[:-1][text]
                start = start[in_bit_set(bits, value) & (start + k <= bounds[1:][text])]
                np.add.at(under, start, 1)
                np.add.at(under, start + k, -1)
            inside = np.cumsum(under[:-1]) > 0
            text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            joined = inside[1:] & inside[:-1] & (text[1:] == text[:-1])
            first = np.flatnonzero(inside & ~np.r_[False, joined])
            last = np.flatnonzero(inside & ~np.r_[joined, False]) + 1
            rows = [hashes[a:b].view(np.int64) for a, b in zip(first, last)]
            runs = pa.array(np.arange(len(rows)) + number)
            number += len(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(text[first])), runs, pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "run", "words"],
            )

    runs = docs.select("doc_id", "text").mapInArrow(read_runs, f"doc_id {id_type}, run long, words array<long>")
    runs = stored(runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("run", "words"))).alias("runs")), "runs")

    def read_grams(batches):
        import pyarrow as pa

        _, lengths = shared.value
        for batch in batches:
            ids, grams = [], []
            for i, own in enumerate(batch.column("runs").to_pylist()):
                flat = np.array([w for r in own for w in r["words"]], np.int64).view(np.uint64)
                bounds = np.cumsum([0, *(len(r["words"]) for r in own)])
                found = np.unique(np.concatenate([shingles(flat, bounds, k)[0] for k in lengths]))
                ids.append(np.full(len(found), i))
                grams.append(found.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(grams))], ["doc_id", "seed"])

    grams = runs.mapInArrow(read_grams, f"doc_id {id_type}, seed long")
    pairs = (
        grams.join(seeds, "seed").groupBy("doc_id", "item_key").agg(F.count("*").alias("hits"), F.first("size").alias("size"), F.first("item_words").alias("item_words"))
        .filter(F.col("hits") * F.col("size") >= F.lit(coverage) * F.col("item_words")).select("doc_id", "item_key")
    )
    together = pairs.join(items.select("item_key", "item_id", "item", "size"), "item_key").join(
        runs.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "item_id", "item", "size", "runs")

    def cover(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for item, size, own in zip(*(batch.column(c).to_pylist() for c in ("item", "size", "runs"))):
                parts = []
                for k, r in enumerate(own):  # a word that no item has ends each run
                    parts += [np.array(r["words"], np.int64).view(np.uint64), np.array([k], np.uint64)]
                item = np.array(item, np.int64).view(np.uint64)
                found = tile(item, np.concatenate(parts), size)
                out.append((len(item), sum(t[2] for t in found), len(found)))
            n, covered, count = (np.array([o[i] for o in out], np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(n), pa.array(covered), pa.array(count), pa.array(covered / np.maximum(n, 1))],
                ["doc_id", "item_id", "item_words", "covered", "tiles", "coverage"],
            )

    scored = together.mapInArrow(cover, f"doc_id {id_type}, item_id {item_type}, item_words long, covered long, tiles long, coverage double")
    return scored.filter(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a contaminated pair, all columns."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(F.col("_gone")), "left_anti").select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
SQL: dict[str, str] = {}
