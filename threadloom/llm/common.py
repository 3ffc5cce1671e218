"""Helpers of the text operators: hash splits, Arrow text buffers, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import discard, stored

#: Text bytes handled at once inside a task.
CHUNK_BYTES = 4 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_mod(column: str = "doc_id", by: int = 5) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its n + 1 offsets; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset: array.offset + n + 1]
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(batches, text: str = "text", size: int = CHUNK_BYTES):
    """Record batches cut so that each holds about ``size`` bytes of text, or one longer text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths) - lengths) // size
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def components(nodes_edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the links (a, b): rows (node, component), component = smallest node reached.

    Distributed union-find by alternating large-star and small-star steps over the edge table; each round is written
    to the shared folder.  An edge always points from a node to a smaller one, so a star never gathers a list in one
    task: minima are aggregated before the shuffle and joined back.
    """
    edges = nodes_edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "edges")
    while True:
        # large star: every larger neighbour of u is linked to the smallest member of u's neighbourhood
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = stored(large.distinct(), "edges")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        small = stored(small, "edges")
        before, after = (e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first() for e in (edges, small))
        discard(edges, large)
        edges = small
        if before == after:
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = out.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._stored_path = edges._stored_path
    return out


_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray):
    """Words of texts: runs of bytes other than blank and 0x09-0x0D.

    Returns 64-bit hashes, first byte and length of each word, and the n + 1 offsets of each text's words.
    """
    visible = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    begins = visible.copy()
    begins[1:] &= ~visible[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    ends = visible.copy()
    ends[:-1] &= ~visible[1:] | edge[1:-1]
    length = np.flatnonzero(ends) + 1 - start
    inside = np.flatnonzero(visible)
    if not len(start):
        return np.zeros(0, np.uint64), start, length, np.zeros(len(offsets), np.int64)
    first = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first, length)
    power = _POWER[np.minimum(place, len(_POWER) - 1)]
    if place.max() >= len(_POWER):  # words of any length: powers beyond the table are computed
        far = np.flatnonzero(place >= len(_POWER))
        power[far] = mix(place[far].astype(np.uint64)) | np.uint64(1)
    value = np.add.reduceat(mix(_BYTE[data[inside]] + power) * power, first)
    return mix(value + length.astype(np.uint64)), start, length, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row within each text, and the n + 1 offsets of each text's shingles.

    A text of fewer words, but at least one, has its whole sequence as one shingle.
    """
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.cumsum(count) - count
    text = np.repeat(np.arange(len(n)), count)
    at = bounds[:-1][text] + np.arange(len(text)) - out[text]
    value = np.zeros(len(at), np.uint64)
    for j in range(size):
        place = at + j
        present = place < bounds[1:][text]
        word = np.where(present, hashes[np.minimum(place, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(j + 1))
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + word)
    return value, np.append(out, len(text))


def bit_set(values: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A fixed-size bit set over 64-bit hashes: ``bits / 8`` bytes on the driver, however many values there are.

    Members always test true; others may too.  Test with ``in_bit_set``.
    """
    rows = (
        values.select(F.pmod(F.col(column), F.lit(bits)).alias("s")).groupBy(F.shiftright("s", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("set"))
    )
    found = np.zeros(bits // 32, np.uint32)
    for r in rows.collect():  # at most bits / 32 rows
        found[r.word] = r.set
    return found


def in_bit_set(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = (hashes.view(np.uint64) & np.uint64(len(found) * 32 - 1)).astype(np.int64)
    return (found[spot >> 5] >> (spot & 31).astype(np.uint32)) & np.uint32(1) == 1
