"""Packing along a space-filling curve: neighbouring documents share sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored
from threadloom.llm.common import chunks, documents

SEQUENCE_TOKENS = 1024
DIMENSIONS = 4
BITS = 8
#: Cached words of one task's tokenizer; beyond it the cache starts anew.
CACHED_WORDS = 300_000
SPECIAL = "<|endoftext|>"


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of points (n x d, integers below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level & 1)
    return key


def token_directions(vocabulary: int, dimensions: int) -> np.ndarray:
    """A fixed pseudo-random direction (+1 or -1 in each dimension) for every token id."""
    v = np.arange(1, vocabulary + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ v >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    return np.stack([((v >> np.uint64(7 * i)) & np.uint64(1)).astype(np.float32) * 2 - 1 for i in range(dimensions)], 1)


class Encoder:
    """Ids of whole texts; words between single blanks are encoded once and kept.

    A blank before a visible character always begins a new unit of the tokenizer's pattern, so the pieces can be
    encoded one by one.  A text with other uses of blanks is encoded as a whole.
    """

    def __init__(self, vocabulary_path: str, pattern: str):
        import base64
        import re

        import tiktoken

        with open(vocabulary_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = len(ranks)
        self.unusual = re.compile(r" (?:\s|$)|^ ")
        self.cache: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def _part(self, text: str) -> bytes:
        if self.unusual.search(text):
            return self._plain(text)
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache, out = self.cache, []
        first, *words = text.split(" ")
        out.append(self._plain(first))
        for word in words:
            ids = cache.get(word)
            if ids is None:
                ids = self._plain(" " + word)
                if len(word) < 40:
                    cache[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian 16-bit ids; the special token's text is its id, as in the tokenizer's default."""
        if SPECIAL in text:
            return np.array([self.special], "<u2").tobytes().join(self._part(x) for x in text.split(SPECIAL))
        return self._part(text)


def encoded(docs: DataFrame, vocabulary_path: str, pattern: str, dimensions: int = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, key, ids): Hilbert key of the document's projected token vector, and its 16-bit ids with a closing 0."""
    def encode(batches):
        import pyarrow as pa

        encoder = Encoder(vocabulary_path, pattern)
        table = token_directions(encoder.special + 1, dimensions)
        for part in chunks(batches):
            ids = [encoder.encode(t or "") + b"\0\0" for t in part.column("text").to_pylist()]
            counts = np.array([len(x) // 2 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), "<u2")
            sums = np.add.reduceat(table[flat], np.cumsum(counts) - counts, axis=0)
            mean = sums / counts[:, None]
            cells = np.clip((mean + 0.5) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(hilbert_key(cells, bits)), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {id_type}, key long, ids binary")


def _filled(size: int):
    """Cut a sorted partition into sequences of ``size`` tokens; the rest into sequences of falling powers of two."""
    def pieces(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        sequence, used = 0, 0  # the open sequence and its tokens
        waiting: list[tuple] = []  # its pieces, until it is full

        def batch(rows):
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        id_type = None
        for part in batches:
            id_type = part.schema.field("doc_id").type
            ready: list[tuple] = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                n, at = len(wide), 0
                while at < n:
                    take = min(size - used, n - at)
                    waiting.append((doc, at, take, n, base + sequence, used, wide[at: at + take].tobytes()))
                    at, used = at + take, used + take
                    if used == size:
                        ready += waiting
                        waiting, used, sequence = [], 0, sequence + 1
            if ready:
                yield batch(ready)
        ready = []
        todo = waiting[::-1]
        while used:
            room = 1 << used.bit_length() - 1
            used -= room
            offset = 0
            while offset < room:
                doc, start, length, n, _, _, ids = todo.pop()
                take = min(room - offset, length)
                ready.append((doc, start, take, n, base + sequence, offset, ids[: 4 * take]))
                if take < length:
                    todo.append((doc, start + take, length - take, n, 0, 0, ids[4 * take:]))
                offset += take
            sequence += 1
        if ready:
            yield batch(ready)

    return pieces


def pack(docs: DataFrame, vocabulary_path: str | None = None, pattern: str | None = None, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of packed sequences: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    Documents are tokenised once and written to the shared folder, range-partitioned and sorted by (Hilbert key,
    doc_id), and cut every ``size`` tokens within a partition.  What is left of a partition fills sequences whose
    lengths are powers of two, which need no padding.  ids: the piece's ids as little-endian unsigned 32-bit.

    Every row is one document, also a repeated one; null or empty text has the closing id only; no documents give no
    rows; other columns are ignored.  Copies have one key and stay together, and a key of many copies spreads over
    partitions by doc_id.
    """
    if vocabulary_path is None or pattern is None:
        import public_tokenizers

        vocabulary_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = stored(encoded(docs, str(vocabulary_path), pattern), "encoded")
    ordered = coded.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(
        _filled(size), f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
