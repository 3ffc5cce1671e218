"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import chunks, documents, id_mod, utf8

BITS = 15
#: Labelled documents per language that the centroids are fitted on (expected number of a hash sample).
SAMPLE_PER_LANGUAGE = 1500
CENTROIDS_PER_LANGUAGE = 4
#: A text whose best cosine is lower is too far from every centroid.
REJECT_BELOW = 0.05
NO_LANGUAGE = "und"


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray  # float32, buckets x centroids
    idf: np.ndarray  # float32, per bucket


def grams(array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, occurrences) of hashed byte trigrams with a letter in lower-cased texts, ordered."""
    import pyarrow.compute as pc

    data, offsets = utf8(pc.utf8_lower(array))
    n = len(offsets) - 1
    letter = (data >= 0x80) | ((data >= 97) & (data <= 122))
    plain = np.where(letter, data, np.uint8(32))
    # each text gets a blank on either side, so its first and last letters have trigrams too
    lengths = np.diff(offsets)
    begins = offsets[:-1] + 2 * np.arange(n)
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    padded[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), lengths)] = plain
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = padded.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    row = np.repeat(np.arange(n), lengths + 2)
    blank = padded == 32
    good = ~(blank[:-2] & blank[1:-1] | blank[1:-1] & blank[2:]) & (row[:-2] == row[2:])
    key = (row[:-2][good] << BITS) | bucket[good].astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def vectors(array, idf: np.ndarray):
    """Normalised sparse TF-IDF vectors: (text number, bucket, weight)."""
    row, bucket, count = grams(array)
    weight = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(array)))
    return row, bucket, (weight / np.maximum(norm[row], 1e-12)).astype(np.float32)


def _document_frequency(batches):
    import pyarrow as pa

    total, n = np.zeros(1 << BITS, np.int64), 0
    for part in chunks(batches):
        _, bucket, _ = grams(part.column("text"))
        total += np.bincount(bucket, minlength=1 << BITS)
        n += part.num_rows
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array(np.r_[seen, -1], pa.int32()), "df": pa.array(np.r_[total[seen], n], pa.int64()),
    })


def _cluster(idf: np.ndarray, k: int, rounds: int = 8):
    """Spherical k-means of one language's sample; starts are spread by farthest-first choice."""
    def fit(frame):
        import pandas as pd
        import pyarrow as pa

        frame = frame.sort_values("doc_id", kind="stable")
        row, bucket, weight = vectors(pa.array(frame["text"], pa.string()), idf)
        n = len(frame)
        starts = np.searchsorted(row, np.arange(n + 1))
        dots = lambda c: np.bincount(row, weight * c[bucket], minlength=n)
        mean = np.bincount(bucket, weight, minlength=1 << BITS)
        centres = [mean / max(np.linalg.norm(mean), 1e-12)]
        near = dots(centres[0])
        while len(centres) < min(k, n):
            far = int(np.argsort(near, kind="stable")[min(n - 1, n // 20)])  # not the very farthest: that is junk
            centre = np.zeros(1 << BITS)
            centre[bucket[starts[far]: starts[far + 1]]] = weight[starts[far]: starts[far + 1]]
            centres.append(centre)
            near = np.maximum(near, dots(centre))
        for _ in range(rounds):
            best = np.argmax(np.stack([dots(c) for c in centres]), axis=0)
            for j in range(len(centres)):
                own = best[row] == j
                total = np.bincount(bucket[own], weight[own], minlength=1 << BITS)
                if total.any():
                    centres[j] = total / np.linalg.norm(total)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "vector": [c.astype("<f4").tobytes() for c in centres]})

    return fit


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS_PER_LANGUAGE) -> Centroids:
    """Document frequencies over all training texts; centroids from about ``sample`` documents of each language.

    Training rows need text and lang.  The driver gets one number per bucket (2**15) and ``k`` vectors per language.
    """
    rows = docs.filter(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counted = rows.select("text").mapInArrow(_document_frequency, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    df, n = np.zeros(1 << BITS), 0
    for bucket, count in counted.collect():
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    shares = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(shares), "lang").filter(place < F.col("share")).select("doc_id", "text", "lang")
    found = chosen.groupBy("lang").applyInPandas(_cluster(idf, k), "lang string, vector binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.vector)))
    matrix = [np.frombuffer(r.vector, "<f4") for r in found]
    return Centroids([r.lang for r in found], np.stack(matrix, 1) if matrix else np.zeros((1 << BITS, 0), np.float32), idf)


def predict(docs: DataFrame, model: Centroids, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Rows (doc_id, lang_pred, score, rejected), one for each input row.

    score: cosine with the nearest centroid (0 to 1).  rejected: the text is null, has no letter, or is farther than
    ``reject_below`` from every centroid.  lang_pred is the nearest language also then, and ``und`` for a text that
    is null or has no letter, or if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.vectors, model.idf))

    def label(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        languages, matrix, idf = shared.value
        for part in chunks(batches):
            text = part.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            row, bucket, weight = vectors(text, idf)
            cosine = np.zeros((part.num_rows, max(1, len(languages))))
            for j in range(len(languages)):
                cosine[:, j] = np.bincount(row, weight * matrix[bucket, j], minlength=part.num_rows)
            best = cosine.argmax(1)
            known = lettered & bool(languages)
            score = np.where(known, np.clip(cosine.max(1), 0, 1), 0.0)
            names = [languages[b] if k else NO_LANGUAGE for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(~known | (score < reject_below))],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def keep_known_languages(docs: DataFrame, model: Centroids, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The documents that are not rejected, with all their columns; works row by row, so repeated ids do no harm."""
    columns = docs.columns
    packed = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("text"), F.struct(*columns).alias("_row"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.vectors, model.idf))

    def keep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        languages, matrix, idf = shared.value
        for part in chunks(batches):
            text = part.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            row, bucket, weight = vectors(text, idf)
            top = np.zeros(part.num_rows)
            for j in range(len(languages)):
                top = np.maximum(top, np.bincount(row, weight * matrix[bucket, j], minlength=part.num_rows))
            yield part.filter(pa.array(lettered & bool(languages) & (top >= reject_below)))

    return packed.mapInArrow(keep, packed.schema).select("_row.*")


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = id_mod() == 0
    found = predict(docs, fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op8_language": op8_language}
SQL: dict[str, str] = {}
