"""Centroid clustering of integer vectors with Ptolemaic pivots."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.checkpoints import stored, tidy

COMPONENTS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: After so many rounds the moved centroids become pivots besides the starting ones.
PIVOT_ROUND = 3
#: Distance in the ring of pivots between the two of a pair.
STRIDES = (1, 2)
#: Larger integers could give a squared distance beyond 63 bits.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v): the vectors with exactly ``components`` finite components, each as integer floor(scale * x)."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    usable = (F.size("embedding") == components) & F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(x * F.lit(float(scale)))
    fits = F.forall(x, lambda x: F.abs(x * F.lit(float(scale))) < LARGEST)
    v = F.when(fits, F.transform(x, lambda x: scaled(x).cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def start_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def pivot_pairs(families: list[int]) -> list[tuple[int, int]]:
    """Fixed pairs inside each family of pivots: every pivot with those ``STRIDES`` further on in its ring."""
    pairs, base = set(), 0
    for size in families:
        pairs |= {tuple(sorted((base + i, base + (i + s) % size))) for i in range(size) for s in STRIDES if s % size}
        base += size
    return sorted(pairs)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances (n x m) of integer points."""
    return np.stack([((a - point) ** 2).sum(1) for point in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


#: More than what the roundings of two roots, two products, a difference and a quotient of doubles can add up to.
SLACK = 2.0 ** -46


def lower_bounds(point_sq: np.ndarray, centroid_sq: np.ndarray, pivot_sq: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Lower bounds (n x k) of squared distances to centroids, by Ptolemy's inequality over pairs of pivots.

    For pivots p and s: d(x, c) d(p, s) >= | d(x, p) d(c, s) - d(x, s) d(c, p) |.  Every step is rounded down, so a
    bound never exceeds the exact distance.
    """
    x, c, p = np.sqrt(point_sq.astype(float)), np.sqrt(centroid_sq.astype(float)), np.sqrt(pivot_sq.astype(float))
    best = np.zeros((len(x), len(c)))
    for a, b in pairs:
        if pivot_sq[a, b] == 0:
            continue
        left, right = x[:, a, None] * c[None, :, b], x[:, b, None] * c[None, :, a]
        np.maximum(best, (np.abs(left - right) - SLACK * (left + right)) / p[a, b], out=best)
    return best * best * (1 - SLACK)


def nearest(v: np.ndarray, point_sq: np.ndarray, centroids: np.ndarray, centroid_sq: np.ndarray, pivot_sq: np.ndarray, pairs) -> tuple:
    """Nearest centroid (ties: smaller number), exact squared distance and number of exact distances, for each row.

    The centroid of the smallest bound is measured first; then only those whose bound does not exceed the best exact
    distance so far.
    """
    low = lower_bounds(point_sq, centroid_sq, pivot_sq, pairs)
    cluster = low.argmin(1)
    distance = ((v - centroids[cluster]) ** 2).sum(1)
    checks = np.ones(len(v), np.int32)
    first = cluster.copy()
    for k in range(len(centroids)):
        at = np.flatnonzero((first != k) & (low[:, k] <= distance * (1 + SLACK)))
        if not len(at):
            continue
        checks[at] += 1
        own = ((v[at] - centroids[k]) ** 2).sum(1)
        better = (own < distance[at]) | ((own == distance[at]) & (k < cluster[at]))
        cluster[at[better]], distance[at[better]] = k, own[better]
    return cluster, distance, checks


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``pivot_sq``: exact squared distances to the pivots, kept in a table for all later rounds."""
    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            d = squared(_matrix(batch.column("v"), pivots.shape[1]), pivots)
            ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], ["vec_id", "v", "pivot_sq"])

    return stored(vectors.select("vec_id", "v").mapInArrow(measure, "vec_id long, v array<int>, pivot_sq array<long>"), "vectors")


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, pairs, sums: bool) -> DataFrame:
    """Rows (vec_id, cluster, distance, checks), or with ``sums`` one row (cluster, n, total) of each cluster of a task."""
    centroid_sq, pivot_sq = squared(centroids, pivots), squared(pivots, pivots)
    k, width = centroids.shape

    def assign(batches):
        import pyarrow as pa

        n, total = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            cluster, distance, checks = nearest(v, _matrix(batch.column("pivot_sq"), len(pivots)), centroids, centroid_sq, pivot_sq, pairs)
            if not sums:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(checks)],
                                                 ["vec_id", "cluster", "distance", "checks"])
                continue
            for own in np.unique(cluster):
                rows = v[cluster == own]
                n[own] += len(rows)
                total[own] += rows.sum(0)
        if sums:
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(n[used]), pa.array([[int(x) for x in total[c]] for c in used], pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return table.mapInArrow(assign, "cluster int, n long, total array<long>" if sums else "vec_id long, cluster int, distance long, checks int")


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, pairs) -> np.ndarray:
    """Centroids after one round.  Tasks send one sum for each cluster; clusters x components sums reach the driver."""
    parts = _assigned(table, centroids, pivots, pairs, True)
    parts = parts.select("cluster", "n", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place")
    moved = centroids.copy()
    for r in parts.agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x")).collect():
        moved[r.cluster, r.place] = int(r.x) // int(r.n)
    return moved


@tidy
def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS,
            scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, cluster, distance, checks, cluster_inertia, inertia, centroid_sha256, centroid), one for each kept vector.

    ``vectors`` has (vec_id, embedding).  Exact Lloyd rounds over integers floor(scale * x): nearest centroid by squared
    distance (ties: smaller number), then floor(sum / count) of each component; an empty centroid stays.  ``checks`` is
    the number of distances that were computed in the last assignment.

    Pivots are the starting centroids and, from round ``PIVOT_ROUND`` on, also the centroids of that round.  Distances
    to pivots are computed once and kept in a table; pairs of pivots bound the distance to every centroid from below,
    and only centroids that the bounds leave are measured exactly.

    Null, short, long or non-finite vectors are left out; a null id counts as the empty text in the starting order,
    vectors of one hash (repeated rows) start in the order of their components and are all counted.  Fewer vectors than
    clusters: as many centroids as vectors.  A component beyond ``LARGEST`` / scale is refused with an error, since its
    squared distance may not fit a long.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, components, scale)
    start = whole.select("v", start_order(F.col("vec_id"), seed).alias("hash")).orderBy("hash", "v").limit(clusters).collect()
    schema = "vec_id long, cluster int, distance long, checks int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.v for r in start], np.int64)
    families = [centroids]
    for number in range(rounds + 1):
        if number in (0, PIVOT_ROUND):
            families = families if number == 0 else [*families, centroids]
            pivots, pairs = np.concatenate(families), pivot_pairs([len(f) for f in families])
            table = _with_pivots(whole if number == 0 else table, pivots)
        if number < rounds:
            centroids = _moved(table, centroids, pivots, pairs)
    found = stored(_assigned(table, centroids, pivots, pairs, False), "assigned")
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    traits = [(k, s, sum(own.values()), digest(centroids[k].tolist()), centroids[k].tolist()) for k, s in own.items()]
    traits = spark.createDataFrame(traits, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(traits), "cluster").select(*[c.split()[0] for c in schema.split(", ")])  # one row a cluster


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    )


def _sql() -> str:
    """The rounds written out, over one row for each component."""
    parts = [f"""
        kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                 WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS}),
        part AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
        c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (
                 SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k FROM kept) WHERE k < {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""
        a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
                 SELECT p.vec_id, c.k, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM part p JOIN c{r} c USING (i) GROUP BY ALL) GROUP BY vec_id)""")
        if r < ROUNDS:
            parts.append(f"""
        s{r} AS MATERIALIZED (SELECT a.k, p.i, sum(p.x)::BIGINT AS s, count(*) AS n FROM part p JOIN a{r} a USING (vec_id) GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (k, i))""")
    return f"""WITH {','.join(parts)},
        h AS (SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY k)
        SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{ROUNDS} JOIN h USING (k)"""


QUERIES = {"op11_clustering": op11_clustering}
SQL = {"op11_clustering": _sql()}
