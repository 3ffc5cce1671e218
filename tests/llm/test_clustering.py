import hashlib
import random

import numpy as np
import pytest

from threadloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def brute(rows, clusters=8, rounds=10, components=64):
    """Plain Lloyd rounds over Python integers."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == components and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(1024 * float(np.float32(x)))) for x in e]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v: min((square(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [best(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            group = [v for (_, v), o in zip(kept, own) if o == k]
            if group:
                centroids[k] = [sum(x) // len(group) for x in zip(*group)]
    found = [(vec_id, *best(v)) for vec_id, v in kept]
    inertia = {k: sum(d for _, d, o in found if o == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if i is None else i), k, d, inertia[k], sum(inertia.values()), sha[k]) for i, d, k in found)


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "c", 2) for i, e in rows], SCHEMA)


def got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(n, spread, seed=1, components=64):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(components)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_equals_plain_rounds(spark, spread):
    rows = vectors(150, spread)
    assert got(clustering.cluster(table(spark, rows).repartition(7))) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(40, 0.3)
    rows += [(100, None), (101, []), (102, [0.1] * 63), (103, [0.1] * 63 + [None]), (104, [0.1] * 63 + [float("nan")]), (105, [float("inf")] * 64),
             (None, [0.25] * 64), (106, [0.5] * 64), (106, [0.5] * 64), (106, [-0.5] * 64), (107, [0.0] * 64), (108, [0.0] * 64)]
    rows += [(200 + i, [0.125] * 64) for i in range(60)]  # one common vector: starting centroids may be equal
    assert got(clustering.cluster(table(spark, rows))) == brute(rows)


def test_few_and_no_vectors(spark):
    rows = vectors(3, 0.1)
    assert got(clustering.cluster(table(spark, rows))) == brute(rows)
    assert clustering.cluster(table(spark, [(1, None)])).count() == 0
    none = clustering.cluster(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and "centroid_sha256" in none.columns


def test_other_parameters(spark):
    rows = vectors(80, 0.2, components=5)
    out = clustering.cluster(table(spark, rows), clusters=3, rounds=2, components=5)
    assert got(out) == brute(rows, 3, 2, 5)


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="a component times 1024"):
        clustering.cluster(table(spark, [(1, [131072.0] * 64)]))


def test_bounds_never_exceed_distances_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (8, 64))
    v = np.concatenate([c + rng.integers(-90, 90, (200, 64)) for c in centres])
    for pivots in (v[rng.integers(0, len(v), 8)], centres, np.repeat(centres[:2], 4, 0)):
        pairs = clustering.pivot_pairs([len(pivots)])
        args = clustering.squared(v, pivots), clustering.squared(centres, pivots), clustering.squared(pivots, pivots)
        exact = clustering.squared(v, centres)
        assert (clustering.lower_bounds(*args, pairs) <= exact).all()
        cluster, distance, checks = clustering.nearest(v, args[0], centres, args[1], args[2], pairs)
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    args = clustering.squared(v, centres), clustering.squared(centres, centres), clustering.squared(centres, centres)
    assert clustering.nearest(v, args[0], centres, args[1], args[2], clustering.pivot_pairs([8]))[2].mean() < 1.1
