import hashlib

import numpy as np
import pytest

from cloakwork.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster string, of int"


def brute(rows, dim, k, rounds, scale):
    """Whole rounds in whole numbers of any size: every vector against every centroid."""
    kept = [(i, [int(np.floor(x * scale)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            if mine := [v for (_, v), o in zip(kept, own) if o == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, c := nearest(v), far(v, centroids[c])) for i, v in kept]
    sums = {c: sum(d for _, o, d in out if o == c) for c in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    key = lambda r: (r[0] is None, r)
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest[c]) for i, c, d in out), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", "y", 2) for i, e in rows], SCHEMA)


def collected(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def blobs(seed, n, dim, centers, spread):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (centers, dim))
    return [(i, [float(x) for x in middle[i % centers] + r.normal(0, spread, dim)]) for i in range(n)]


@pytest.mark.parametrize("centers,spread", [(5, 0.05), (12, 0.5), (1, 1.0)])
def test_equals_brute_force(spark, centers, spread):
    rows = blobs(centers, 400, 8, centers, spread)
    got = clusters.cluster(rows_of(spark, rows).repartition(7), dim=8, k=6, rounds=3, scale=64)
    assert collected(got) == brute(rows, 8, 6, 3, 64)


def test_ties_and_copies(spark):
    r = np.random.default_rng(1)  # few places, so that equal distances and equal centroids are common
    rows = [(i, [float(x) for x in r.integers(-1, 2, 3)]) for i in range(300)] + [(5, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    got = clusters.cluster(rows_of(spark, rows), dim=3, k=7, rounds=3, scale=2)
    assert collected(got) == brute(rows, 3, 7, 3, 2)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [-0.001, 0.5]), (None, [0.25, 0.25]), (7, [1.0, 2.0])]
    got = clusters.cluster(rows_of(spark, rows), dim=2, k=16, scale=64)
    assert collected(got) == brute(rows, 2, 16, 3, 64)
    assert clusters.cluster(rows_of(spark, rows[:6]), dim=2).count() == 0
    assert clusters.cluster(rows_of(spark, []), dim=2).count() == 0
    only = clusters.cluster(rows_of(spark, [(None, [0.25, 0.25])] * 3), dim=2).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in only] == [(None, 0, 0)] * 3


def test_components_beyond_the_limit_count_as_the_limit(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [float(clusters.LIMIT), 0.0])]
    got = clusters.cluster(rows_of(spark, rows), dim=2, k=1, rounds=1, scale=1).collect()
    most, mean = clusters.LIMIT, clusters.LIMIT // 3
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(1, (most - mean) ** 2), (2, (most + mean) ** 2), (3, (most - mean) ** 2)]


def test_bounds_are_never_crossed_and_skip_work():
    r = np.random.default_rng(4)
    v = np.concatenate([r.integers(-50, 50, (1, 16)) + r.integers(-6, 7, (500, 16)) for _ in range(8)]).astype(np.int64)
    centroids = v[r.choice(len(v), 8, replace=False)]
    own, upper, lower = np.zeros(len(v), np.int32), np.full(len(v), np.inf, np.float32), np.zeros((len(v), 8), np.float32)
    moved, total = np.zeros(8), 0
    for _ in range(6):
        own, upper, lower, computed = clusters.assign(v, own, upper, lower, centroids, moved)
        true = np.stack([clusters.squared(v, c) for c in centroids], 1)
        assert (own == true.argmin(1)).all()
        d = np.sqrt(true.astype(np.longdouble))
        assert (upper >= d[np.arange(len(v)), own]).all() and (lower <= d).all()
        total += computed
        then = centroids
        centroids = np.stack([v[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else then[c] for c in range(8)])
        moved = np.nextafter(np.sqrt(clusters.squared(centroids, then).astype(float)) * (1 + clusters.SLACK), np.inf)
    assert total < 0.5 * 6 * v.shape[0] * 8


def test_same_rows_whatever_the_partitions(spark):
    rows = rows_of(spark, blobs(9, 200, 4, 3, 0.3))
    one, many = (collected(clusters.cluster(rows.repartition(n), dim=4, k=5)) for n in (1, 23))
    assert one == many


def test_no_vector_is_shuffled(spark):
    state = spark.createDataFrame([(1, [1, 2], 0, 0.0, [0.0])], f"vec_id long, {clusters.STATE}")
    assert clusters.means(state, np.array([[0, 0]], np.int64)).tolist() == [[1, 2]]
    plan = clusters.whole(rows_of(spark, []), "embedding", "vec_id", 2, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
