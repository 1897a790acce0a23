"""Centroid clustering of vectors by Lloyd's rounds with Elkan's bounds.

Vectors become whole numbers, floor(scale * x), and so do centroids: floor(sum / count). All comparisons that decide an
assignment are of exact squared distances in 64-bit integers. Each vector carries an upper bound of the distance to its
own centroid and a lower bound of the distance to each of the k centroids; a centroid is skipped when these, or half the
distance between two centroids, prove that it is farther. Bounds are floats that are rounded outwards (upper ones up,
lower ones down) and a centroid is skipped only if the proof is strict, so that ties are still seen: the smaller number
wins them.

Vectors with their bounds are a table, written once a round in the shared folder: a round reads it, moves the bounds by
the distances that the centroids have moved, and assigns anew, each row for itself. No vector is shuffled. What a round
sends to the driver is a sum and a count a cluster; what it sends out is k centroids. k times the dimensions is bounded
by MAX_NUMBERS.

Defined cases: a vector of another length, or with a null, NaN or infinite component, is left out; components beyond
LIMIT count as LIMIT, so that squared distances fit 64 bits (sums of them that do not are null); fewer vectors than k
give as many centroids as there are vectors; a null id is clustered, but is no centroid at first; rows with one id are
vectors of their own, and equal first vectors are centroids of their own, of which the first wins; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import cut

#: The largest component, by its amount: DIM * (2 * LIMIT)^2 stays below 2^63 up to 127 dimensions.
LIMIT = 1 << 27
#: k times dimensions: what the driver and each task hold.
MAX_NUMBERS = 1 << 20
#: Rows that are compared at a time.
ROWS = 4096
#: A square root of a 64-bit number and sums of two such are off by less than this part.
SLACK = 1e-12


def whole(vectors: DataFrame, column: str, key: str, dim: int, scale: int) -> DataFrame:
    """key and v (array of whole numbers) of the vectors that count."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias(key), v.alias("v"))


def first_centroids(vectors: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:key, in this order."""
    named = vectors.where(F.col(key).isNotNull())
    best = named.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([r["v"] for r in best.collect()], np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Distances between centroids, rounded down; those of a centroid to itself are infinite."""
    out = np.stack([_down(np.sqrt(squared(centroids, c).astype(np.float64))) for c in centroids]).astype(np.float64)
    np.fill_diagonal(out, np.inf)
    return out


def assign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One round over rows v: the nearest centroid of each, its upper and lower bounds, and how many distances were
    computed. moved: how far each centroid went since the bounds were made, rounded up."""
    own, computed = own.copy(), 0
    half = between(centroids) / 2
    upper = _up(upper.astype(np.float64) + moved[own])
    lower = _down(lower.astype(np.float64) - moved)
    exact = np.full(len(v), -1, np.int64)  # the squared distance to the own centroid, where it is known

    def known(rows: np.ndarray) -> None:
        nonlocal computed
        rows = rows[exact[rows] < 0]
        exact[rows] = squared(v[rows], centroids[own[rows]])
        d = np.sqrt(exact[rows].astype(np.float64))
        upper[rows], lower[rows, own[rows]] = _up(d), _down(d)
        computed += len(rows)

    open_ = np.flatnonzero(~(upper < half.min(1)[own]))
    for c in range(len(centroids)):
        may = lambda r: r[(own[r] != c) & ~(upper[r] < lower[r, c]) & ~(upper[r] < half[own[r], c])]  # noqa: B023, E731
        rows = may(open_)
        known(rows)
        rows = may(rows)
        other = squared(v[rows], centroids[c])
        computed += len(rows)
        d = np.sqrt(other.astype(np.float64))
        lower[rows, c] = _down(d)
        nearer = (other < exact[rows]) | ((other == exact[rows]) & (c < own[rows]))
        won = rows[nearer]
        own[won], exact[won], upper[won] = c, other[nearer], _up(d[nearer])
    return own, upper, lower, computed


STATE = "v array<int>, cluster int, upper float, lower array<float>"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1 if n else 0)


def _rows(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), kind))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _first(centroids: np.ndarray):
    """Before the first round nothing is known: the upper bounds are infinite, the lower ones 0."""

    def run(batches):
        for b in _parts(batches):
            v, n = _matrix(b.column(1), np.int64), b.num_rows
            zero = np.zeros((n, len(centroids)), np.float32)
            own, upper, lower, _ = assign(v, np.zeros(n, np.int32), np.full(n, np.inf, np.float32), zero, centroids, np.zeros(len(centroids)))
            yield _state(b, own, upper, lower)

    return run


def _next(centroids: np.ndarray, moved: np.ndarray):
    def run(batches):
        for b in _parts(batches):
            own, upper = b.column(2).to_numpy(), b.column(3).to_numpy()
            own, upper, lower, _ = assign(_matrix(b.column(1), np.int64), own, upper, _matrix(b.column(4), np.float32), centroids, moved)
            yield _state(b, own, upper, lower)

    return run


def _state(b: pa.RecordBatch, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    columns = [b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(upper), _rows(lower, pa.float32())]
    return pa.RecordBatch.from_arrays(columns, [b.schema.field(0).name, "v", "cluster", "upper", "lower"])


def _distances(centroids: np.ndarray):
    """Exact squared distances to the own centroids."""

    def run(batches):
        for b in _parts(batches):
            d = squared(_matrix(b.column(1), np.int64), centroids[b.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d, pa.int64())], [b.schema.field(0).name, "cluster", "distance"])

    return run


def _sums(k: int, dim: int):
    """Of a task's vectors: count and sums of each cluster."""

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in _parts(batches):
            own, v = b.column(1).to_numpy(), _matrix(b.column(0), np.int64)
            n += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            there, first = np.unique(own[order], return_index=True)
            sums[there] += np.add.reduceat(v[order], first)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), _rows(sums[has], pa.int64())], ["cluster", "n", "s"])

    return run


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; a cluster without vectors keeps its centroid."""
    of_task = state.select("v", "cluster").mapInArrow(_sums(*centroids.shape), "cluster int, n long, s array<long>")
    # a task's sums fit 64 bits, those of all tasks need not
    sums = of_task.select("cluster", "n", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that counts.

    rounds: how often centroids are replaced by their vectors' mean; then vectors are assigned once more.
    """
    if k * dim > MAX_NUMBERS or dim > 127:
        raise ValueError(f"{k} centroids of {dim} numbers are too many")
    kept = whole(vectors, column, key, dim, scale)
    centroids = first_centroids(kept, key, k, seed)
    if not len(centroids):
        # no vector has an id: the first centroid is then the smallest vector
        centroids = np.array([r["v"] for r in kept.orderBy("v").limit(1).select("v").collect()], np.int64)
    if not len(centroids):
        return kept.limit(0).selectExpr(f"`{key}`", "0 AS cluster", *(f"CAST(NULL AS long) AS {c}" for c in ("distance", "cluster_inertia", "inertia")), "'' AS centroid_sha256")
    schema = f"`{key}` long, {STATE}"
    state = cut(kept.mapInArrow(_first(centroids), schema), "round")
    for _ in range(rounds):
        then, centroids = centroids, means(state, centroids)
        moved = np.nextafter(np.sqrt(squared(centroids, then).astype(np.float64)) * (1 + SLACK), np.inf)
        state = cut(state.mapInArrow(_next(centroids, moved), schema), "round")
    out = state.select(key, "v", "cluster").mapInArrow(_distances(centroids), f"`{key}` long, cluster int, distance long")
    found = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(found.values()))
    about = [(c, fits(n), total, _digest(centroids[c])) for c, n in found.items()]
    # k rows at most
    about = vectors.sparkSession.createDataFrame(about, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = out.join(F.broadcast(about), F.col("cluster") == F.col("of"))
    return rows.select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
