"""Exact k-means over integer vectors with Yinyang bounds.

Centroids are put into groups once. A vector keeps its centroid, an upper bound of the distance to it and, for each
group, a lower bound of the distance to the group's other centroids. A round moves the bounds by how far centroids
went; a vector whose upper bound is under all lower bounds keeps its centroid unseen, others look exactly at the
groups whose bound does not clear them. Squared distances are whole numbers, so ties and results are exact; bounds are
rounded away from each other and decide only what need not be looked at.

Vectors and bounds live in a table in the shared folder, one a round; only sums of k x dimensions numbers and the
centroids pass through the driver.

Defined cases. Vectors of another length, null vectors and vectors with a null, NaN or infinite component are left
out. A vector with a component of 2^20 or more in size has squared distances that a long can't hold: it is returned
with null cluster and distance and takes no part in means. A null vec_id hashes as no text. Repeated rows are vectors
of their own; of equal hashes the smaller vector comes first. With fewer vectors than centroids there are as many
centroids as vectors, and no vectors give no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Centroids in a group, on average.
GROUP = 10
WIDE = float(1 << 20)
#: Components under this have dot products of 64 that doubles hold exactly.
_EXACT = 1 << 22
_SLACK, _DRIFT = 1e-12, 1e-9

STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, distance long"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, v (whole numbers, null if too wide) of the vectors that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).where((F.size(e) == dimensions) & ~bad)
    wide = F.exists(e, lambda x: F.abs(x.cast("double")) >= WIDE)
    return kept.select("vec_id", F.when(~wide, F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("int"))).alias("v"))


def first_centroids(numbers: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in the hashes' order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = numbers.where("v IS NOT NULL").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def group_centroids(centroids: np.ndarray, size: int = GROUP) -> np.ndarray:
    """Each centroid's group, by a few rounds of k-means among the centroids."""
    t = max(1, -(-len(centroids) // size))
    points = centroids.astype(float)
    means = points[:t].copy()
    for _ in range(5):
        of = ((points[:, None] - means[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(of):
            means[g] = points[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT and v.shape[1] <= DIMENSIONS:
        x, c = v.astype(float), centroids.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def scan_all(v: np.ndarray, centroids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cluster, upper and lower bounds and squared distance of each row, by looking at all centroids."""
    d = squared(v, centroids)
    cluster = d.argmin(1)  # the first of equals
    at = np.arange(len(v))
    best = d[at, cluster]
    rest = np.sqrt(d.astype(float))
    rest[at, cluster] = np.inf
    lower = np.stack([rest[:, groups == g].min(1) for g in range(groups.max() + 1)], 1) * (1 - _SLACK)
    return cluster, np.sqrt(best.astype(float)) * (1 + _SLACK), lower, best


def scan_some(v, cluster, upper, lower, centroids, groups, moved) -> tuple[np.ndarray, ...]:
    """The same after centroids moved so far, with the bounds of the round before; squared distances are not needed yet."""
    far = moved * (1 + _DRIFT)
    by_group = np.array([far[groups == g].max() for g in range(groups.max() + 1)])
    cluster, upper, lower = cluster.copy(), upper + far[cluster], lower - by_group
    # First filter: all groups at once. An equal bound does not clear, so ties are looked at.
    left = np.flatnonzero(lower.min(1) <= upper)
    if not len(left):
        return cluster, upper, lower
    exact = ((v[left] - centroids[cluster[left]]) ** 2).sum(1)
    upper[left] = np.sqrt(exact.astype(float)) * (1 + _SLACK)
    again = lower[left].min(1) <= upper[left]
    left, exact = left[again], exact[again]
    best, who, start = exact.copy(), cluster[left].copy(), cluster[left].copy()
    seconds = lower[left]
    # Second filter: groups one by one, against the best so far.
    for g in range(lower.shape[1]):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(seconds[:, g] <= np.sqrt(best.astype(float)) * (1 + _SLACK))
        if not len(rows):
            continue
        d = squared(v[left[rows]], centroids[members])
        place = d.argmin(1)
        found, number = d[np.arange(len(rows)), place], members[place]
        better = (found < best[rows]) | ((found == best[rows]) & (number < who[rows]))
        # A centroid that loses its place is one of its group's others from now on.
        loser, lost = who[rows[better]], best[rows[better]]
        seconds[rows, g] = np.inf
        who[rows[better]], best[rows[better]] = number[better], found[better]
        roots = np.sqrt(d.astype(float)) * (1 - _SLACK)
        roots[members[None, :] == who[rows][:, None]] = np.inf
        seconds[rows, g] = roots.min(1)
        np.minimum.at(seconds, (rows[better], groups[loser]), np.sqrt(lost.astype(float)) * (1 - _SLACK))
    cluster[left], lower[left] = who, seconds
    upper[left] = np.sqrt(best.astype(float)) * (1 + _SLACK)
    return cluster, upper, lower


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _batch(ids: pa.Array, v: pa.Array, cluster, upper, lower, distance) -> pa.RecordBatch:
    n, t = lower.shape
    bounds = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * t), pa.array(lower.ravel()))
    return pa.RecordBatch.from_arrays(
        [ids, v, pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, pa.array(distance)], ["vec_id", "v", "cluster", "upper", "lower", "distance"]
    )


def assign(table: DataFrame, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray | None, exact: bool) -> DataFrame:
    """Vectors with their clusters and bounds; `moved` is null in the first round; `exact` asks for squared distances."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), np.int64)
            if moved is None:
                cluster, upper, lower, d = scan_all(v, centroids, groups)
            else:
                before = (b.column("cluster").to_numpy(), b.column("upper").to_numpy(), _matrix(b.column("lower"), float))
                cluster, upper, lower = scan_some(v, *before, centroids, groups, moved)
                d = ((v - centroids[cluster]) ** 2).sum(1) if exact else np.zeros(len(v), np.int64)
            yield _batch(b.column("vec_id"), b.column("v"), cluster, upper, lower, d)

    return table.mapInArrow(step, STATE)


def sums(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of each cluster's components, as Python's whole numbers, and its vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for b in batches:
            cluster = b.column("cluster").to_numpy()
            np.add.at(n, cluster, 1)
            v, order = _matrix(b.column("v"), np.int64), np.argsort(cluster, kind="stable")
            if len(order):
                kinds, first = np.unique(cluster[order], return_index=True)
                total[kinds] += np.add.reduceat(v[order], first)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dimensions).astype(np.int32)), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(some))), pa.array(total[some].ravel()), pa.array(np.repeat(n[some], dimensions))],
            ["cluster", "dim", "total", "n"],
        )

    parts = state.select("cluster", "v").mapInArrow(part, "cluster int, dim int, total long, n long")
    rows = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    total, n = np.zeros((k, dimensions), object), np.zeros(k, object)
    for r in rows:
        total[r["cluster"], r["dim"]], n[r["cluster"]] = int(r["total"]), r["n"]
    return total, n


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia and centroid_sha256 of each vector."""
    spark = vectors.sparkSession
    numbers = save(integers(vectors, dimensions), "yinyang-vectors")
    centroids = first_centroids(numbers, k, seed)
    if not len(centroids):
        return numbers.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    groups = group_centroids(centroids)
    state, moved = numbers.where("v IS NOT NULL"), None
    for i in range(rounds + 1):
        before, state = state, save(assign(state, centroids, groups, moved, exact=i == rounds), "yinyang-state")
        drop(before)
        if i < rounds:
            total, n = sums(state, len(centroids), dimensions)
            after = np.array([[int(x) // n[j] for x in total[j]] if n[j] else centroids[j] for j in range(len(centroids))], np.int64)
            moved = np.sqrt(((after - centroids).astype(float) ** 2).sum(1))
            centroids = after
    shares = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in shares}
    in_long = lambda x: x if x < 1 << 63 else None
    facts = [(j, in_long(inertia.get(j, 0)), in_long(sum(inertia.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("vec_id", "cluster", "distance").unionByName(numbers.where("v IS NULL").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")))
    return found.join(F.broadcast(small), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
