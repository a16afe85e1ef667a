"""Exact centroid clustering with Yinyang's grouped bounds.

Lloyd's rounds over integer vectors.  The centroids are clustered into groups once; each vector
keeps an upper bound on the distance to its own centroid and, per group, one lower bound on the
distance to the group's other centroids.  When centroids move, a vector whose upper bound stays
below all its lower bounds is left alone (global filter), one that doesn't meets the groups whose
bound fails (group filter), and only the centroids of those are measured, exactly.  Bounds are used
strictly and with a margin for rounding, so results, ties included, are those of a full scan.

The vectors with their bounds are a table that each round writes anew in the shared folder; sums
come from the vectors that moved alone, added up by partition, then by (cluster, component).  To the
driver come clusters x components numbers, a bound that the parameters set.

Defined cases: vectors with another number of components, or with null or non-finite ones, take no
part, nor do those with a component so large (2.9 million for 64 components) that a squared distance
needn't fit 64 bits.  Repeated rows are vectors of their own.  A row without an identifier is clustered but starts no
centroid.  With fewer vectors than clusters each starts one; equal starts are ties, which the smaller
number wins.  Sums beyond 64 bits are null.  An empty table gives no rows.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable

#: Centroids of one group, on average.
GROUP_SIZE = 4
#: Share of a distance by which a bound must hold to be trusted.
MARGIN = 1e-9

STATE = "vec_id long, v array<int>, previous int, cluster int, upper double, lower array<double>"


def reach(dimension: int) -> int:
    """The largest component at which every squared distance fits 63 bits."""
    return math.isqrt((2**63 - 1) // dimension) // 2


def quantized(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """vec_id and v = floor(scale * vector) of the rows of (vec_id, vector) that take part."""
    most = F.lit(float(reach(dimension)))
    scaled = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("vector").cast("array<double>"), lambda x: F.lit(float(scale)) * x).alias("x"))
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    kept = scaled.where(F.coalesce((F.size("x") == dimension) & fits, F.lit(False)))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"))


def starts(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The first centroids: the vectors whose ``seed:vec_id`` has the smallest SHA-256."""
    named = vectors.where("vec_id is not null")
    hashed = named.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(clusters).collect()], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if x.shape[1] * (2 * float(most)) ** 2 < 2**53:  # every step of the product is exact in doubles
        f, g = x.astype(float), c.astype(float)
        return ((f**2).sum(axis=1)[:, None] + (g**2).sum(axis=1) - 2 * f @ g.T).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def own_squares(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - c[cluster]) ** 2).sum(axis=1)


def grouped(centroids: np.ndarray, size: int = GROUP_SIZE) -> np.ndarray:
    """The group of each centroid: five rounds of clustering among the centroids, from evenly spaced ones."""
    n = max(1, math.ceil(len(centroids) / size))
    c = centroids.astype(float)
    means = c[np.arange(n) * len(c) // n]
    for _ in range(5):
        group = ((c[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([c[group == g].mean(axis=0) if (group == g).any() else means[g] for g in range(n)])
    return np.unique(group, return_inverse=True)[1]


def advance(x: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(cluster, upper, lower, distances measured) for centroids ``c`` that moved by ``drift``.

    A negative cluster is one not yet known; such vectors meet all groups.
    """
    groups = group.max() + 1
    known = cluster >= 0
    old = np.where(known, cluster, 0)
    lower = lower - np.array([drift[group == g].max() for g in range(groups)])
    upper = np.where(known, upper + drift[old], np.inf)
    fails = lambda bound, of: bound <= of * (1 + MARGIN) + MARGIN
    open_ = np.flatnonzero(fails(lower.min(axis=1), upper))
    measured = len(open_)
    tight = own_squares(x[open_], c, old[open_])
    upper[open_] = np.sqrt(tight)
    still = fails(lower[open_].min(axis=1), upper[open_]) | ~known[open_]
    open_, tight = open_[still], tight[still]  # what the global filter lets through
    x, own = x[open_], old[open_]
    best, best_square = own.copy(), tight.copy()
    scanned = fails(lower[open_], upper[open_][:, None]) | ~known[open_][:, None]
    found = []
    for g in range(groups):
        rows, members = np.flatnonzero(scanned[:, g]), np.flatnonzero(group == g)
        far = squares(x[rows], c[members])
        measured += far.size
        first = far.argmin(axis=1)  # the smallest number of equals, as members ascend
        number, square = members[first], far[np.arange(len(rows)), first]
        wins = (square < best_square[rows]) | ((square == best_square[rows]) & (number < best[rows]))
        best[rows[wins]], best_square[rows[wins]] = number[wins], square[wins]
        found.append((rows, members, far))
    for g, (rows, members, far) in enumerate(found):
        others = np.where(members == best[rows][:, None], np.inf, np.sqrt(far))
        lower[open_[rows], g] = others.min(axis=1)
    left = np.flatnonzero((best != own) & ~scanned[np.arange(len(own)), group[own]])
    at = open_[left], group[own[left]]
    lower[at] = np.minimum(lower[at], np.sqrt(tight[left]))
    cluster = cluster.copy()
    cluster[open_], upper[open_] = best, np.sqrt(best_square)
    return cluster, upper, lower, measured


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _stepped(state: DataFrame, c: np.ndarray, group: np.ndarray, drift: np.ndarray) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b["v"], "int64")
            old = b["cluster"].to_numpy()
            cluster, upper, lower, _ = advance(x, c, group, drift, old, b["upper"].to_numpy(), _matrix(b["lower"], "float64"))
            columns = [b["vec_id"], b["v"], pa.array(old, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "previous", "cluster", "upper", "lower"])

    return state.mapInArrow(step, STATE)


def _moved(state: DataFrame, clusters: int, dimension: int) -> tuple[np.ndarray, list[list[int]]]:
    """By how much the counts and the component sums of clusters change by the vectors that moved."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dimension), np.int64)
        for b in batches:
            x, new, old = _matrix(b["v"], "int64"), b["cluster"].to_numpy(), b["previous"].to_numpy()
            for cluster, sign in ((new, 1), (old, -1)):
                some = np.flatnonzero(cluster >= 0)
                if len(some):
                    np.add.at(n, cluster[some], sign)
                    np.add.at(sums, cluster[some], sign * x[some])
        used = np.flatnonzero(n | sums.any(axis=1))
        values = np.concatenate([n[used, None], sums[used]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), _lists(values, pa.int64())], ["cluster", "sums"])

    parts = state.where("cluster <> previous").select("v", "previous", "cluster").mapInArrow(partial, "cluster int, sums array<long>")
    whole = parts.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    counts, sums = np.zeros(clusters, np.int64), [[0] * dimension for _ in range(clusters)]
    for r in whole.collect():  # clusters x (components + 1) rows at most
        if r["i"] == 0:
            counts[r["cluster"]] = int(r["s"])
        else:
            sums[r["cluster"]][r["i"] - 1] = int(r["s"])
    return counts, sums


def cluster(rows: DataFrame, clusters: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the vectors of ``rows`` (vec_id, vector), and the final centroids.

    The distance is squared and that of vectors scaled by ``scale`` and floored.
    """
    spark = rows.sparkSession
    vectors = quantized(rows, dimension, scale)
    c = starts(vectors, clusters, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), c
    group = grouped(c)
    unknown = F.lit(-1).cast("int")
    state = vectors.select(
        "vec_id", "v", unknown.alias("previous"), unknown.alias("cluster"), F.lit(0.0).alias("upper"), F.array_repeat(F.lit(0.0), int(group.max()) + 1).alias("lower")
    )
    drift = np.zeros(len(c))
    counts, sums = np.zeros(len(c), np.int64), [[0] * dimension for _ in c]
    for _ in range(rounds):
        state = durable(_stepped(state, c, group, drift))
        more, added = _moved(state, len(c), dimension)
        counts = counts + more
        sums = [[s + t for s, t in zip(a, b)] for a, b in zip(sums, added)]
        means = [[s // int(n) for s in total] if n else list(map(int, own)) for total, n, own in zip(sums, counts, c)]
        moved = np.array(means, np.int64)
        drift, c = np.sqrt(((moved - c) ** 2).sum(axis=1).astype(float)), moved

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            square = own_squares(_matrix(b["v"], "int64"), c, b["cluster"].to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["cluster"], pa.array(square, pa.int64())], ["vec_id", "cluster", "distance"])

    last = _stepped(state, c, group, drift).select("vec_id", "v", "cluster")
    return durable(last.mapInArrow(distances, "vec_id long, cluster int, distance long")), c


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sums of distances of its cluster and of all, and its centroid's digest.

    The side that is broadcast has one row a cluster.
    """
    spark = assigned.sparkSession
    if not len(centroids):
        return assigned.selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    whole = sums.agg(F.sum("s").alias("all"))
    facts = sums.crossJoin(F.broadcast(whole)).select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"))
    facts = facts.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
