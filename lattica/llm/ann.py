"""Approximate nearest neighbours with learned partitions.

1. A bounded sample (``SAMPLE`` rows of the least hash) gives an exact neighbour graph, which
   is cut into balanced parts: a tree of median splits along principal directions begins, and
   rounds of moves to the part that holds most neighbours refine, none past its capacity.
2. A small network learns which parts hold a vector's neighbours; the number of parts a query
   visits is the least that reaches ``WANTED_RECALL`` on sample queries.
3. Every row of the table is indexed in its most probable part.  Queries visit their most
   probable parts, in blocks of bounded size on both sides, and exact distances in double
   precision on the original vectors rank what they meet.

Equal vectors in a block are kept up to the k + 1 smallest identifiers: no query can need
more, so a vector that a large part of all rows shares costs little.  Repeated rows are one
row of the index, and a query's places in a block go to different identifiers, each at the
least distance of its vectors: copies push no neighbour out.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have
another dimension than the sample's most common one take no part, neither do rows without an
identifier; a query identifier that repeats is searched once, with the least of its vectors,
and all rows with the query's identifier are its own; repeated candidates of one identifier
count once; an empty table gives an empty result; with few candidates all of them are given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import durable

SAMPLE, PARTS, NEIGHBOURS, HIDDEN, WANTED_RECALL = 8_192, 32, 10, 128, 0.95
#: Rows and queries that one task compares at once.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Positions of the k nearest rows of each query, nearest first."""
    square = (rows**2).sum(axis=1)
    out = []
    for at in range(0, len(queries), block):
        far = square - 2 * queries[at : at + block] @ rows.T
        few = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(few, np.take_along_axis(far, few, 1).argsort(axis=1, kind="stable"), 1))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each node of the neighbour graph; no part exceeds its share by more than ``slack``."""
    n = len(x)
    part = np.zeros(n, np.int64)

    def split(at: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[at] = first
            return
        centred = x[at] - x[at].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = np.argsort(centred @ direction, kind="stable")
        half = len(at) * (count // 2) // count
        split(at[order[:half]], first, count // 2)
        split(at[order[half:]], first + count // 2, count - count // 2)

    split(np.arange(n), 0, parts)
    most = math.ceil(slack * n / parts)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        own = votes[np.arange(n), part]
        best = votes.argmax(axis=1)
        gain = votes.max(axis=1) - own
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[best[i]] < most and size[part[i]] > 1:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < n / 200:
            break
    return part


@dataclass
class Router:
    """Scales vectors and gives the log-odds of each part; ``probes`` parts are visited."""

    mean: np.ndarray
    scale: float
    weights: list[np.ndarray]
    probes: int

    @property
    def dimension(self) -> int:
        return len(self.mean)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def ranked(self, x: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :count]


def learn(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = 30, batch: int = 256, rate: float = 3e-3) -> Router:
    """One hidden layer, trained by Adam to give the shares of neighbours in each part."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    z = (x - mean) / scale
    d, parts = z.shape[1], target.shape[1]
    w = [rng.normal(0, math.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            rows = order[at : at + batch]
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            ds = (p - target[rows]) / len(rows)
            dh = (ds @ w[2].T) * (h > 0)
            step += 1
            slow = rate * (1 - epoch / epochs)
            for i, g in enumerate([z[rows].T @ dh, dh.sum(axis=0), h.T @ ds, ds.sum(axis=0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - slow * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, w, parts)


def fit(x: np.ndarray, parts: int = PARTS, k: int = NEIGHBOURS, wanted: float = WANTED_RECALL) -> Router:
    """A router for vectors like the sample's; equal vectors are one node of the graph."""
    x = np.unique(x, axis=0)
    parts = max(1, min(parts, len(x) // (4 * k)))
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros(d), 1.0, [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    found = nearest(x, x, k + 1)
    own = found == np.arange(len(x))[:, None]
    own[~own.any(axis=1), -1] = True  # equal vectors may push a row out of its own list
    graph = found[~own].reshape(len(x), k)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1 / (k + 1))
    target[np.arange(len(x)), part] += 1 / (k + 1)
    router = learn(x, target)
    home = router.ranked(x, 1)[:, 0]
    queries = np.arange(0, len(x), max(1, len(x) // 1000))
    place = np.argsort(router.ranked(x[queries], parts), axis=1)  # the visit at which each part comes
    visit = np.take_along_axis(place, home[graph[queries]], axis=1)
    recall = [(visit < m).mean() for m in range(1, parts + 1)]
    router.probes = 1 + next(m for m, r in enumerate(recall) if r >= wanted)
    return router


def usable(vector: Column) -> Column:
    bound = 1.7976931348623157e308
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= bound))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _compare(k: int):
    def compare(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(queries):
            x = _stack(rows["vector"])
            order = np.lexsort([rows["vec_id"].to_numpy(), *x.T])
            x, ids = x[order], rows["vec_id"].to_numpy()[order]
            changes = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
            since = np.arange(len(x)) - np.maximum.accumulate(np.where(changes, np.arange(len(x)), 0))
            keep = since <= k
            x, ids = x[keep], ids[keep]
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            square = (x**2).sum(axis=1)
            q, q_ids = _stack(queries["vector"]), queries["query_id"].to_numpy()
            for at in range(0, len(q), 128):
                some, some_ids = q[at : at + 128], q_ids[at : at + 128]
                far = np.maximum(square + (some**2).sum(axis=1)[:, None] - 2 * some @ x.T, 0)
                far[some_ids[:, None] == ids] = np.inf
                least = far if len(starts) == len(ids) else np.minimum.reduceat(far, starts, axis=1)  # of each identifier
                last = min(k, len(starts)) - 1
                bar = np.partition(least, last, axis=1)[:, last]
                # All that rounding could put among the k nearest are measured exactly.
                near = (far <= (bar + 1e-9 * (bar + square.max() + 1e-300))[:, None]) & np.isfinite(far)
                i, j = np.nonzero(near)
                score = np.sqrt(((some[i] - x[j]) ** 2).sum(axis=1))
                if len(starts) < len(ids):
                    best = np.lexsort([score, ids[j], i])
                    i, j, score = i[best], j[best], score[best]
                    first = np.r_[True, (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]])] if len(i) else np.zeros(0, bool)
                    i, j, score = i[first], j[first], score[first]
                best = np.lexsort([ids[j], score, i])
                i, j, score = i[best], j[best], score[best]
                begins = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
                rank = np.arange(len(i)) - np.maximum.accumulate(np.where(begins, np.arange(len(i)), 0)) if len(i) else i
                few = rank < k
                out.append(pd.DataFrame({"query_id": some_ids[i[few]], "vec_id": ids[j[few]], "score": score[few]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})

    return compare


def search(rows: DataFrame, is_query: Column, k: int = NEIGHBOURS, sample: int = SAMPLE, parts: int = PARTS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row of ``rows`` (vec_id, vector) that is a query."""
    spark = rows.sparkSession
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), is_query.alias("_query"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id", "vector").agg(F.max("_query").alias("_query"))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).select("vector").toPandas()["vector"].tolist()
    schema = "query_id long, rank int, vec_id long, score double"
    if not chosen:
        return spark.createDataFrame([], schema)
    lengths = np.array([len(v) for v in chosen])
    dimension = int(np.bincount(lengths).argmax())
    router = fit(np.array([v for v in chosen if len(v) == dimension], float), parts, k)

    @F.pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(router.ranked(_stack(batch), 1)[:, 0].astype("int32") if len(batch) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def visits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(router.ranked(_stack(batch), router.probes).astype("int32")) if len(batch) else [], dtype=object)

    index = durable(vectors.where(F.size("vector") == dimension).withColumn("part", home("vector")))
    sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("_query").alias("q")).agg(F.max("n"), F.sum("q")).first()
    row_blocks = math.ceil((sizes[0] or 1) / block_rows)
    query_blocks = math.ceil((sizes[1] or 1) / block_queries)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = index.select("part", block("vec_id", row_blocks).alias("rb"), every(query_blocks).alias("qb"), "vec_id", "vector")
    queries = index.where("_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sent = queries.select(F.col("vec_id").alias("query_id"), "vector", F.explode(visits("vector")).alias("part"))
    sent = sent.select("part", every(row_blocks).alias("rb"), block("query_id", query_blocks).alias("qb"), "query_id", "vector")
    key = ["part", "rb", "qb"]
    met = cells.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
