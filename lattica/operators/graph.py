"""Taxonomies, precedence graphs, neighbour graphs and orderings as DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.sources.shared import held


def closure(edges: DataFrame) -> DataFrame:
    """(id, anc, depth): every term with its ancestors and itself, at the least depth; edges are (child, parent).

    Ways double in length until nothing changes, so the depth has no bound.
    """
    ids = edges.select(F.col("child").alias("id")).unionByName(edges.select(F.col("parent").alias("id"))).distinct()
    one = edges.select(F.col("child").alias("id"), F.col("parent").alias("anc"), F.lit(1).alias("depth")).distinct()
    up = held(ids.select("id", F.col("id").alias("anc"), F.lit(0).alias("depth")).unionByName(one))
    state = (0, 0)
    while True:
        size = up.agg(F.count(F.lit(1)), F.sum("depth")).first()
        if tuple(size) == state:
            return up
        state = tuple(size)
        above = up.select(F.col("id").alias("anc"), F.col("anc").alias("_top"), F.col("depth").alias("_more"))
        up = held(up.join(above, "anc").groupBy("id", F.col("_top").alias("anc")).agg(F.min(F.col("depth") + F.col("_more")).alias("depth")))


def reachability(edges: DataFrame) -> DataFrame:
    """(a, b) pairs joined by a path, cycles allowed: squaring until nothing is added."""
    reach = held(edges.select("a", "b").distinct())
    n = reach.count()
    while True:
        further = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        reach = held(reach.union(further).distinct())
        m = reach.count()
        if m == n:
            return reach
        n = m


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle of statements."""
    return reachability(edges).where("a = b").select(F.col("a").alias("node"))


def reduction(edges: DataFrame) -> DataFrame:
    """Edges of the acyclic closure with no node between their ends."""
    reach = reachability(edges)
    between = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    return reach.join(between, ["a", "b"], "left_anti")


def layered(statements: DataFrame) -> DataFrame:
    """The statement of the latest layer on each unordered pair; within a layer the last line wins."""
    pair = statements.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    by = Window.partitionBy("_x", "_y").orderBy(F.desc("layer"), F.desc("line"))
    return pair.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_x", "_y", "_n")


def common_ancestor(parts: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The deepest ancestor that all parts of a mixed label share: (label, anc); parts are (label, id)."""
    depth = ancestors.groupBy("anc").agg(F.count(F.lit(1)).alias("below"))
    n = parts.groupBy("label").agg(F.countDistinct("id").alias("parts"))
    held = parts.distinct().join(ancestors, "id").groupBy("label", "anc").agg(F.countDistinct("id").alias("held"))
    shared = held.join(n, "label").where("held = parts").join(depth, "anc")
    return shared.groupBy("label").agg(F.min_by("anc", F.struct("below", "anc")).alias("anc"))


def nearest_shared(leaves: DataFrame, ancestors: DataFrame, least: int = 2) -> DataFrame:
    """(id, anc): the nearest proper ancestor that ``least`` leaves or more are under."""
    of = leaves.join(ancestors, "id").where("depth > 0")
    sharers = of.groupBy("anc").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= least)
    return of.join(sharers, "anc").groupBy("id").agg(F.min_by("anc", F.struct("depth", "anc")).alias("anc"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable, by passing least labels and jumping along them."""
    both = held(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    all_nodes = both.select(F.col("x").alias("node")) if nodes is None else nodes.select("node").union(both.select("x"))
    labels = held(all_nodes.distinct().select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("_c"))
        passed = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("component", F.coalesce("_c", "component")).alias("component"))
        jump = passed.select(F.col("node").alias("component"), F.col("component").alias("_j"))
        fresh = held(passed.join(jump, "component", "left").select("node", F.least("component", F.coalesce("_j", "component")).alias("component")))
        same = fresh.join(labels.withColumnRenamed("component", "_old"), "node").where("component != _old").isEmpty()
        labels = fresh
        if same:
            return labels


def lineages(edges: DataFrame) -> DataFrame:
    """(path): every way from a root to a leaf of an acyclic (a, b) graph, steps in order; a cycle below a root is an error."""
    edges = held(edges.select("a", "b").distinct())
    roots = edges.select(F.col("a").alias("node")).distinct().join(edges.select(F.col("b").alias("node")), "node", "left_anti")
    walk = held(roots.select("node", F.array("node").alias("path")))
    inner = edges.select(F.col("a").alias("node")).distinct()
    out = None
    while not walk.isEmpty():
        ended = walk.join(inner, "node", "left_anti").select("path")
        out = held(ended if out is None else out.unionByName(ended))
        further = walk.join(edges, walk["node"] == edges["a"])
        if not further.where(F.array_contains("path", F.col("b"))).isEmpty():
            raise ValueError("the graph has a cycle")
        walk = held(further.select(F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path")))
    return walk.select("path") if out is None else out


def lineage_weights(paths: DataFrame) -> DataFrame:
    """(class, lineage, weight): uniform over the lineages through a class."""
    numbered = paths.select(F.array_join("path", " > ").alias("lineage"), F.explode("path").alias("class"))
    n = F.count(F.lit(1)).over(Window.partitionBy("class"))
    return numbered.select("class", "lineage", (F.lit(1.0) / n).alias("weight"))


def branch_points(paths: DataFrame) -> DataFrame:
    """The last class that two lineages share from their start."""
    p = paths.select("path", F.array_join("path", " > ").alias("l"))
    pairs = p.alias("x").join(p.alias("y"), (F.col("x.path")[0] == F.col("y.path")[0]) & (F.col("x.l") < F.col("y.l")))
    same = F.expr("size(filter(sequence(1, least(size(x.path), size(y.path))), i -> slice(x.path, 1, i) = slice(y.path, 1, i)))")
    return pairs.select(F.element_at("x.path", same).alias("class")).distinct()


# Neighbours ----------------------------------------------------------------------------------


#: Rows of a block that are compared at a time, and pairs whose scores are computed one by one at a time.
ROWS, PAIRS = 128, 50_000
#: Blocks of a side from which on they are widened, and how much at most.
MANY, WIDEST = 8, 4


def _least(rough: np.ndarray, k: int, slack: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k least of each row by (score to twelve decimals, column); what isn't finite goes.

    ``rough`` is within ``slack`` of what orders the scores.  The k-th of the minima of slices bounds a row's k-th
    value, so only what lies below is scored by ``exact`` and sorted.
    """
    n, m = rough.shape
    slices = max(m // max(m // (32 * k), 1), 1)
    low = rough[:, : m // slices * slices].reshape(n, -1, slices).min(axis=1)
    bound = np.partition(low, k - 1, axis=1)[:, k - 1] if slices > k else np.full(n, np.inf)
    close = rough <= (bound + slack)[:, None]
    out, ends = [], np.cumsum(close.sum(axis=1))
    at = 0
    while at < n:  # rows of copies may hold all columns
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        i, j = np.nonzero(close[at:to])
        i = i + at
        score = exact(i, j)
        good = np.isfinite(rough[i, j]) & np.isfinite(score)
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((j, np.round(score, 12), i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[first], j[first], score[first]))
        at = to
    i, j, score = (np.concatenate(c) for c in zip(*out))
    return i, j, score


def _tame(*parts: np.ndarray) -> bool:
    """Whether no product of these can be other than a number."""
    return all(len(p) == 0 or bool(np.abs(p).max() < 1e70) for p in parts)


def _lifted(score: np.ndarray, own: np.ndarray | None, ids: np.ndarray, tame: bool) -> np.ndarray:
    """``score`` with infinity for what isn't a number and, with ``own``, for pairs of a point and itself."""
    if not tame:
        score[np.isnan(score)] = np.inf
    if own is not None:  # ids are sorted
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        end = np.searchsorted(ids, own, side="right")
        for r in np.flatnonzero(ids[at] == own):
            score[r, at[r] : end[r]] = np.inf
    return score


def _blocks(n: int, block: int) -> int:
    """Blocks of a side of n rows.  Each row goes once to every block of the other side, so beyond ``MANY`` blocks they widen up to ``WIDEST`` times."""
    return max(1, min(math.ceil(n / block), max(MANY, math.ceil(n / (WIDEST * block)))))


def _sent(vec: str, near: str, wide: str) -> list[Column]:
    """A vector as it is shuffled: in single precision where that loses nothing."""
    exact = F.forall(vec, lambda x: x.cast("float").cast("double").eqNullSafe(x))
    return [F.when(exact, F.col(vec).cast("array<float>")).alias(near), F.when(~exact, F.col(vec)).alias(wide)]


def _received(near: pd.Series, wide: pd.Series) -> np.ndarray:
    return np.array([w if x is None else x for x, w in zip(near.tolist(), wide.tolist())], float)


def blocked_top_k(queries: DataFrame, keys: DataFrame, k: int, metric: str, block: int = 8192, exclude_self: bool = True) -> DataFrame:
    """(obs, rank, other, score): the k keys of largest cosine or smallest distance; ties go to the smaller key.

    Both sides are dealt into blocks of bounded size; each pair of blocks is one matrix
    product in numpy that keeps k keys a query, and a window ranks what blocks have kept.
    """
    q, n = queries.count(), keys.count()
    q_blocks, k_blocks = _blocks(q, block), _blocks(n, block)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("obs"), F.lit(m)).cast("int")
    left = queries.select(deal(q_blocks).alias("qb"), every(k_blocks).alias("kb"), "obs", *_sent("vec", "near", "wide"))
    right = keys.select(every(q_blocks).alias("q_block"), deal(k_blocks).alias("k_block"), F.col("obs").alias("key"), *_sent("vec", "key_near", "key_wide"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("key", kind="stable")
            y, ids = _received(b["key_near"], b["key_wide"]), b["key"].to_numpy()
            x_all, own_all = _received(a["near"], a["wide"]), a["obs"].to_numpy()
            if metric == "cosine":
                norm = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                x_all, y = norm(x_all), norm(y)
                right, slack = -y.T, 1e-11
            else:  # a row's own square doesn't change its order
                y2 = (y**2).sum(axis=1)
                right = np.vstack([-2 * y.T, y2])
                # The rounding of the product and twelve decimals of a distance, in squares.
                far = np.nanmax((x_all**2).sum(axis=1), initial=0.0) + np.nanmax(y2, initial=0.0)
                slack = 1e-12 * far + 1e-11 * (1 + math.sqrt(far))
            tame = _tame(x_all, y)
            rows = max(1, min(ROWS, ROWS * 8192 // len(b)))  # a slice of products is as large for a wide block
            for at in range(0, len(a), rows):
                x, own = x_all[at : at + rows], own_all[at : at + rows]
                left_rows = x if metric == "cosine" else np.column_stack([x, np.ones(len(x))])
                rough = _lifted(left_rows @ right, own if exclude_self else None, ids, tame)
                if metric == "cosine":
                    i, j, s = _least(rough, k, slack, lambda i, j: -(x[i] * y[j]).sum(axis=1))  # noqa: B023
                    s = -s
                else:
                    i, j, s = _least(rough, k, slack, lambda i, j: np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1)))  # noqa: B023
                out.append(pd.DataFrame({"obs": own[i], "other": ids[j], "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"obs": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})

    met = left.groupBy("qb", "kb").cogroup(right.groupBy("q_block", "k_block")).applyInPandas(compare, "obs long, other long, score double")
    first = F.desc(F.round("score", 12)) if metric == "cosine" else F.round("score", 12)
    by = Window.partitionBy("obs").orderBy(first, "other")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("obs", "rank", "other", "score")


def csls_top_k(points: DataFrame, k: int, hub_k: int, block: int = 8192) -> DataFrame:
    """Top k by 2 cos - r(x) - r(y), r the mean of a point's hub_k best cosines.

    A second pass over the blocks ranks every other point, with r joined to both sides first.
    """
    hubs = blocked_top_k(points, points, hub_k, "cosine", block).groupBy("obs").agg(F.avg("score").alias("r"))
    sides = held(points.join(hubs, "obs"))
    blocks = _blocks(sides.count(), block)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    deal = F.pmod(F.xxhash64("obs"), F.lit(blocks)).cast("int")
    left = sides.select(deal.alias("qb"), every.alias("kb"), "obs", *_sent("vec", "near", "wide"), "r")
    right = sides.select(every.alias("q_block"), deal.alias("k_block"), F.col("obs").alias("key"), *_sent("vec", "key_near", "key_wide"), F.col("r").alias("r_key"))
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("key", kind="stable")
            y, ids, r_y = unit(_received(b["key_near"], b["key_wide"])), b["key"].to_numpy(), b["r_key"].to_numpy()
            x_all, own_all, r_all = unit(_received(a["near"], a["wide"])), a["obs"].to_numpy(), a["r"].to_numpy()
            right, tame = np.vstack([-2 * y.T, r_y]), _tame(x_all, y, r_all, r_y)
            rows = max(1, min(ROWS, ROWS * 8192 // len(b)))  # a slice of products is as large for a wide block
            for at in range(0, len(a), rows):
                x, own, r_x = x_all[at : at + rows], own_all[at : at + rows], r_all[at : at + rows]
                rough = _lifted(np.column_stack([x, np.ones(len(x))]) @ right, own, ids, tame)
                i, j, s = _least(rough, k, 1e-11, lambda i, j: r_x[i] + r_y[j] - 2 * (x[i] * y[j]).sum(axis=1))  # noqa: B023
                out.append(pd.DataFrame({"obs": own[i], "other": ids[j], "csls": -s}))
        return pd.concat(out) if out else pd.DataFrame({"obs": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "csls": pd.Series(dtype=float)})

    met = left.groupBy("qb", "kb").cogroup(right.groupBy("q_block", "k_block")).applyInPandas(compare, "obs long, other long, csls double")
    by = Window.partitionBy("obs").orderBy(F.desc(F.round("csls", 12)), "other")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("obs", "rank", "other", "csls")


def connectivity(knn: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, edges, expected, ratio) between groups of a neighbour graph, both directions together."""
    g = groups.select("obs", "grp")
    ends = knn.select("obs", "other").join(g.withColumnRenamed("grp", "ga"), "obs").join(g.select(F.col("obs").alias("other"), F.col("grp").alias("gb")), "other")
    out = ends.groupBy("ga").agg(F.count(F.lit(1)).alias("e"))
    size = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    per = size.join(out, F.col("grp") == F.col("ga"), "left").select("grp", "n", F.coalesce("e", F.lit(0)).alias("e"))
    between = ends.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"))
    total = size.agg(F.sum("n").alias("total"))
    grid = per.select(*[F.col(c).alias(f"{c}_a") for c in per.columns]).crossJoin(per.select(*[F.col(c).alias(f"{c}_b") for c in per.columns])).where("grp_a < grp_b").crossJoin(total)  # groups by groups
    expected = (F.col("e_a") * F.col("n_b") + F.col("e_b") * F.col("n_a")) / (F.col("total") - 1)
    joined = grid.join(between, (F.col("grp_a") == F.col("a")) & (F.col("grp_b") == F.col("b")), "left").withColumn("edges", F.coalesce("edges", F.lit(0))).withColumn("expected", expected)
    ratio = F.when(F.col("edges") == 0, 0.0).when(F.col("expected") <= 0, 1.0).otherwise(F.least(F.col("edges") / F.col("expected"), F.lit(1.0)))
    return joined.select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"), "edges", "expected", ratio.alias("ratio"))


def edge_verdicts(pairs: DataFrame, prior: DataFrame, least: float = 0.1) -> DataFrame:
    """supported, weak or unsupported edges of the prior; candidates beside it."""
    p = prior.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("in_prior", F.lit(True))
    joined = pairs.join(p, ["a", "b"], "left").withColumn("in_prior", F.coalesce("in_prior", F.lit(False)))
    verdict = F.when(F.col("in_prior") & (F.col("ratio") >= least), "supported").when(F.col("in_prior") & (F.col("ratio") > 0), "weak").when(F.col("in_prior"), "unsupported").when(F.col("ratio") >= least, "candidate")
    return joined.withColumn("verdict", verdict).where("verdict is not null").select("a", "b", "ratio", "in_prior", "verdict")


def gauss_kernel(knn: DataFrame) -> DataFrame:
    """(i, j, w): kernel with each point's median squared distance as bandwidth; mirrored entries take the lister's own value."""
    sigma = knn.groupBy("obs").agg(F.expr("percentile(score * score, 0.5)").alias("s2"))
    s = lambda c: sigma.select(F.col("obs").alias(c), F.col("s2").alias(f"s2_{c}"))
    w = knn.select(F.col("obs").alias("i"), F.col("other").alias("j"), "score").join(s("i"), "i").join(s("j"), "j")
    both = F.col("s2_i") + F.col("s2_j")
    value = F.sqrt(2 * F.sqrt(F.col("s2_i") * F.col("s2_j")) / both) * F.exp(-F.col("score") * F.col("score") / both)
    own = w.select("i", "j", value.alias("w"))
    mirrored = own.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return own.unionByName(mirrored).groupBy("i", "j").agg(F.max("w").alias("w"))


def medoids(points: DataFrame) -> DataFrame:
    """The point of each group with the least summed squared distance to the others (that is, the nearest to their mean)."""
    dims = points.select("grp", F.posexplode("vec").alias("k", "x"))
    mean = dims.groupBy("grp", "k").agg(F.avg("x").alias("m"))
    centre = mean.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))
    joined = points.join(centre, "grp")
    d2 = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    by = Window.partitionBy("grp").orderBy(F.round("d2", 12), "obs")
    return joined.withColumn("d2", d2).withColumn("_n", F.row_number().over(by)).where("_n = 1").select("grp", "obs", "d2")


def balanced_centre(points: DataFrame) -> DataFrame:
    """(k, centre): the mean of the groups' means."""
    dims = points.select("grp", F.posexplode("vec").alias("k", "x"))
    return dims.groupBy("grp", "k").agg(F.avg("x").alias("m")).groupBy("k").agg(F.avg("m").alias("centre"))


def within_covariance(points: DataFrame, dims: int | None = None) -> DataFrame:
    """(i, j, cov), i <= j: pooled within-group covariance, divisor n - groups, over all dimensions or the first ``dims``.

    Each partition sums the outer products of its residuals; only such sums are shuffled.
    """
    x = points.select("obs", "grp", F.slice("vec", 1, dims).alias("vec") if dims else F.col("vec"))
    mean = x.select("grp", F.posexplode("vec").alias("k", "x")).groupBy("grp", "k").agg(F.avg("x").alias("m"))
    centre = mean.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))
    centred = x.join(centre, "grp").select(F.zip_with("vec", "centre", lambda v, c: v - c).alias("r"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                r = np.array(pdf["r"].tolist(), float)
                total = r.T @ r if total is None else total + r.T @ r
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    freedom = points.agg((F.count(F.lit(1)) - F.countDistinct("grp")).alias("f"))
    summed = centred.mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return summed.crossJoin(freedom).select("i", "j", (F.col("s") / F.col("f")).alias("cov"))  # freedom is one row


def module_score_embedding(points: DataFrame, centre: DataFrame, directions: DataFrame) -> DataFrame:
    """(obs, class, score, margin): best class of (vec - centre) . direction and its margin over the runner-up."""
    dims = points.select("obs", F.posexplode("vec").alias("k", "x")).join(centre, "k").select("obs", "k", (F.col("x") - F.col("centre")).alias("x"))
    scores = dims.join(directions, "k").groupBy("obs", "class").agg(F.sum(F.col("x") * F.col("u")).alias("score"))
    by = Window.partitionBy("obs").orderBy(F.desc(F.round("score", 9)), "class")
    ranked = scores.withColumn("_n", F.row_number().over(by)).withColumn("_next", F.lead("score").over(by))
    return ranked.where("_n = 1").select("obs", "class", "score", (F.col("score") - F.col("_next")).alias("margin"))


def order_agreement(times: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, share): the share of b's observations beyond a's median time."""
    middle = times.groupBy("grp").agg(F.expr("percentile(t, 0.5)").alias("m"))
    joined = edges.join(middle.select(F.col("grp").alias("a"), "m"), "a").join(times.select(F.col("grp").alias("b"), "t"), "b")
    return joined.groupBy("a", "b").agg(F.avg((F.col("t") > F.col("m")).cast("double")).alias("share"))


def type_order(times: DataFrame) -> DataFrame:
    q = F.expr("percentile(t, array(0.25, 0.5, 0.75))")
    return times.groupBy("grp").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select("grp", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "n")


def component_facts(values: DataFrame) -> DataFrame:
    """(k, sd, eta2): population deviation of each dimension and the share between groups."""
    total = values.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count(F.lit(1)).alias("n"))
    per = values.groupBy("k", "grp").agg(F.avg("x").alias("mg"), F.count(F.lit(1)).alias("ng"))
    between = per.join(total, "k").groupBy("k", "sd", "n").agg(F.sum(F.col("ng") * (F.col("mg") - F.col("m")) * (F.col("mg") - F.col("m"))).alias("b"))
    return between.select("k", "sd", (F.col("b") / (F.col("n") * F.col("sd") * F.col("sd"))).alias("eta2"))


# Class similarity -----------------------------------------------------------------------------


def weighted_jaccard(panel: DataFrame, idf: DataFrame) -> DataFrame:
    """(a, b, jaccard) of class pairs that share a feature, features weighted by idf."""
    p = panel.join(idf, "feature")
    size = p.groupBy("class").agg(F.sum("idf").alias("w"))
    shared = p.select("feature", "idf", F.col("class").alias("a")).join(p.select("feature", F.col("class").alias("b")), "feature").where("a < b").groupBy("a", "b").agg(F.sum("idf").alias("s"))
    w = lambda c: size.select(F.col("class").alias(c), F.col("w").alias(f"w_{c}"))
    joined = shared.join(w("a"), "a").join(w("b"), "b")
    union = F.col("w_a") + F.col("w_b") - F.col("s")
    return joined.select("a", "b", F.when(union > 0, F.col("s") / union).otherwise(0.0).alias("jaccard"))


def indicator_correlation(panel: DataFrame, n_features: int) -> DataFrame:
    """(a, b, r): absolute correlation of class indicators over the features."""
    size = panel.groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = panel.select("feature", F.col("class").alias("a")).join(panel.select("feature", F.col("class").alias("b")), "feature").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    s = lambda c: size.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"))
    grid = s("a").crossJoin(s("b")).where("a < b").join(both, ["a", "b"], "left")  # classes by classes
    m = float(n_features)
    top = F.coalesce("c", F.lit(0)) * m - F.col("n_a") * F.col("n_b")
    below = F.sqrt(F.col("n_a") * (m - F.col("n_a")) * F.col("n_b") * (m - F.col("n_b")))
    return grid.select("a", "b", F.when(below > 0, F.abs(top / below)).otherwise(0.0).alias("r"))
