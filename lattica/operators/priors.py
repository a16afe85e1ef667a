"""Precedence priors from layered statements; hosts of unplaced types; agglomeration of classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.sources.shared import held


def build_prior(statements: DataFrame) -> dict[str, DataFrame]:
    """edges (the reduced order), roots, and unrelated pairs from statements (a, b, relation, layer, line).

    The latest layer decides each pair.  A cycle, and a pair said to be unrelated that the other
    statements order, are errors that name the classes.
    """
    said = held(G.layered(statements))
    order = held(said.where("relation = 'precedes'").select("a", "b"))
    unrelated = said.where("relation = 'unrelated'").select("a", "b")
    closed = held(G.reachability(order))
    loop = [r[0] for r in closed.where("a = b").select("a").orderBy("a").limit(5).collect()]
    if loop:
        raise ValueError(f"a cycle through {', '.join(map(str, loop))}")
    both = closed.unionByName(closed.select(F.col("b").alias("a"), F.col("a").alias("b")))
    clash = unrelated.join(both, ["a", "b"], "left_semi").orderBy("a", "b").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0]['a']} and {clash[0]['b']} are said to be unrelated but are ordered")
    between = closed.join(closed.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    roots = order.select(F.col("a").alias("class")).distinct().join(order.select(F.col("b").alias("class")), "class", "left_anti")
    return {"edges": closed.join(between, ["a", "b"], "left_anti"), "roots": roots, "unrelated": unrelated, "closure": closed}


def refuse_statement(prior: dict[str, DataFrame], a: str, b: str, relation: str) -> str | None:
    """Why a new statement isn't taken: it is said already, closes a cycle, or separates an ordered pair."""
    if a == b:
        return "a class cannot precede itself"
    closure = prior["closure"]
    forth = not closure.where((F.col("a") == a) & (F.col("b") == b)).isEmpty()
    back = not closure.where((F.col("a") == b) & (F.col("b") == a)).isEmpty()
    if relation == "unrelated":
        known = not prior["unrelated"].where(((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a))).isEmpty()
        return "already said" if known else "the pair is ordered" if forth or back else None
    return "already said" if forth else "it would close a cycle" if back else None


def hosts(connections: DataFrame, placed: set, medians: dict) -> tuple[dict, list[tuple]]:
    """Each class's host and the inferred edges, from connections (a, b, ratio) between classes.

    A spanning forest of the strongest connections grows from the placed classes and never joins two
    trees that hold one each.  Edges go from the smaller median pseudotime to the larger.  Classes
    are the model's, so their pairs are sorted here.
    """
    rows = sorted(((r["a"], r["b"], r["ratio"]) for r in connections.where("ratio > 0").collect()), key=lambda r: (-r[2], r[0], r[1]))
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    anchor = {x: x for x in placed}
    joined = []
    for a, b, _ in rows:
        x, y = find(a), find(b)
        if x == y or (x in anchor and y in anchor):
            continue
        kept = x if x in anchor else y
        root[y if kept == x else x] = kept
        joined.append((a, b))
    host = {x: anchor.get(find(x)) for x in {y for r in rows for y in r[:2]} | set(placed)}
    late = lambda x: medians.get(x, float("inf"))
    return host, [(a, b) if (late(a), a) <= (late(b), b) else (b, a) for a, b in joined if host[a] is not None]


def average_linkage(names: list[str], distance: np.ndarray) -> list[tuple[float, list[str]]]:
    """Merges (height, members) of the nearest clusters by mean distance; ties go to the earlier ones."""
    clusters = [[i] for i in range(len(names))]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive, merges = list(range(len(names))), []
    while len(alive) > 1:
        part = d[np.ix_(alive, alive)]
        i, j = divmod(int(part.argmin()), len(alive))
        x, y = alive[min(i, j)], alive[max(i, j)]
        n, m = len(clusters[x]), len(clusters[y])
        merges.append((float(d[x, y]), sorted(names[k] for k in clusters[x] + clusters[y])))
        d[x] = d[:, x] = (n * d[x] + m * d[y]) / (n + m)
        d[x, x] = np.inf
        clusters[x] = clusters[x] + clusters[y]
        alive.remove(y)
    return merges


def split_by_linkage(similarity: DataFrame, names: list[str]) -> list[list[str]]:
    """Groups of classes cut in the largest gap of average-linkage heights; similarity is (a, b, similarity), classes of the model."""
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for r in similarity.collect():
        if r["a"] in at and r["b"] in at:
            d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = 1 - r["similarity"]
    merges = average_linkage(names, d)
    heights = [h for h, _ in merges]
    if len(heights) < 2:
        return [[n] for n in names]
    gap = int(np.argmax(np.diff(heights)))
    cut = (heights[gap] + heights[gap + 1]) / 2
    groups = {n: [n] for n in names}
    for height, members in merges:
        if height < cut:
            for n in members:
                groups[n] = members
    return sorted({tuple(g) for g in groups.values()})
