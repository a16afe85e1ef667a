"""Communities: planted ones come back, whatever the partitions; parts are connected; moves only add quality."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import communities as C


def planted(groups=8, size=25, inside=0.4, across=0.01, seed=0):
    """(edges, group of each node): dense groups with a few edges between them."""
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(groups), size)
    i, j = np.triu_indices(len(of), 1)
    keep = rng.random(len(i)) < np.where(of[i] == of[j], inside, across)
    return [(int(a), int(b), 1.0) for a, b in zip(i[keep], j[keep])], of


def labels(df):
    return {r.node: r.label for r in df.collect()}


def as_sets(found):
    out = {}
    for node, label in found.items():
        out.setdefault(label, set()).add(node)
    return set(map(frozenset, out.values()))


@pytest.mark.parametrize("most", [C.TASK_EDGES, 40])
def test_planted_communities_come_back_whatever_the_partitions(spark, monkeypatch, most):
    monkeypatch.setattr(C, "TASK_EDGES", most)  # in one task, and by rounds over tables
    edges, of = planted(groups=6, size=12, inside=0.6)
    want = {frozenset(np.flatnonzero(of == g).tolist()) for g in range(6)}
    frame = spark.createDataFrame(edges, "a long, b long, weight double")
    first = labels(C.communities(frame.repartition(1)))
    assert as_sets(first) == want and all(label == min(s) for s in as_sets(first) for label in {first[x] for x in s})
    turned = frame.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight").repartition(7, "b")
    assert labels(C.communities(turned)) == first


def test_one_task_leaves_no_gain_and_merges_nothing_apart():
    for seed in range(30):
        edges, of = planted(groups=4, size=8, inside=0.5, across=0.15, seed=seed)
        rate = int((0.1 + seed / 50) * C.WEIGHT_UNIT * C.RESOLUTION_UNIT)
        nodes = pd.DataFrame({"node": np.arange(32), "size": 1, "comm": np.arange(32)})
        both = pd.DataFrame([(i, j, C.WEIGHT_UNIT) for a, b, _ in edges for i, j in ((a, b), (b, a))], columns=["i", "j", "w"])
        comm = dict(C.in_one_task(nodes, both, rate).itertuples(index=False))
        found = quality(edges, comm, rate)
        assert found >= quality(edges, {k: k for k in comm}, rate)
        groups = set(comm.values())
        for x in groups:  # joining whole communities gains nothing
            for y in groups - {x}:
                assert quality(edges, {k: y if c == x else c for k, c in comm.items()}, rate) <= found


def test_two_cliques_on_a_bridge_and_nodes_without_edges(spark):
    clique = lambda nodes: [(a, b, 1.0) for a in nodes for b in nodes if a < b]
    edges = clique(range(6)) + clique(range(10, 16)) + [(5, 10, 0.5), (5, 5, 9.0), (1, 2, None), (0, 99, 3.0), (3, 4, -1.0)]
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 16), 50, 51, None, 50]], "node long")
    got = labels(C.communities(spark.createDataFrame(edges, "a long, b long, weight double"), nodes, smallest=2))
    assert got == {**dict.fromkeys(range(6), 0), **dict.fromkeys(range(10, 16), 10), 50: None, 51: None}
    empty = spark.createDataFrame([], "a long, b long, weight double")
    assert labels(C.communities(empty)) == {} and labels(C.communities(empty, nodes.where("node = 50"))) == {50: 50}


def test_a_number_of_communities_is_searched(spark):
    edges, of = planted(groups=4, size=12, inside=0.9, across=0.05, seed=1)
    frame = spark.createDataFrame(edges, "a long, b long, weight double")
    assert len(set(labels(C.communities(frame, wanted=1, tries=3)).values())) == 1
    assert len(set(labels(C.communities(frame, wanted=4, tries=3)).values())) == 4


def quality(edges, comm, rate):
    """Twice the quality, in 2^-60ths."""
    size, total = {}, 0
    for c in comm.values():
        size[c] = size.get(c, 0) + 1
    for a, b, w in edges:
        if comm[a] == comm[b]:
            total += 2 * int(w * C.WEIGHT_UNIT) * C.RESOLUTION_UNIT
    return total - rate * sum(n * (n - 1) for n in size.values())


@pytest.mark.parametrize("seed", [2, 3])
def test_quality_is_exact_and_no_node_gains_by_a_move(spark, seed):
    edges, of = planted(groups=5, size=10, inside=0.5, across=0.1, seed=seed)
    graph = C.held(C.undirected(spark.createDataFrame(edges, "a long, b long, weight double")))
    rate = int(0.2 * C.WEIGHT_UNIT * C.RESOLUTION_UNIT)
    start = spark.range(len(of)).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"), (F.col("id") * 4096).alias("comm"))
    moved, found = C.local_moves(graph, start, rate)
    comm = {r.node: r.comm for r in moved.collect()}
    assert found == quality(edges, comm, rate)
    for node in comm:
        for to in {*comm.values(), -1}:
            assert quality(edges, {**comm, node: to}, rate) <= found
    parts = C.refined(graph, moved, rate).collect()
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    members = {}
    for r in parts:
        assert comm[r.node] == r.comm
        members.setdefault(r.part, set()).add(r.node)
    for nodes in members.values():  # each part is connected and inside one community
        assert len({comm[x] for x in nodes}) == 1
        seen, queue = set(), [min(nodes)]
        while queue:
            x = queue.pop()
            if x not in seen:
                seen.add(x)
                queue += near.get(x, set()) & nodes
        assert seen == nodes


def test_tables_of_nodes_are_not_broadcast(spark):
    """Each round joins them, and a broadcast passes through the driver."""
    nodes = C.held(spark.range(200).selectExpr("id AS node", "1L AS size", "id % 9 AS comm"))
    plan = C._sized(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
