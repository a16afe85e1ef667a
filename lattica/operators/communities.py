"""Communities of a weighted graph held in tables: local moves, refinement, aggregation.

The quality of a partition is that of the constant Potts model: the weight inside communities less
``resolution`` times the weight that pairs of nodes would have there at the graph's mean density.
A level has three steps.

1. Local moves.  In each round every node looks up the community that it gains most by joining (or
   being alone), and those that a hash of node and round picks move at once.  Where the moves of a
   round, made at once, lowered the quality, they are taken back and fewer are made.
2. Refinement.  Inside each community, nodes start alone again and single ones join a neighbouring
   part, if they are tied well enough to the community and gain by it; so parts are connected.
3. Aggregation.  Parts become the nodes of a smaller graph that starts from the communities.

Levels end when no parts join any more.  Once a level's graph has ``TASK_EDGES`` edges or fewer, one
task finishes it by the same three steps, node by node instead of round by round.  Weights are counted in 2^-20ths and the resolution in
2^-40ths of a unit, and all sums are exact, so a result doesn't depend on partitions or their order.
Nodes, edges and labels stay in tables that each step writes to the shared folder; to the driver come
counts and one sum a round.  Neighbours of a node are summed by (node, community) with partial sums
first, so hubs and large communities are no single task's work.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import held

WEIGHT_UNIT, RESOLUTION_UNIT = 2**20, 2**40
#: Rounds of moves and of refinement in a level; each only adds quality, so the bounds end a level, not the search.
MOVE_ROUNDS, REFINE_ROUNDS = 30, 4
#: A level has settled when fewer than one node in so many gains by a move.
SETTLED = 100
#: A task holds so many edges (both ways) at most, and as many nodes.
TASK_EDGES = 200_000
#: Ways in which a node's own number and a round make the label of a community of its own.
_LABELS = 4096


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffles: tables of nodes are joined in every round, and a broadcast would pass through the driver each time."""
    return left.join(right.hint("shuffle_hash"), on, how)


def _exact(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(38,0)")


def _less(weight: Column, rate: int, pairs: Column) -> Column:
    """Weight less the rate times the pairs of nodes, in 2^-60ths."""
    return (_exact(weight) * F.lit(RESOLUTION_UNIT) - _exact(rate) * _exact(pairs)).cast("decimal(38,0)")


def undirected(edges: DataFrame) -> DataFrame:
    """(i, j, w) both ways, of (a, b, weight): weights of repeated and opposite rows add up, loops and weights of 0 or less or null go."""
    good = edges.where("a != b and weight > 0").select("a", "b", F.floor(F.col("weight") * WEIGHT_UNIT).cast("long").alias("w"))
    both = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy(F.col("a").cast("long").alias("i"), F.col("b").cast("long").alias("j")).agg(F.sum("w").alias("w")).where("w > 0")


def _sized(labels: DataFrame) -> DataFrame:
    """(node, size, comm) with n, the size of the community."""
    return _met(labels, labels.groupBy("comm").agg(F.sum("size").alias("n")), "comm")


def _options(edges: DataFrame, labels: DataFrame, rate: int) -> DataFrame:
    """Per node: what it has in its community and the most it gains elsewhere (node, size, comm, turn, stay, gain, to).

    Turns are a column, so that all rounds are one plan, which Spark compiles once.
    """
    sized = _sized(labels)
    there = sized.select(F.col("node").alias("j"), F.col("comm").alias("at"), F.col("n").alias("n_at"))
    near = _met(edges, there, "j").groupBy(F.col("i").alias("node"), "at", "n_at").agg(F.sum("w").alias("w"))
    met = _met(near, sized.select("node", "size", "comm"), "node")
    gain = _less(F.col("w"), rate, F.col("size") * F.col("n_at"))
    own = F.col("at") == F.col("comm")
    best = met.groupBy("node").agg(F.max(F.when(own, F.col("w"))).alias("w"), F.max(F.when(~own, F.struct(gain.alias("gain"), (-F.col("at")).alias("to")))).alias("best"))
    alone = F.when(F.col("n") > F.col("size"), F.struct(_exact(0).alias("gain"), (-(F.col("node") * _LABELS + 1 + F.col("turn") % (_LABELS - 1))).alias("to")))
    stay = _less(F.coalesce("w", F.lit(0)), rate, F.col("size") * (F.col("n") - F.col("size")))
    found = _met(sized, best, "node", "left").withColumn("best", F.greatest("best", alone))
    return held(found.select("node", "size", "comm", "turn", stay.alias("stay"), F.col("best.gain").alias("gain"), (-F.col("best.to")).alias("to")))


def _picked(share: float) -> Column:
    return F.pmod(F.xxhash64("node", "turn"), F.lit(1024)) < int(1024 * share)


def local_moves(edges: DataFrame, labels: DataFrame, rate: int, level: int = 0) -> tuple[DataFrame, int]:
    """(node, size, comm) after rounds of moves from ``labels``, and twice its quality in 2^-60ths.

    Half the nodes that gain move; where that lowers the quality an eighth of them, then the one that gains most.
    """
    best = options = None
    shares = (0.5, 0.125, 0.0)
    tried = 0
    labels = labels.withColumn("turn", F.lit(level * MOVE_ROUNDS))
    for _ in range(MOVE_ROUNDS):
        found = _options(edges, labels, rate)
        gains = F.col("gain") > F.col("stay")
        quality, movers, n = found.agg(F.sum("stay"), F.count_if(gains), F.count(F.lit(1))).first()
        if best is None or quality > best:
            best, options, tried, left = quality, found, 0, movers
        else:
            tried += 1  # taken back
        if not left or left * SETTLED < n:
            break
        share = shares[min(tried, 2)]
        if share:
            goes = gains & _picked(share)
        else:
            first = options.where(gains).orderBy(F.desc(F.col("gain") - F.col("stay")), "node").first()
            goes = F.col("node") == first["node"]
        next_turn = F.col("turn") + 1 + tried
        labels = options.select("node", "size", F.when(goes, F.col("to")).otherwise(F.col("comm")).alias("comm"), next_turn.alias("turn"))
    return options.select("node", "size", "comm"), int(best or 0)


def refined(edges: DataFrame, labels: DataFrame, rate: int, level: int = 0) -> DataFrame:
    """(node, size, comm, part): connected parts of the communities, from single nodes."""
    of = labels.select("node", "comm")
    inside = _met(_met(edges, of.withColumnRenamed("node", "i"), "i"), of.select(F.col("node").alias("j"), F.col("comm").alias("_c")), "j").where("comm = _c")
    inside = held(inside.select("i", "j", "w"))
    tied = inside.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("w"))
    sized = _met(_sized(labels), tied, "node", "left")
    well = _less(F.coalesce("w", F.lit(0)), rate, F.col("size") * (F.col("n") - F.col("size"))) >= 0
    parts = held(sized.select("node", "size", "comm", well.alias("well"), F.col("node").alias("part"), F.lit(level * REFINE_ROUNDS).alias("turn")))
    for _ in range(REFINE_ROUNDS):
        joins = lambda c: F.pmod(F.xxhash64(c, "turn", F.lit("part")), F.lit(2)) == 0
        size = parts.groupBy("part").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
        hosts = _met(parts.where(~joins("part")).select(F.col("node").alias("j"), F.col("part").alias("to")), size.select(F.col("part").alias("to"), "n"), "to")
        single = _met(parts.where(F.col("well") & joins("part")), size.where("k = 1").select("part"), "part").select(F.col("node").alias("i"), "size")
        near = _met(_met(inside, single, "i"), hosts, "j").groupBy("i", "size", "to", "n").agg(F.sum("w").alias("w"))
        gain = _less(F.col("w"), rate, F.col("size") * F.col("n"))
        best = near.where(gain >= 0).groupBy(F.col("i").alias("node")).agg(F.max(F.struct(gain.alias("gain"), (-F.col("to")).alias("to"))).alias("best"))
        joined = _met(parts, best, "node", "left")
        parts = held(joined.select("node", "size", "comm", "well", F.coalesce(-F.col("best.to"), F.col("part")).alias("part"), (F.col("turn") + 1).alias("turn")))
    return parts.select("node", "size", "comm", "part")


def in_one_task(nodes: pd.DataFrame, edges: pd.DataFrame, rate: int) -> pd.DataFrame:
    """(node, comm) of a small graph that starts from ``nodes`` (node, size, comm): the three steps until no parts join."""
    nodes, edges = nodes.sort_values("node"), edges.sort_values(["i", "j"])
    number = {x: k for k, x in enumerate(nodes["node"].tolist())}
    size, start = nodes["size"].tolist(), {}
    comm = [start.setdefault(c, k) for k, c in enumerate(nodes["comm"].tolist())]
    near: list[dict[int, int]] = [{} for _ in size]
    for i, j, w in zip(edges["i"].tolist(), edges["j"].tolist(), edges["w"].tolist()):
        near[number[i]][number[j]] = w
    member = list(range(len(size)))
    unit = RESOLUTION_UNIT
    while True:
        total: dict[int, int] = {}
        for k, c in enumerate(comm):
            total[c] = total.get(c, 0) + size[k]
        queue, waits, fresh = deque(range(len(size))), [True] * len(size), len(size) + 1
        while queue:  # local moves
            k = queue.popleft()
            waits[k] = False
            own, weight = comm[k], {comm[k]: 0}
            for j, w in near[k].items():
                weight[comm[j]] = weight.get(comm[j], 0) + w
            gain = lambda c: weight[c] * unit - rate * size[k] * (total[c] - (size[k] if c == own else 0))  # noqa: B023, E731
            best = max(weight, key=lambda c: (gain(c), c == own, -c))
            if gain(best) < 0 and total[own] > size[k]:
                fresh += 1
                best, total[fresh] = fresh, 0
            if best != own:
                total[own] -= size[k]
                total[best] += size[k]
                comm[k] = best
                for j in near[k]:
                    if comm[j] != best and not waits[j]:
                        waits[j] = True
                        queue.append(j)
        part, held_by, alone = list(range(len(size))), size.copy(), [True] * len(size)
        for k in range(len(size)):  # refinement
            weight = {}
            for j, w in near[k].items():
                if comm[j] == comm[k]:
                    weight[part[j]] = weight.get(part[j], 0) + w
            if alone[k] and weight and sum(weight.values()) * unit >= rate * size[k] * (total[comm[k]] - size[k]):
                gain = lambda p: weight[p] * unit - rate * size[k] * held_by[p]  # noqa: B023, E731
                best = max(weight, key=lambda p: (gain(p), -p))
                if gain(best) >= 0:
                    part[k], alone[k], alone[best] = best, False, False
                    held_by[best] += size[k]
        kept = {p: n for n, p in enumerate(sorted(set(part)))}
        if len(kept) == len(size):
            return pd.DataFrame({"node": list(number), "comm": [comm[k] for k in member]})
        joined: list[dict[int, int]] = [{} for _ in kept]  # aggregation
        for k, row in enumerate(near):
            a = kept[part[k]]
            for j, w in row.items():
                if (b := kept[part[j]]) != a:
                    joined[a][b] = joined[a].get(b, 0) + w
        first: dict[int, int] = {}
        comm = [first.setdefault(comm[p], n) for p, n in kept.items()]
        size = [held_by[p] for p in kept]
        member = [kept[part[k]] for k in member]
        near = joined


def _partition(edges: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """(node, comm) of the symmetric ``edges`` (i, j, w) over all ``nodes``."""
    n, total = nodes.count(), edges.agg(F.sum(_exact(F.col("w")))).first()[0]
    rate = round(resolution * int(total or 0) * RESOLUTION_UNIT / max(n, 1) ** 2)
    labels = nodes.select("node", F.lit(1).cast("long").alias("size"), (F.col("node") * _LABELS).alias("comm"))
    member = nodes.select("node", F.col("node").alias("part"))
    level = 0
    while True:
        if max(edges.count(), labels.count()) <= TASK_EDGES:
            one = F.lit(0)
            small = labels.groupBy(one.alias("k")).cogroup(edges.groupBy(one.alias("k"))).applyInPandas(lambda a, b: in_one_task(a, b, rate), "node long, comm long")
            return held(_met(member, small.withColumnRenamed("node", "part"), "part").select("node", "comm"))
        labels, _ = local_moves(edges, labels, rate, level)
        parts = refined(edges, labels, rate, level)
        before, after = parts.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
        if before == after:
            return held(_met(member, labels.select(F.col("node").alias("part"), "comm"), "part").select("node", "comm"))
        to = parts.select(F.col("node").alias("i"), F.col("part").alias("pi"))
        joined = _met(_met(edges, to, "i"), to.select(F.col("i").alias("j"), F.col("pi").alias("pj")), "j").where("pi != pj")
        edges = held(joined.groupBy(F.col("pi").alias("i"), F.col("pj").alias("j")).agg(F.sum("w").alias("w")))
        member = held(_met(member, parts.select(F.col("node").alias("part"), F.col("part").alias("_p")), "part").select("node", F.col("_p").alias("part")))
        labels = held(parts.groupBy(F.col("part").alias("node")).agg(F.sum("size").alias("size"), F.first("comm").alias("comm")))
        level += 1


def communities(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, wanted: int | None = None, smallest: int = 1, tries: int = 12) -> DataFrame:
    """(node, label): communities of the undirected (a, b, weight), each named by its smallest node.

    ``nodes`` (node) adds nodes without edges and fixes which nodes are returned; those of
    communities with fewer than ``smallest`` members have a null label.  With ``wanted`` the
    resolution is searched between 1/64 and 64 times the given one, halving its range at most
    ``tries`` times, and the partition whose number of labels comes nearest is taken.
    """
    graph = held(undirected(edges))
    every = graph.select(F.col("i").alias("node"))
    asked = every.distinct() if nodes is None else nodes.select(F.col("node").cast("long").alias("node")).where("node is not null").distinct()
    known = held(asked)
    if nodes is not None:  # edges to nodes that aren't asked for count for nothing
        graph = held(_met(_met(graph, known.select(F.col("node").alias("i")), "i", "left_semi"), known.select(F.col("node").alias("j")), "j", "left_semi"))

    def labelled(rate: float) -> tuple[DataFrame, int]:
        found = _partition(graph, known, rate)
        groups = held(found.groupBy("comm").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("label")).where(F.col("n") >= smallest))
        return held(_met(found, groups.select("comm", "label"), "comm", "left").select("node", "label")), groups.count()

    best, n = labelled(resolution)
    if wanted is None:
        return best
    off, at = abs(n - wanted), math.log(resolution)
    low, high = at - math.log(64), at + math.log(64)
    for _ in range(tries):
        if n == wanted:
            break
        low, high = (at, high) if n < wanted else (low, at)
        at = (low + high) / 2
        found, n = labelled(math.exp(at))
        if abs(n - wanted) < off:
            best, off = found, abs(n - wanted)
    return best
