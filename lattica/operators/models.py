"""Statistical models: tree-wise FDR, matched null tests, regions, diffusion.

Random draws are ordered by md5, so results don't depend on partitions.  Class enrichment is in
``enrichment``, sparse regression in ``sparse_effects``, set vectors are in ``set_vectors``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.sources.shared import dropped, held


@F.pandas_udf(T.DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), na_action="ignore").astype(float)


def poisson_tail_of(x: float, mean: float) -> float:
    """P(X >= x), the regularised lower incomplete gamma function of (ceil(x), mean)."""
    k = math.ceil(x)
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    if mean < k + 1:  # series
        term = total = 1.0 / k
        n = k
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= mean / n
            total += term
        return min(1.0, total * math.exp(-mean + k * math.log(mean) - math.lgamma(k)))
    b = mean + 1.0 - k  # continued fraction of the upper function
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - k)
        b += 2.0
        d = 1.0 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return max(0.0, 1.0 - math.exp(-mean + k * math.log(mean) - math.lgamma(k)) * h)


@F.pandas_udf(T.DoubleType())
def poisson_tail(x: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series([poisson_tail_of(a, b) for a, b in zip(x, mean)], dtype=float)


def joined_pairs(connectivity: DataFrame, share: float = 0.01, level: float = 0.001) -> DataFrame:
    """Pairs of groups with more edges than a Poisson share of the expected ones explains."""
    tail = poisson_tail(F.col("edges").cast("double"), F.col("expected") * share)
    return connectivity.withColumn("joined", (F.col("edges") > 0) & (tail < level))


def simes_bh(p: dict, children: dict, root, level: float = 0.05) -> dict:
    """Selected nodes of a hypothesis tree: Benjamini-Hochberg in each family of a selected parent.

    Internal nodes take the Simes p of their children; a family's level is the tree's, times
    the share selected in each family above.  With a star tree it is Benjamini-Hochberg.
    """
    def simes(node) -> float:
        kids = children.get(node, [])
        if not kids:
            return p.get(node, math.nan)
        values = sorted(x for x in map(simes, kids) if not math.isnan(x))
        return min((x * len(values) / (i + 1) for i, x in enumerate(values)), default=math.nan)

    selected, queue = {}, [(root, level)]
    while queue:
        parent, q = queue.pop()
        family = sorted((simes(c), c) for c in children.get(parent, []) if not math.isnan(simes(c)))
        passed = max((i + 1 for i, (x, _) in enumerate(family) if x <= q * (i + 1) / len(family)), default=0)
        for x, c in family[:passed]:
            selected[c] = x
            queue.append((c, q * passed / len(family)))
    return selected


def tree_selection(tests: DataFrame, nodes: DataFrame, level: float = 0.05) -> DataFrame:
    """(grp, class, p, selected) by the tree of (child, parent) nodes; families of one group are one task."""
    rows = nodes.collect()  # a taxonomy of classes, bounded by their number
    children: dict = {}
    for r in rows:
        children.setdefault(r["parent"], []).append(r["child"])
    root = next(iter(sorted({r["parent"] for r in rows} - {r["child"] for r in rows})), None)

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        got = simes_bh(dict(zip(pdf["class"], pdf["p"])), children, root, level)
        return pdf.assign(selected=pdf["class"].isin(list(got)))[["grp", "class", "p", "selected"]]

    return tests.select("grp", "class", "p").groupBy("grp").applyInPandas(select, "grp int, class string, p double, selected boolean")


def strata(sums: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, stratum) by total abundance: bounds are quantiles, equal totals share a bin."""
    total = sums.groupBy("feature").agg(F.sum("value").alias("total"))
    cuts = total.agg(F.expr(f"percentile_approx(total, array({', '.join(str(i / bins) for i in range(1, bins))}), 10000)").alias("cuts"))
    return total.crossJoin(cuts).select("feature", F.size(F.filter("cuts", lambda c: c < F.col("total"))).alias("stratum"))  # cuts are one row


def decoys(members: DataFrame, strata_of: DataFrame, draws: int, seed: int = 7, spread: float = 8.0) -> DataFrame:
    """(set, draw, feature): in each stratum as many features as the set has there, least md5 first.

    Only features whose md5 lies below a bound are ordered: the bound leaves ``spread`` deviations more than are
    wanted, and is raised where a stratum has kept too few all the same.
    """
    spark = members.sparkSession
    placed = members.join(strata_of, "feature")
    wanted = held(placed.groupBy("set", "stratum").agg(F.count(F.lit(1)).alias("n")))
    whole = draws * (wanted.agg(F.sum("n")).first()[0] or 0)
    sizes = strata_of.groupBy("stratum").agg(F.count(F.lit(1)).alias("of"))
    by = Window.partitionBy("set", "draw", "stratum").orderBy("key")
    every = F.explode(F.array(*[F.lit(str(i)) for i in range(draws)]))
    while True:
        share = (F.col("n") + spread * F.sqrt("n") + 5 * spread) / F.col("of")
        bound = F.when(share < 1, F.lower(F.lpad(F.hex(F.floor(share * 2**32)), 8, "0"))).otherwise("g")
        bounds = held(wanted.join(sizes, "stratum").select("set", "stratum", "n", bound.alias("bound"), F.concat(F.lit(f"{seed}|"), "set", F.lit("|")).alias("head")))
        pool = strata_of.withColumn("tail", F.concat(F.lit("|"), "feature")).join(F.broadcast(bounds), "stratum")  # sets by strata
        dealt = pool.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "set", "feature")  # few rows, but each is drawn many times
        drawn = dealt.withColumn("draw", every).withColumn("key", F.md5(F.concat("head", "draw", "tail"))).where("key < bound")
        ranked = drawn.select("set", F.col("draw").cast("long").alias("draw"), "stratum", "feature", "n", "key").withColumn("_r", F.row_number().over(by))
        found = held(ranked.where(F.col("_r") <= F.col("n")).select("set", "draw", "feature"))
        if found.count() == whole:
            return found
        spread *= 4


#: Levels that a task of the matched test holds.
LEVELS_A_TASK = 1 << 19


def _drawn_sums(draws: int, seed: int):
    """Of a part of a stratum's features: each group's summed levels over what falls there of every set's draws."""

    def sums(levels: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        features, row = np.unique(levels["feature"].to_numpy(), return_inverse=True)
        known = levels["grp"].notna().to_numpy()
        groups, column = np.unique(levels["grp"].to_numpy()[known], return_inverse=True)
        x = np.zeros((len(features), len(groups)))
        x[row[known], column] = levels["x"].to_numpy(float)[known]
        sets, totals = [], []
        for w in wanted.sort_values("set").itertuples(index=False) if len(features) and len(groups) else ():
            key = f"{seed}|{w.set}|{w.at}"
            stream = lambda *part: np.random.default_rng(int(hashlib.md5("|".join([key, *map(str, part)]).encode()).hexdigest(), 16))  # noqa: B023, E731
            parts = np.asarray(w.sizes, np.int64)
            # Every part of the stratum finds the same shares of a draw, and draws its own features.
            share = stream().multivariate_hypergeometric(parts, min(w.n, parts.sum()), size=draws, method="marginals")[:, list(w.parts).index(w.own)]
            mine = stream(w.own)
            totals.append(np.array([x[mine.choice(len(features), k, replace=False, shuffle=False)].sum(axis=0) for k in share.tolist()]))
            sets.append(w.set)
        n = len(sets)
        out = {"set": np.repeat(np.array(sets, object), draws * len(groups)), "draw": np.tile(np.repeat(np.arange(draws), len(groups)), n)}
        return pd.DataFrame(out | {"grp": np.tile(groups, n * draws), "s": np.concatenate(totals).ravel() if n else np.zeros(0)})

    return sums


def matched_sums(level: DataFrame, members: DataFrame, strata_of: DataFrame, draws: int, seed: int = 7) -> DataFrame:
    """(grp, set, draw, s): levels summed over random sets that have, in each stratum, as many features as the set.

    A stratum's features are dealt by their hash into parts of bounded size.  A draw's features are shared out
    to the parts as a random set would fall and drawn in each, so no set lies anywhere as rows.
    """
    groups = max(1, level.select("grp").distinct().count())
    sizes = strata_of.groupBy("stratum").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, LEVELS_A_TASK // groups))).alias("of"))
    pool = held(strata_of.join(sizes, "stratum").select("feature", "stratum", F.pmod(F.xxhash64("feature"), F.col("of")).alias("part")))
    each = held(pool.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("size")))
    parts = each.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("part", "size"))).alias("p"))
    wanted = members.where("set is not null").join(pool.select("feature", "stratum"), "feature").groupBy("set", "stratum").agg(F.count(F.lit(1)).alias("n"))
    asked = wanted.join(parts, "stratum").select("set", F.col("stratum").alias("at"), "n", F.col("p.part").alias("parts"), F.col("p.size").alias("sizes"), F.explode("p.part").alias("own"))
    tasks = 4 * int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not lowered at run time: few rows, but much is drawn
    rows = pool.join(level, "feature", "left").select("stratum", "part", "feature", "grp", "x").repartition(tasks, "stratum", "part")
    asked = asked.repartition(tasks, "at", "own")
    kind = level.schema["grp"].dataType.simpleString()
    met = rows.groupBy("stratum", "part").cogroup(asked.groupBy("at", "own")).applyInPandas(_drawn_sums(draws, seed), f"set string, draw long, grp {kind}, s double")
    return met.groupBy("grp", "set", "draw").agg(F.sum("s").alias("s"))


def matched_test(level: DataFrame, members: DataFrame, strata_of: DataFrame, draws: int = 200, seed: int = 7) -> DataFrame:
    """(grp, set, effect, z, p): mean level of a set against matched random sets; a flat null gives no z."""
    level, strata_of = held(level.select("grp", "feature", "x")), held(strata_of)
    members = held(members.select("set", "feature"))
    groups = level.select("grp").distinct()

    def means(summed: DataFrame, size: DataFrame, keys: list[str]) -> DataFrame:
        grid = groups.crossJoin(size)  # groups by sets (and draws)
        return grid.join(summed, ["grp", *keys], "left").select("grp", *keys, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("e"))

    of = lambda df: df.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    own = means(level.join(members, "feature").groupBy("grp", "set").agg(F.sum("x").alias("s")), of(members), ["set"])
    drawn = of(members.join(strata_of.select("feature"), "feature")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    null = means(matched_sums(level, members, strata_of, draws, seed), drawn, ["set", "draw"])
    shape = null.groupBy("grp", "set").agg(F.avg("e").alias("m"), F.stddev_samp("e").alias("sd"))
    z = F.when(F.col("sd") >= 1e-6, (F.col("e") - F.col("m")) / F.col("sd"))
    scored = own.join(shape, ["grp", "set"]).withColumn("z", z)
    return scored.select("grp", "set", F.col("e").alias("effect"), "z", normal_upper_tail("z").alias("p"))


def call_order(items: list[tuple[str, float, float]], tie: float = 0.01) -> list[str]:
    """Names by PIP; runs within ``tie`` of the run's first are ordered by what they explain."""
    left = sorted(items, key=lambda x: (math.isnan(x[1]), -x[1] if not math.isnan(x[1]) else 0, x[0]))
    out: list[str] = []
    while left:
        first = left[0][1]
        run = [x for x in left if not math.isnan(first) and first - x[1] <= tie] or left[:1]
        left = left[len(run) :]
        out += [x[0] for x in sorted(run, key=lambda x: (-x[2], x[0]))]
    return out


def regions(points: DataFrame, rounds: int = 100) -> DataFrame:
    """(obs, call, membership): isotropic mixture on the unit sphere with fixed centres, the groups' mean directions.

    All of ``rounds`` are run.  In a round each partition gives one row of sums for each region, and
    only their totals come to the driver; memberships are computed where the vectors are.
    """
    dims = points.select("grp", F.posexplode("vec").alias("k", "x")).groupBy("grp", "k").agg(F.avg("x").alias("x")).collect()
    names = sorted({r["grp"] for r in dims})
    d = 1 + max((r["k"] for r in dims), default=0)
    centres = np.zeros((len(names), d))
    for r in dims:
        centres[names.index(r["grp"]), r["k"]] = r["x"]
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    free = max(d - 1, 1)
    weight, var = np.full(len(names), 1 / max(len(names), 1)), np.full(len(names), 1.0 / free)

    def responsibilities(vec: pd.Series, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(vec.tolist(), float).reshape(-1, d)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        far = np.maximum(2 - 2 * x @ centres.T, 0)
        log = np.log(np.maximum(w, 1e-300)) - free / 2 * np.log(v) - far / (2 * v)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), far

    for _ in range(rounds):
        w, v = weight.copy(), var.copy()

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mass, spread = np.zeros(len(names)), np.zeros(len(names))
            for pdf in batches:
                if len(pdf):
                    p, far = responsibilities(pdf["vec"], w, v)
                    mass, spread = mass + p.sum(axis=0), spread + (p * far).sum(axis=0)
            yield pd.DataFrame({"r": np.arange(len(names)), "p": mass, "far": spread})

        total = points.select("vec").mapInPandas(sums, "r int, p double, far double").groupBy("r").agg(F.sum("p").alias("p"), F.sum("far").alias("far")).toPandas().set_index("r").reindex(range(len(names))).fillna(0.0)
        mass = np.maximum(total["p"].to_numpy(), 1e-9)
        weight, var = mass / mass.sum(), np.maximum(total["far"].to_numpy() / (mass * free), 1e-6)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p, _ = responsibilities(pdf["vec"], weight, var)
            best = p.argmax(axis=1) if len(pdf) else np.zeros(0, int)
            yield pd.DataFrame({"obs": pdf["obs"], "call": [names[i] for i in best], "membership": p.max(axis=1) if len(pdf) else []})

    return points.select("obs", "vec").mapInPandas(call, "obs long, call int, membership double")


#: A dense eigenproblem fits the driver up to so many representatives.
DENSE_NODES = 4_000


#: The block iteration: spare vectors, residual wanted of every pair, products of a cycle and at most.
SPARE, RESIDUAL, CYCLE, MOST_PRODUCTS = 10, 1e-3, 12, 2560


#: Nodes of a part of a graph; a graph has ``LEAST_PARTS`` at least.  A product copies each part of a block once to each part.
PART_NODES, LEAST_PARTS = 1 << 17, 4


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(-1, width)


def _gram(parts: DataFrame, columns: dict[str, int]) -> np.ndarray:
    """Inner products of the columns of all matrices of a row, side by side: partial sums where the parts are."""
    width = sum(columns.values())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.hstack([_matrix(data, w) for data, w in zip(row, columns.values())])
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(width * width), "x": total.ravel()})

    rows = parts.select(*columns).mapInPandas(sums, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(width * width)
    out[rows["at"].to_numpy()] = rows["x"]
    return out.reshape(width, width)


def _rotated(vectors: DataFrame, by: np.ndarray) -> DataFrame:
    """(i, v @ by)."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"i": pdf["i"], "v": list(np.array(pdf["v"].tolist(), float) @ by)})

    return vectors.mapInPandas(turn, "i long, v array<double>")


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What turns columns of this gram matrix orthonormal; directions lost to rounding count as the least."""
    value, vector = np.linalg.eigh(gram)
    return vector / np.sqrt(np.maximum(value, value.max() * 1e-14))


def leading_pairs(s: DataFrame, count: int) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues of largest magnitude of the symmetric (i, j, s), signed and descending, and (i, v) of their vectors.

    Restarted block Krylov spaces: a cycle gathers ``CYCLE`` blocks, each the image of the one before less what lies
    in the last two, and starts the next from the best pairs of all of them.  Nodes are dealt into parts and a block is
    a row of packed numbers for each part, so a product is one join of parts with cells of the matrix and sums of parts;
    a step writes its own block, its forerunner and its image, and only inner products of columns come to the driver.
    Tables of a cycle are deleted at its end.  It ends when every pair's residual passes and raises where that doesn't come.
    """
    s = held(s)
    nodes = s.select(F.col("i").cast("long").alias("i")).distinct()
    n_nodes = nodes.count()
    width = min(count + SPARE, n_nodes)
    n_parts = max(LEAST_PARTS, math.ceil(n_nodes / PART_NODES))
    dealt = nodes.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(n_parts)).cast("int"))
    placed = held(dealt.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy("i")) - 1))
    start = F.array(*[F.xxhash64("i", F.lit(c)) / F.lit(2.0**63) for c in range(width)])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "ids": [pdf["i"].to_numpy(np.int64).tobytes()], "v": [np.array(pdf["v"].tolist(), float).tobytes()]})

    begun = held(placed.select("part", "i", start.alias("v")).groupBy("part").applyInPandas(first, "part int, ids binary, v binary"))
    ids = begun.select("part", "ids")
    at = lambda c: placed.select(F.col("i").alias(c), F.col("part").alias(f"{c}_part"), F.col("row").alias(f"{c}_row"))
    entries = s.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "s").join(at("i"), "i").join(at("j"), "j")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i_row", "j_row"])
        one = {"i_part": pdf["i_part"].iloc[:1], "j_part": pdf["j_part"].iloc[:1]}
        return pd.DataFrame(one | {"rows": [pdf["i_row"].to_numpy(np.int32).tobytes()], "cols": [pdf["j_row"].to_numpy(np.int32).tobytes()], "values": [pdf["s"].to_numpy(float).tobytes()]})

    cells = held(entries.groupBy("i_part", "j_part").applyInPandas(packed, "i_part int, j_part int, rows binary, cols binary, values binary"))

    def with_image(block: DataFrame, width: int) -> DataFrame:
        """(part, before, cur, image) of (part, before, cur)."""

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    rows = np.frombuffer(r.rows, np.int32)
                    new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                    product = np.frombuffer(r.values, float)[:, None] * _matrix(r.cur, width)[np.frombuffer(r.cols, np.int32)]
                    yield pd.DataFrame({"i_part": [r.i_part], "rows": [rows[new].tobytes()], "sums": [np.add.reduceat(product, new).tobytes()]})

        def added(own: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            image = np.zeros_like(_matrix(own["cur"].iloc[0], width))
            for rows, part in zip(sums["rows"], sums["sums"]):
                image[np.frombuffer(rows, np.int32)] += _matrix(part, width)
            return own.assign(image=[image.tobytes()])

        met = cells.join(block.select(F.col("part").alias("j_part"), "cur").hint("shuffle_hash"), "j_part")
        sums = met.select("i_part", F.col("rows"), "cols", F.col("values"), "cur").mapInPandas(multiply, "i_part int, rows binary, sums binary")
        return held(block.groupBy("part").cogroup(sums.groupBy("i_part")).applyInPandas(added, "part int, before binary, cur binary, image binary"))

    def turned(parts: DataFrame, columns: dict[str, int], turns: dict[str, np.ndarray]) -> DataFrame:
        """The matrices of a row side by side, times each of ``turns``."""

        def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    x = np.hstack([_matrix(data, w) for data, w in zip(row[1:], columns.values())])
                    yield pd.DataFrame({"part": [row[0]]} | {name: [np.ascontiguousarray(x @ by).tobytes()] for name, by in turns.items()})

        return parts.select("part", *columns).mapInPandas(turn, "part int, " + ", ".join(f"{name} binary" for name in turns))

    block, restarts, done = begun.select("part", "v"), [], 0
    while True:
        by = _orthonormal(_gram(block, {"v": width}))
        fresh = held(turned(block, {"v": width}, {"before": np.zeros_like(by), "cur": by}))
        steps = [with_image(fresh, width)]
        dropped(fresh, *restarts)
        for _ in range(1, CYCLE):
            done += 1
            columns = {"before": width, "cur": width, "image": width}
            both = _gram(steps[-1], columns)
            old = 2 * width
            inside = np.linalg.pinv(both[:old, :old], rcond=1e-10, hermitian=True) @ both[:old, old:]
            rest = both[old:, old:] - both[old:, :old] @ inside
            left, rest = np.linalg.eigh((rest + rest.T) / 2)
            rest = rest / np.sqrt(np.where(left > 1e-12 * np.diag(both[old:, old:]).max(), left, np.inf))  # what the blocks hold whole stays zero
            keep = np.vstack([np.zeros((width, width)), np.eye(width), np.zeros((width, width))])
            fresh = held(turned(steps[-1], columns, {"before": keep, "cur": np.vstack([-inside @ rest, rest])}))
            steps.append(with_image(fresh, width))
            dropped(fresh)
        done += 1
        n = CYCLE * width
        every = None
        for k, step in enumerate(steps):
            one = step.select("part", F.lit(k).alias("k"), "cur", "image")
            every = one if every is None else every.unionByName(one)

        def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            side = lambda c: np.hstack([_matrix(data, width) for data in pdf[c]]).tobytes()  # noqa: B023, E731
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "space": [side("cur")], "images": [side("image")]})

        space = held(every.groupBy("part").applyInPandas(gathered, "part int, space binary, images binary"))
        dropped(*steps)
        both = _gram(space, {"space": n, "images": n})
        weight, axes = np.linalg.eigh(both[:n, :n])
        kept = weight > weight.max() * 1e-10  # blocks may span the whole graph
        axes = axes[:, kept] / np.sqrt(weight[kept])
        inner = axes.T @ both[:n, n:] @ axes
        value, turn = np.linalg.eigh((inner + inner.T) / 2)
        few = np.argsort(-np.abs(value), kind="stable")[:width]
        ritz = axes @ turn[:, few]
        best = few[:count]
        order = np.argsort(-value[best], kind="stable")
        value, pairs = value[best][order], ritz[:, :count][:, order]
        outer = np.einsum("ij,ik,kj->j", pairs, both[n:, n:], pairs)
        residual = np.sqrt(np.maximum(outer - value**2, 0.0))
        if residual.max() <= RESIDUAL:
            found = turned(space, {"space": n}, {"v": pairs})

            def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for names, v in zip(pdf["ids"], pdf["v"]):
                        yield pd.DataFrame({"i": np.frombuffer(names, np.int64), "v": list(_matrix(v, len(value)))})

            vectors = held(ids.join(found.hint("shuffle_hash"), "part").select("ids", "v").mapInPandas(unpacked, "i long, v array<double>"))
            dropped(space, cells, begun, placed, s)
            return value, vectors
        if not np.isfinite(residual).all() or done >= MOST_PRODUCTS:
            raise ValueError(f"diffusion components didn't converge: residual {residual.max():.2e} after {done} products")
        block = held(turned(space, {"space": n}, {"v": ritz}))
        restarts = [block]
        dropped(space)
        width = ritz.shape[1]


def _far_pseudotime(s: DataFrame, roots: DataFrame, components: int, used: int) -> DataFrame:
    """The times of a graph of any size; coordinates stay in tables."""
    value, vectors = leading_pairs(s, components + 1)
    scale = np.where(value < 0.9994, value / np.maximum(1 - value, 1e-12), 1.0)[1 : used + 1]
    turn = np.zeros((len(value), len(scale)))
    turn[np.arange(1, len(scale) + 1), np.arange(len(scale))] = scale
    coords = held(_rotated(vectors, turn))
    start = coords.join(roots.select(F.col("obs").cast("long").alias("i")).distinct(), "i", "left_semi").collect()  # a root for each class
    at = np.array([r["v"] for r in start], float)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), float)
                yield pd.DataFrame({"obs": pdf["i"], "far": np.min([np.sqrt(((x - a) ** 2).sum(axis=1)) for a in at], axis=0)})

    far = held(coords.mapInPandas(least, "obs long, far double"))
    n = far.count()
    place = round((n - 1) * 0.99) / max(n - 1, 1)
    bounds = far.agg(F.expr(f"percentile(far, {place!r})").alias("at"), F.max("far").alias("most")).first()
    return far.select("obs", F.least(F.col("far") / F.lit(bounds["at"] or bounds["most"] or 1.0), F.lit(1.0)).alias("t"))


def pseudotime(kernel: DataFrame, roots: DataFrame, components: int = 15, used: int = 10) -> DataFrame:
    """(obs, t): diffusion distance to the nearest root, scaled to its 99th percentile.

    The graph's kernel is normalised where it lies; the eigenproblem is dense on the driver
    up to ``DENSE_NODES`` nodes and block Krylov spaces over tables beyond.
    """
    kernel = held(kernel)
    q = kernel.groupBy("i").agg(F.sum("w").alias("q"))
    qi, qj = q.select("i", F.col("q").alias("qi")), q.select(F.col("i").alias("j"), F.col("q").alias("qj"))
    k = kernel.join(qi, "i").join(qj, "j").select("i", "j", (F.col("w") / (F.col("qi") * F.col("qj"))).alias("k"))
    z = k.groupBy("i").agg(F.sum("k").alias("z"))
    zi, zj = z.select("i", F.col("z").alias("zi")), z.select(F.col("i").alias("j"), F.col("z").alias("zj"))
    s = k.join(zi, "i").join(zj, "j").select("i", "j", (F.col("k") / F.sqrt(F.col("zi") * F.col("zj"))).alias("s"))
    if q.count() > DENSE_NODES:
        return _far_pseudotime(s, roots, components, used)
    entries = s.toPandas()
    ids = np.unique(entries["i"].to_numpy())
    m = np.zeros((len(ids), len(ids)))
    m[np.searchsorted(ids, entries["i"]), np.searchsorted(ids, entries["j"])] = entries["s"]
    value, vector = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-value)[: components + 1]
    value, vector = value[order], vector[:, order]
    scale = np.where(value < 0.9994, value / np.maximum(1 - value, 1e-12), 1.0)[1 : used + 1]
    coords = vector[:, 1 : used + 1] * scale
    start = np.isin(ids, [r["obs"] for r in roots.collect()])  # a root for each class
    far = np.sqrt(((coords[:, None, :] - coords[start][None, :, :]) ** 2).sum(axis=2)).min(axis=1)
    at = np.sort(far)[round((len(far) - 1) * 0.99)] or far.max() or 1.0
    return kernel.sparkSession.createDataFrame(pd.DataFrame({"obs": ids, "t": np.minimum(far / at, 1.0)}))


def digest(*parts: object) -> str:
    """Key of cached tables: hex digest of what they were computed from."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def probit(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, 1e-300), 1 - 1e-16))
