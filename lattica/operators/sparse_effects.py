"""Which classes explain a group's counts: a sampled sum of positive single effects.

Each group's marker features, as log folds over a background, are a Student-t sample around the sum
of the effects of the classes that hold them.  There are at most ``EFFECTS`` effects; each is one
class with a log-normal size, or none.  Chains are tasks of their own, a group's chains are pooled:
inclusion probabilities average what each draw's choices say, an effect's credible set holds the fewest
classes with 95 % of its choices (and counts only where these classes share features), and the split
R-hat compares halves of chains.  Where it warns, the chain whose removal lowers it most is named.

What groups share is estimated from tables first: sizes from features that no class holds, a
background from the groups that a short first pass calls none of a feature's classes in, and how far
each feature strays beyond its counts' noise.  Features with zero counts in a group take part.  No
table of features comes to the driver.

Features of the same classes always have the same sum of effects, so a chain needs only the sum of their
log densities at one value.  Where many share their classes, tasks dealt by classes make that sum a
piecewise polynomial (to about twelve digits, see ``piece_edges``), and a chain's work and memory follow
the distinct sets of classes instead of the features.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import held

# Fixed values of the model.
FREEDOM, EFFECTS, NO_EFFECT = 4.0, 5, 0.5
CHAINS, WARMUP, DRAWS, FIRST_DRAWS = 4, 500, 1000, 200
COVERAGE, PURITY, WARN = 0.95, 0.5, 1.1
LEAST_MARKERS, PSEUDO_GROUPS, SCALE_RANGE = 3, 10.0, (1e-3, 25.0)
LARGEST_LOG_EFFECT, PIP_TIE = 5.0, 0.01
#: Coefficients of a piece, and numbers that a table may hold for each of its features.
TERMS, TABLE_SHARE = 13, 16
#: Features of a task that makes tables (a set of classes isn't split below ``SPLIT``), and values it computes at a time.
TABLED, SPLIT, AT_ONCE = 20_000, 500_000, 100_000

CHAIN = "grp int, chain int, draws long, classes array<string>, pip array<double>, theta array<double>, half_mean array<double>, half_var array<double>, choices array<array<double>>"
CONDENSED = "grp int, feature long, n long, x double, variance double, classes array<string>, pieces binary"
FIT = "grp int, class string, pip double, fold double, explained double, credible_set int, called boolean, rhat double, bad_chain int"


class Incidence:
    """Which classes hold each feature: pairs sorted by class.  A row may stand for ``count`` features of the same classes."""

    def __init__(self, held_by: list[list[str]], count: np.ndarray | None = None):
        self.classes = sorted({c for cs in held_by for c in cs})
        at = {c: i for i, c in enumerate(self.classes)}
        pairs = sorted((at[c], f) for f, cs in enumerate(held_by) for c in set(cs))
        self.feature = np.array([f for _, f in pairs], np.int64)
        self.of = np.array([c for c, _ in pairs], np.int64)
        self.begins = np.searchsorted(self.of, np.arange(len(self.classes) + 1))
        self.n_features = len(held_by)
        self.count = np.ones(self.n_features) if count is None else np.asarray(count, float)

    def members(self, c: int) -> np.ndarray:
        return self.feature[self.begins[c] : self.begins[c + 1]]

    def etas(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, theta[self.of], self.n_features)

    def correlation(self) -> np.ndarray:
        """Correlation of the classes' indicators, without sign."""
        n = len(self.classes)
        indicator = np.zeros((n, self.n_features))
        indicator[self.of, self.feature] = 1
        p = indicator @ self.count / self.count.sum()
        spread = np.sqrt(np.maximum(p * (1 - p), 0))
        both = spread[:, None] * spread
        return np.where(both > 0, np.abs((indicator * self.count) @ indicator.T / self.count.sum() - p[:, None] * p) / np.where(both > 0, both, 1), 0)


class Likelihood:
    """Log density of log folds ``x`` with scales ``variance`` around features' sums of effects."""

    def __init__(self, x: np.ndarray, variance: np.ndarray):
        self.x, self.precision = x, 1 / (FREEDOM * variance)

    def __call__(self, eta: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        x, precision = (self.x, self.precision) if some is None else (self.x[some], self.precision[some])
        return -0.5 * (FREEDOM + 1) * np.log1p((x - eta) ** 2 * precision)


def piece_edges(highest: float, least_variance: float) -> np.ndarray:
    """Edges of pieces from 0 to the largest sum of effects.

    A log density has its poles beside ``x``, at twice the root of its scale: a piece is half that wide,
    and wider beyond the highest ``x``, so ``TERMS`` terms leave an error of about 1e-12 of the values.
    """
    height, edges = 2 * math.sqrt(least_variance), [0.0]
    while edges[-1] < EFFECTS * math.exp(LARGEST_LOG_EFFECT):
        edges.append(edges[-1] + math.hypot(height, max(edges[-1] - highest, 0.0)) / 2)
    return np.array(edges)


@functools.cache
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev's nodes between -1 and 1, and the matrix from values there to coefficients of powers."""
    angle = (np.arange(TERMS) + 0.5) * math.pi / TERMS
    waves = np.cos(np.outer(np.arange(TERMS), angle)) * (2 / TERMS)
    waves[0] /= 2
    powers = np.array([np.pad(np.polynomial.chebyshev.cheb2poly(row), (0, TERMS))[:TERMS] for row in np.eye(TERMS)])
    return np.cos(angle), powers.T @ waves


def pieces(x: np.ndarray, variance: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Coefficients (piece, term) of the features' summed log density."""
    u, to_powers = _nodes()
    at = ((edges[:-1] + edges[1:])[:, None] / 2 + np.diff(edges)[:, None] / 2 * u).ravel()
    values, rows = np.zeros(len(at)), max(AT_ONCE // len(at) // 8, 1) * 8
    short = -len(x) % 8  # rows of precision 0 add a logarithm of 1
    x, precision = np.pad(x, (0, short)), np.pad(1 / (FREEDOM * variance), (0, short))
    for first in range(0, len(x), rows):
        ratio = x[first : first + rows, None] - at
        ratio *= ratio
        ratio *= precision[first : first + rows, None]
        ratio += 1
        for _ in range(3):  # a logarithm of eight at once
            ratio = ratio[0::2] * ratio[1::2]
        values += np.log(ratio).sum(axis=0)
    return -0.5 * (FREEDOM + 1) * values.reshape(-1, TERMS) @ to_powers.T


class Tabled:
    """As ``Likelihood``, of features alone (the first rows) and of tables of many (the rest)."""

    def __init__(self, x: np.ndarray, variance: np.ndarray, tables: np.ndarray, edges: np.ndarray):
        self.alone, self.n, self.tables, self.edges = Likelihood(x, variance), len(x), tables, edges
        self.centre, self.scale = (edges[:-1] + edges[1:]) / 2, 2 / np.diff(edges)

    def _sums(self, eta: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(self.edges, eta, side="right") - 1, 0, len(self.centre) - 1)
        powers = np.vander((eta - self.centre[at]) * self.scale[at], TERMS, increasing=True)
        return np.einsum("ij,ij->i", self.tables[rows, at], powers)

    def __call__(self, eta: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        if some is None:
            return np.concatenate([self.alone(eta[: self.n]), self._sums(eta[self.n :], np.arange(len(self.tables)))])
        k = int(np.searchsorted(some, self.n))  # rows of a class are sorted
        return np.concatenate([self.alone(eta[:k], some[:k]), self._sums(eta[k:], some[k:] - self.n)])


def explained(like: Likelihood | Tabled, panel: Incidence, theta: np.ndarray) -> np.ndarray:
    """Each class's share of the log-likelihood that all effects gain: what is lost without its own."""
    eta = panel.etas(theta)
    at = like(eta)
    gain = at.sum() - like(np.zeros_like(eta)).sum()
    lost = np.zeros(len(theta))
    for c in np.flatnonzero(theta > 0):
        some = panel.members(c)
        lost[c] = max((at[some] - like(eta[some] - theta[c], some)).sum(), 0)
    return lost / max(gain, lost.sum()) if gain > 0 else np.zeros(len(theta))


def effect_size(z: float) -> float:
    return math.exp(min(z, LARGEST_LOG_EFFECT))


def slice_on_ellipse(rng: np.random.Generator, z: float, gain, now: float) -> float:
    """A draw under a standard normal prior and ``gain``, on the ellipse through ``z`` and a fresh prior draw."""
    other, bar = rng.standard_normal(), now + math.log(max(rng.random(), 1e-300))
    angle = rng.random() * 2 * math.pi
    low, high = angle - 2 * math.pi, angle
    for _ in range(200):
        to = z * math.cos(angle) + other * math.sin(angle)
        if gain(to) > bar:
            return to
        low, high = (angle, high) if angle < 0 else (low, angle)
        angle = low + (high - low) * rng.random()
    return z


def run_chain(like: Likelihood | Tabled, panel: Incidence, warmup: int, draws: int, rng: np.random.Generator) -> dict:
    """One chain's means; ``choices`` are each effect's mean choice probabilities, matched over the draws."""
    n = len(panel.classes)
    chosen, z = np.full(EFFECTS, n), rng.standard_normal(EFFECTS)
    theta, eta = np.zeros(n), np.zeros(panel.n_features)
    base = like(eta)
    prior = np.append(np.full(n, math.log((1 - NO_EFFECT) / n)), math.log(NO_EFFECT))
    probability = np.zeros((EFFECTS, n + 1))
    pip, mean, reference, choices = np.zeros(n), np.zeros(n), None, None
    halves = [[0, np.zeros(n), np.zeros(n)], [0, np.zeros(n), np.zeros(n)]]

    def shift(c: int, by: float) -> None:
        some = panel.members(c)
        theta[c] += by
        eta[some] += by
        base[some] = like(eta[some], some)

    for sweep in range(warmup + draws):
        eta, theta = panel.etas(theta), np.where(np.abs(theta) < 1e-9, 0.0, theta)
        base = like(eta)
        for k in range(EFFECTS):
            if chosen[k] < n:
                shift(chosen[k], -effect_size(z[k]))
            risen = like(eta + effect_size(z[k])) - base
            score = prior.copy()
            score[:n] += np.add.reduceat(risen[panel.feature], panel.begins[:-1])
            weight = np.exp(score - score.max())
            probability[k] = weight / weight.sum()
            c = min(int(np.searchsorted(np.cumsum(probability[k]), rng.random() * (1 - 1e-15), side="right")), n)
            chosen[k] = c
            if c < n:
                some = panel.members(c)
                around, before = eta[some], base[some].sum()
                gain = lambda to: like(around + effect_size(to), some).sum() - before  # noqa: B023, E731
                z[k] = slice_on_ellipse(rng, z[k], gain, gain(z[k]))
                shift(c, effect_size(z[k]))
            else:
                z[k] = rng.standard_normal()
        if sweep >= warmup:
            pip += 1 - np.prod(1 - probability[:, :n], axis=0)
            mean += theta
            half = halves[(sweep - warmup) * 2 // draws]
            half[0], half[1], half[2] = half[0] + 1, half[1] + theta, half[2] + theta**2
            if reference is None:
                reference, choices = probability.copy(), np.zeros_like(probability)
            choices += matched(reference, probability)
    centre = [s / m for m, s, _ in halves]
    spread = [np.maximum(ss - m * c**2, 0) / max(m - 1, 1) for (m, _, ss), c in zip(halves, centre)]
    return {"pip": pip / draws, "theta": mean / draws, "half_mean": np.concatenate(centre), "half_var": np.concatenate(spread), "choices": choices / draws}


def matched(reference: np.ndarray, effects: np.ndarray) -> np.ndarray:
    """``effects`` in the order that overlaps ``reference`` most: the best free pair first."""
    overlap, out = reference @ effects.T, np.empty_like(effects)
    for _ in range(len(effects)):
        i, j = np.unravel_index(overlap.argmax(), overlap.shape)
        out[i] = effects[j]
        overlap[i, :], overlap[:, j] = -1, -1
    return out


def split_rhat(mean: np.ndarray, var: np.ndarray, draws: int) -> float:
    """The largest split R-hat of the columns, from halves' means and variances (a half a row)."""
    if len(mean) < 2 or draws < 2:
        return math.nan
    within, between = var.mean(axis=0), mean.var(axis=0, ddof=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.sqrt((draws - 1) / draws + between / within)
    ratio = np.where(within > 0, ratio, np.where(between > 1e-12, np.inf, 1.0))
    return float(max(ratio.max(initial=1.0), 1.0))


def diagnosis(mean: np.ndarray, var: np.ndarray, draws: int) -> tuple[float, int | None]:
    """R-hat of chains (each two rows), and where it warns the chain without which it is least."""
    whole = split_rhat(mean, var, draws)
    chains = len(mean) // 2
    if not whole > WARN or chains < 3:
        return whole, None
    without = [split_rhat(np.delete(mean, [2 * c, 2 * c + 1], 0), np.delete(var, [2 * c, 2 * c + 1], 0), draws) for c in range(chains)]
    return whole, int(np.argmin(without))


def credible(choice: np.ndarray, alike: np.ndarray) -> list[int] | None:
    """The fewest classes with the wanted share of an effect's choices; None for one that is mostly none, or mixes unlike classes."""
    if choice[-1] > 0.5:
        return None
    share = choice[:-1] / choice[:-1].sum()
    order = np.argsort(-share, kind="stable")
    some = order[: int(np.searchsorted(np.cumsum(share[order]), COVERAGE - 1e-12)) + 1]
    pure = (alike[np.ix_(some, some)] >= PURITY) | np.eye(len(some), dtype=bool)
    return sorted(some.tolist()) if pure.all() else None


def called(pip: np.ndarray, share: np.ndarray, within: list[list[int]]) -> int | None:
    """The class of a credible set with the best PIP; PIPs a hundredth apart are ties, which what they explain decides."""
    some = sorted({c for s in within for c in s})
    if not some:
        return None
    top = max(pip[c] for c in some)
    return min((c for c in some if top - pip[c] <= PIP_TIE), key=lambda c: (-share[c], c))


def _grid(pdf: pd.DataFrame, edges: np.ndarray) -> tuple[Likelihood | Tabled, Incidence]:
    """The likelihood and the incidence of a group's rows: features alone first, then one table for each set of classes."""
    pdf = pdf.sort_values("feature")
    alone, many = pdf[pdf["pieces"].isna()], pdf[pdf["pieces"].notna()]
    x, variance = alone["x"].to_numpy(float), alone["variance"].to_numpy(float)
    held_by = [list(c) for c in alone["classes"]]
    if many.empty:
        return Likelihood(x, variance), Incidence(held_by)
    place: dict[tuple, int] = {}
    of = [place.setdefault(tuple(c), len(place)) for c in many["classes"]]
    tables, count = np.zeros((len(place), len(edges) - 1, TERMS)), np.zeros(len(place))
    for at, table, n in zip(of, many["pieces"], many["n"]):
        tables[at] += np.frombuffer(table, "<f8").reshape(-1, TERMS)
        count[at] += n
    return Tabled(x, variance, tables, edges), Incidence(held_by + [list(c) for c in place], np.append(np.ones(len(x)), count))


def condensed(markers: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Rows of features alone and tables of many that share their classes, edges of pieces, and groups.

    A set of classes is tabled where that takes at most ``TABLE_SHARE`` numbers a feature.
    """
    rows, groups, highest, least = markers.agg(F.count(F.lit(1)), F.count_distinct("grp"), F.max("x"), F.min(F.col("v") + F.col("s2"))).first()
    edges = piece_edges(highest, least) if rows else np.zeros(1)
    enough = max((len(edges) - 1) * TERMS / TABLE_SHARE, 2)
    each = math.ceil(rows / max(groups, 1))  # features of a group

    def table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["names", "feature"]).reset_index(drop=True)
        pdf["variance"] = pdf["v"] + pdf["s2"]
        size = pdf.groupby("names")["feature"].transform("size")
        alone = pdf[size < enough].assign(n=1, pieces=None)
        many = []
        for _, same in pdf[size >= enough].groupby("names", sort=False):
            found = pieces(same["x"].to_numpy(float), same["variance"].to_numpy(float), edges)
            many.append((key[0], same["feature"].iat[0], len(same), None, None, same["classes"].iat[0], found.astype("<f8").tobytes()))
        columns = ["grp", "feature", "n", "x", "variance", "classes", "pieces"]
        if not many:
            return alone[columns]
        many = pd.DataFrame(many, columns=columns).astype({"x": float, "variance": float})
        return many if alone.empty else pd.concat([alone[columns], many])

    part = F.pmod(F.xxhash64("feature"), F.lit(math.ceil(max(each, 1) / SPLIT)))
    deal = F.pmod(F.xxhash64("classes", part), F.lit(math.ceil(max(each, 1) / TABLED)))
    named = markers.select("grp", deal.alias("deal"), F.to_json("classes").alias("names"), F.col("feature").cast("long").alias("feature"), "x", "v", "s2", "classes")
    return held(named.groupBy("grp", "deal").applyInPandas(table, CONDENSED)), edges, groups


def sample(markers: DataFrame, chains: int = CHAINS, warmup: int = WARMUP, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """Fits of ``markers`` (grp, feature, x, v, s2, classes): one task a group and chain, then one a group."""
    rows, edges, groups = condensed(markers)

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        like, panel = _grid(pdf, edges)
        rng = np.random.default_rng(int(hashlib.md5(f"{seed}|{key[0]}|{key[1]}".encode()).hexdigest(), 16))
        found = run_chain(like, panel, warmup, draws, rng)
        row = {"grp": key[0], "chain": key[1], "draws": draws, "classes": panel.classes} | {c: v.tolist() for c, v in found.items()}
        return pd.DataFrame([row])

    def pool(key: tuple, runs: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        like, panel = _grid(pdf, edges)
        n = len(panel.classes)
        runs = runs.sort_values("chain")
        pip, theta = (np.mean(np.stack(runs[c].tolist()), axis=0) for c in ("pip", "theta"))
        halves = [np.concatenate([np.asarray(r).reshape(2, n) for r in runs[c]]) for c in ("half_mean", "half_var")]
        rhat, bad = diagnosis(*halves, draws // 2)
        effects = [np.stack([np.asarray(e, float) for e in r]) for r in runs["choices"]]
        choices = np.mean([matched(effects[0], e) for e in effects], axis=0)
        alike = panel.correlation()
        sets: list[list[int]] = []
        for choice in choices:
            some = credible(choice, alike)
            if some and some not in sets:
                sets.append(some)
        share = explained(like, panel, theta)
        best = called(pip, share, sets)
        member = [next((i for i, s in enumerate(sets) if c in s), None) for c in range(n)]
        out = pd.DataFrame({"grp": key[0], "class": panel.classes, "pip": pip, "fold": theta, "explained": share})
        out["credible_set"] = pd.Series(member, dtype="Int32")
        return out.assign(called=[c == best for c in range(n)], rhat=rhat, bad_chain=pd.Series([bad] * n, dtype="Int32"))

    # More partitions than chains, and a number that isn't lowered at run time: chains of the same length seldom queue.
    each = rows.withColumn("chain", F.explode(F.array(*[F.lit(i) for i in range(chains)]))).repartition(min(max(3 * groups * chains, 1), 2000), "grp", "chain")
    runs = held(each.groupBy("grp", "chain").applyInPandas(chain, CHAIN))
    again = rows.withColumnRenamed("grp", "of")
    return held(runs.groupBy("grp").cogroup(again.groupBy("of")).applyInPandas(pool, FIT))


def _median(c: str | Column) -> Column:
    return F.median(c)


def _spread(folds: DataFrame) -> DataFrame:
    """(feature, raw) of (feature, x, v): a robust variance of the log folds beyond the counts' own."""
    centre = folds.groupBy("feature").agg(_median("x").alias("m"), _median("v").alias("mv"))
    off = folds.join(centre, "feature").groupBy("feature").agg(_median(F.abs(F.col("x") - F.col("m"))).alias("mad"), F.first("mv").alias("mv"))
    raw = (F.lit(1.4826) * F.col("mad")) ** 2 - F.col("mv")
    return off.select("feature", F.greatest(F.least(raw, F.lit(SCALE_RANGE[1])), F.lit(SCALE_RANGE[0])).alias("raw"))


def inputs(sums: DataFrame, panel: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, float, float]:
    """(grp, n) sizes, (grp, feature, y, classes) of markers with zeros, the total size, and the spread of unclaimed features.

    ``sums`` are (grp, feature, value), ``groups`` the groups; those without counts take no part.
    Classes with fewer than three features that have counts are left out.
    """
    counted = sums.where("value > 0")
    present = groups.select("grp").join(counted.select("grp").distinct(), "grp", "left_semi")
    pairs = panel.select("feature", "class").distinct().join(counted.select("feature").distinct(), "feature", "left_semi")
    enough = pairs.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_MARKERS).select("class")
    markers = held(pairs.join(enough, "class", "left_semi").groupBy("feature").agg(F.sort_array(F.collect_set("class")).alias("classes")))
    free = counted.join(markers, "feature", "left_anti")
    whole = counted.groupBy("grp").agg(F.sum("value").cast("double").alias("all"))
    sizes = present.join(whole, "grp").join(free.groupBy("grp").agg(F.sum("value").cast("double").alias("free")), "grp", "left")
    sizes = held(sizes.select("grp", F.coalesce(F.when(F.col("free") > 0, F.col("free")), F.col("all")).alias("n")))
    total, k = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = float(total or 0.0)
    pooled = free.groupBy("feature").agg(F.sum("value").cast("double").alias("s")).where(F.col("s") >= 10.0 * k)
    grid = pooled.crossJoin(sizes).join(counted.select("grp", "feature", "value"), ["grp", "feature"], "left")  # features by groups
    y, expected = F.coalesce(F.col("value").cast("double"), F.lit(0.0)), F.col("n") * F.col("s") / F.lit(max(total, 1e-300))
    folds = grid.select("feature", F.log((y + 0.5) / (expected + 0.5)).alias("x"), (1 / (y + 0.5)).alias("v"))
    spread = _spread(folds).agg(_median("raw")).first()[0]
    of = markers.crossJoin(sizes.select("grp")).join(counted.select("grp", "feature", "value"), ["grp", "feature"], "left")
    rows = held(of.select("grp", "feature", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("y"), "classes"))
    return sizes, rows, total, 1.0 if spread is None else float(spread)


def _folds(rows: DataFrame, sizes: DataFrame, background: DataFrame, s2: Column | DataFrame) -> DataFrame:
    joined = rows.join(sizes, "grp").join(background, "feature")
    joined = joined.join(s2, "feature") if isinstance(s2, DataFrame) else joined.withColumn("s2", s2)
    return joined.select("grp", "feature", F.log((F.col("y") + 0.5) / (F.col("b") * F.col("n") + 0.5)).alias("x"), (1 / (F.col("y") + 0.5)).alias("v"), "s2", "classes")


def class_effects(sums: DataFrame, panel: DataFrame, groups: DataFrame, chains: int = CHAINS, warmup: int = WARMUP, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(grp, class, pip, fold, explained, credible_set, called, rhat, bad_chain) of every group with counts.

    ``fold`` is the posterior mean of the class's log fold, ``credible_set`` the number of the first
    credible set that holds the class, and ``called`` marks the group's class, if it has any.
    """
    sizes, rows, total, spread = inputs(sums, panel, groups)
    rate = F.greatest(F.col("y") / F.col("n"), F.lit(0.5 / max(total, 0.5)))
    rates = held(rows.join(sizes, "grp").select("grp", "feature", rate.alias("rate"), "classes"))
    low = held(rates.groupBy("feature").agg(F.percentile("rate", 0.25).alias("b")))
    quick = held(_folds(rows, sizes, low, F.lit(spread)))
    first = sample(quick, 1, FIRST_DRAWS, FIRST_DRAWS, seed)

    of = first.where("called").select("grp", F.col("class").alias("call"))
    without = rates.join(of, "grp", "left").where("call is null or not array_contains(classes, call)")
    usual = without.groupBy("feature").agg(_median("rate").alias("m"))
    background = held(low.join(usual, "feature", "left").select("feature", F.coalesce("m", "b").alias("b")))

    fitted = quick.select("grp", "feature", F.explode("classes").alias("class")).join(first.select("grp", "class", "fold"), ["grp", "class"])
    eta = fitted.groupBy("grp", "feature").agg(F.sum("fold").alias("eta"))
    raw = held(_spread(quick.join(eta, ["grp", "feature"]).select("feature", (F.col("x") - F.col("eta")).alias("x"), "v")))
    centre = raw.where(F.col("raw") > SCALE_RANGE[0]).agg(_median("raw")).first()[0] or SCALE_RANGE[0]
    k = sizes.count()
    s2 = raw.select("feature", F.exp((k * F.log("raw") + PSEUDO_GROUPS * math.log(centre)) / (k + PSEUDO_GROUPS)).alias("s2"))
    return sample(held(_folds(rows, sizes, background, s2)), chains, warmup, draws, seed)
