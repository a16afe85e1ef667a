"""Vectors of feature sets, trained against feature vectors that stay as they are.

A set's vector u raises, for each of its features f, the softmax of u . f against ``NEGATIVES`` sampled
features, with one adaptive step width a vector (gradient over the root of its mean squares so far).
As the features are frozen, sets don't touch each other: each is trained where its row lies, with its
members' vectors beside it, and so are ``decoys`` random sets for every size in use.  These are the
null: drawn from the features that sets could be annotated with, and compared at their size.

Negatives come from ``POOL`` features (those with the least md5; all, if there are fewer), the one
sample that a task holds whole.  Draws are seeded by the set, so results don't depend on partitions.

Defined cases: features without a vector, or with one that holds null or non-finite values, count for
nothing; sets with fewer than ``least`` features found are left out; repeated members count once; a
flat null gives no z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.names import size_bin
from lattica.sources.shared import held

EPOCHS, BATCH, NEGATIVES, POOL = 50, 64, 50, 4096
RATE, START = 0.3, 0.01
DECOYS, LEAST = 99, 3
#: A set of more features is trained on so many a step, all of them in an epoch.
UNIT = "set string, bin long, draw int, covered long, vec array<double>"


def _seed(*parts: object) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest(), 16))


def train(members: np.ndarray, negatives: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> np.ndarray:
    """The vector of a set with these members' vectors."""
    u = rng.normal(0, START, members.shape[1])
    squares = 0.0
    for _ in range(epochs):
        order = rng.permutation(len(members))
        for at in range(0, len(order), BATCH):
            own = members[order[at : at + BATCH]]
            other = negatives[rng.integers(0, len(negatives), NEGATIVES)]
            score_own, score_other = own @ u, other @ u
            top = max(score_own.max(), score_other.max())
            e_own, e_other = np.exp(score_own - top), np.exp(score_other - top)
            total = e_own + e_other.sum()
            # Each member against all negatives: minus itself, plus the softmax's mean.
            slope = (-own.sum(axis=0) + (e_own / total) @ own + (1 / total).sum() * (e_other @ other)) / len(own)
            squares += (slope**2).mean()
            u -= RATE * slope / np.sqrt(squares + 1e-10)
    return u


def found_members(features: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, feature, vec) of the distinct members that have a usable vector."""
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = features.where(F.coalesce(usable & (F.size("vec") > 0), F.lit(False))).dropDuplicates(["feature"])
    return sets.where("set is not null").select("set", "feature").distinct().join(good.select("feature", "vec"), "feature")


def _decoys(sizes: DataFrame, pool: DataFrame, decoys: int, seed: int) -> DataFrame:
    """(set, bin, draw, feature): random sets of the pool, for each size in use."""
    one = pool.agg(F.sort_array(F.collect_set("feature")).alias("pool"))  # the features' names, a row of them

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                names = np.asarray(r.pool)
                picked = [names[np.sort(_seed(seed, r.bin, i).choice(len(names), min(r.bin, len(names)), replace=False))] for i in range(decoys)]
                n = [len(x) for x in picked]
                yield pd.DataFrame({"bin": r.bin, "draw": np.repeat(np.arange(decoys, dtype=np.int32), n), "feature": np.concatenate(picked) if decoys else []})

    kind = dict(pool.dtypes)["feature"]
    drawn = sizes.select("bin").distinct().crossJoin(F.broadcast(one)).mapInPandas(draw, f"bin long, draw int, feature {kind}")
    return drawn.select(F.concat(F.lit("decoy "), "bin", F.lit("/"), "draw").alias("set"), "bin", "draw", "feature")


def set_vectors(features: DataFrame, sets: DataFrame, pool: DataFrame | None = None, decoys: int = DECOYS, least: int = LEAST, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """(set, bin, draw, covered, vec, near) of ``sets`` (set, feature) over ``features`` (feature, vec), and of their decoys.

    ``bin`` is the size at which a set is compared, ``draw`` numbers a size's decoys (null: a set
    itself), ``covered`` counts its features and ``near`` is their mean cosine to its vector.  Decoys
    are drawn from the features of ``pool`` that have vectors, or from all.
    """
    some = held(found_members(features, sets))
    sizes = held(some.groupBy("set").agg(F.count(F.lit(1)).alias("covered")).where(F.col("covered") >= least).withColumn("bin", size_bin("covered")))
    known = held(found_members(features, features.select(F.lit("all").alias("set"), "feature")).select("feature", "vec"))
    annotated = known if pool is None else known.join(pool.select("feature").distinct(), "feature", "left_semi")
    own = some.join(sizes, "set").select(F.col("set").cast("string").alias("set"), "bin", F.lit(None).cast("int").alias("draw"), "feature", "vec")
    null = _decoys(sizes, annotated, decoys, seed).join(known, "feature").select("set", "bin", "draw", "feature", "vec")
    rows = own.unionByName(null)
    sample = known.orderBy(F.md5(F.col("feature").cast("string")), "feature").limit(POOL).select("vec").collect()  # of bounded size
    negatives = np.array([r["vec"] for r in sample], float)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature")
        members = np.array(pdf["vec"].tolist(), float)
        name, size, number = pdf["set"].iloc[0], int(pdf["bin"].iloc[0]), pdf["draw"].iloc[0]
        u = train(members, negatives, _seed(seed, name), epochs)
        cosine = members @ u / np.maximum(np.linalg.norm(members, axis=1) * np.linalg.norm(u), 1e-300)
        row = {"set": name, "bin": size, "draw": None if pd.isna(number) else int(number), "covered": len(members), "vec": u.tolist(), "near": float(cosine.mean())}
        return pd.DataFrame([row]).astype({"draw": "Int32"})

    return held(rows.groupBy("set", "bin", "draw").applyInPandas(fit, UNIT + ", near double"))


def against_decoys(units: DataFrame) -> DataFrame:
    """(set, bin, covered, near, z, p): how near a set lies to its features, against decoys of its size.

    z is by the decoys' median and median absolute deviation, p counts the decoys as near or nearer.
    """
    null = units.where("draw is not null").select("bin", F.col("near").alias("x"))
    centre = null.groupBy("bin").agg(F.median("x").alias("m"), F.count(F.lit(1)).alias("n"))
    spread = null.join(centre, "bin").groupBy("bin").agg((F.lit(1.4826) * F.median(F.abs(F.col("x") - F.col("m")))).alias("sd"), F.first("m").alias("m"), F.first("n").alias("n"))
    own = units.where("draw is null").select("set", "bin", "covered", "near")
    reach = own.select("set", "bin", "near").join(null, "bin").groupBy("set").agg(F.count_if(F.col("x") >= F.col("near")).alias("reach"))
    z = F.when(F.col("sd") > 1e-9, (F.col("near") - F.col("m")) / F.col("sd"))
    joined = own.join(spread, "bin").join(reach, "set")
    return joined.select("set", "bin", "covered", "near", z.alias("z"), ((F.col("reach") + 1) / (F.col("n") + 1)).alias("p"))
