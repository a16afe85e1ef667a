"""Rescoring equals scoring anew, and only touches what changed; statistics are made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import enrichment as E
from lattica.operators import rescoring as R


@pytest.fixture(scope="module")
def round_(spark):
    rng = np.random.default_rng(0)
    x = rng.gamma(2.0, 1.0, (4, 120))
    level = spark.createDataFrame([(g, f, float(x[g, f])) for g in range(4) for f in range(120)], "grp int, feature long, x double")
    members = spark.createDataFrame([(f"s{s}", int(f), 1.0 + s) for s in range(5) for f in rng.choice(120, 10, replace=False)], "set string, feature long, weight double")
    return level, members


def edits(round_):
    level, members = round_
    edited = members.where("not (set = 's1' and feature % 3 = 0) and set != 's4'").unionByName(members.where("set = 's2'").select(F.lit("new").alias("set"), "feature", "weight"))
    merged = level.where("grp != 3").withColumn("x", F.when((F.col("grp") == 1) & (F.col("feature") < 20), F.col("x") * 3).otherwise(F.col("x")))
    return merged.unionByName(level.where("grp = 0").withColumn("grp", F.lit(9))), edited


def test_a_rescored_round_equals_a_full_one(spark, round_):
    level, members = round_
    strata = level.select("feature", (F.col("feature") % 2).cast("int").alias("stratum")).distinct()
    null = lambda a, b: E.enrichment_test(a, b, strata, draws=200).drop("q")
    for score in (R.weighted_means, null):
        told = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        key = lambda df: sorted(tuple(map(told, r)) for r in df.select(sorted(df.columns)).collect())  # noqa: E731, B023
        before = score(level, members).cache()
        rounds = [edits(round_), (level, edits(round_)[1]), (edits(round_)[0], members), (level, members)]
        for now in rounds if score is R.weighted_means else rounds[:1]:
            got = R.rescored(score, before, (level.repartition(3), now[0].repartition(2)), (members.repartition(2), now[1]), (strata, strata.repartition(5)))
            assert key(got) == key(score(*now))


def test_only_what_changed_is_scored(spark, round_):
    level, members = round_
    now, edited = edits(round_)
    assert {r.grp for r in R.changed(level, now, "grp").collect()} == {1, 9} and {r.set for r in R.changed(members, edited, "set").collect()} == {"s1", "new"}
    seen = []

    def score(a, b):
        seen.append(({r.grp for r in a.select("grp").distinct().collect()}, {r.set for r in b.select("set").distinct().collect()}))
        return R.weighted_means(a, b)

    before = R.weighted_means(level, members)
    R.rescored(score, before, (level, now), (members, edited)).collect()
    assert seen == [({1, 9}, {"s0", "s1", "s2", "s3", "new"}), ({0, 2}, {"s1", "new"})]
    seen.clear()
    R.rescored(score, before, (level, level), (members, members)).collect()
    assert seen == [(set(), {"s0", "s1", "s2", "s3", "s4"}), ({0, 1, 2, 3}, set())]  # nothing by nothing
    R.rescored(score, before, (level, level), (members, members), (level, now)).collect()
    assert seen[2:] == [({0, 1, 2, 3}, {"s0", "s1", "s2", "s3", "s4"})]


def test_statistics_are_made_once_for_the_same_inputs(spark, round_, tmp_path):
    level, members = round_
    made = []

    def make():
        made.append(1)
        return level.groupBy("grp").agg(F.sum("x").alias("total"))

    folder = str(tmp_path / "stats")
    first = R.kept_statistic(folder, "sums", {"level": level}, make).collect()
    again = R.kept_statistic(folder, "sums", {"level": level.repartition(5)}, make).collect()
    assert sorted(first) == sorted(again) and len(made) == 1
    R.kept_statistic(folder, "sums", {"level": level.where("feature > 0")}, make)
    assert len(made) == 2
    assert R.table_digest(level) != R.table_digest(level.unionByName(level.limit(1))) != R.table_digest(level.withColumnRenamed("x", "y"))
