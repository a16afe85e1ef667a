"""Scores of a new round from those of the last: only what changed is scored again.

A score of a set in a group stands on the group's levels, on the set's weighted members and on facts
that all share.  Groups whose levels differ from the last round's are scored for every set, the others
for the sets whose members or weights differ, and all other scores are taken over.  Which differ is
found by digests: a count and two sums of row hashes a group (or set), in one pass over each table, so
no table is compared row by row and rows may come in any order.

Sufficient statistics are kept the same way, as tables named by the digest of what they were made
from, so a round that changes nothing of it reads them instead of making them again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import held

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def digests(rows: DataFrame, key: str) -> DataFrame:
    """(key, digest): of each key's rows, whatever their order; doubles count to nine digits."""
    cells = [F.round(c, 9) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    hashed = rows.select(key, F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string")
    return hashed.groupBy(key).agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), wide("a"), wide("b")).alias("digest"))


def table_digest(rows: DataFrame) -> str:
    """One digest of a whole table: its columns and its rows in any order."""
    found = digests(rows.withColumn("_whole", F.lit(0)), "_whole").first()
    return hashlib.sha256(f"{rows.dtypes}|{found['digest'] if found else ''}".encode()).hexdigest()


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key) of ``after`` that is new or whose rows differ."""
    then = digests(before, key).withColumnRenamed("digest", "_then")
    return digests(after, key).join(then, key, "left").where("_then is null or digest != _then").select(key)


def rescored(score: Scorer, before: DataFrame, level: tuple[DataFrame, DataFrame], members: tuple[DataFrame, DataFrame], shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The scores (grp, set, ...) of a round, equal to ``score(level, members)`` of it.

    ``before`` are the last round's scores; ``level`` (grp, feature, x) and ``members`` (set, feature,
    weight) are pairs of the last and this round's.  ``shared`` is what every score stands on (strata,
    say): where it differs all is scored again.  Columns that compare scores, such as q, must be added
    afterwards, as a row of them changes with any of its scores.
    """
    if shared is not None and table_digest(shared[0]) != table_digest(shared[1]):
        return score(level[1], members[1])
    groups, sets = held(changed(*level, "grp")), held(changed(*members, "set"))
    now = level[1]
    again = score(now.join(groups, "grp", "left_semi"), members[1])
    others = score(now.join(groups, "grp", "left_anti"), members[1].join(sets, "set", "left_semi"))
    left = before.join(now.select("grp").distinct(), "grp", "left_semi").join(members[1].select("set").distinct(), "set", "left_semi")
    kept = left.join(groups, "grp", "left_anti").join(sets, "set", "left_anti")
    return kept.unionByName(again).unionByName(others)


def kept_statistic(folder: str, name: str, inputs: dict[str, DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a table of ``folder``, named by the digests of its inputs; read if it is there.

    The table is written under another name and renamed when it is whole, so a broken run leaves none.
    """
    frame = next(iter(inputs.values()))
    spark = frame.sparkSession
    key = hashlib.sha256("|".join(f"{k}={table_digest(v)}" for k, v in sorted(inputs.items())).encode()).hexdigest()
    path = f"{folder}/{name}-{key}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        make().write.parquet(draft)
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), at)
    return spark.read.parquet(path)


def weighted_means(level: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, set, score): the weighted mean level of a set's features; a feature without a level counts as 0."""
    total = members.groupBy("set").agg(F.sum("weight").alias("total"))
    summed = level.join(members, "feature").groupBy("grp", "set").agg(F.sum(F.col("x") * F.col("weight")).alias("s"))
    grid = level.select("grp").distinct().crossJoin(total)  # groups by sets, as the scores are
    return grid.join(summed, ["grp", "set"], "left").select("grp", "set", (F.coalesce("s", F.lit(0.0)) / F.col("total")).alias("score"))
