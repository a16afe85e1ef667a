"""Outputs: wide tables, label files, evidence, signatures, vocabularies, descriptions, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_text(rows: DataFrame, path: str, *columns: str, header: bool = False) -> None:
    """Tab-separated lines of ``columns``; nulls are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    body = rows.select(F.concat_ws("\t", *cells).alias("value"))
    if header:
        head = rows.sparkSession.createDataFrame([("\t".join(columns),)], "value string")
        body = head.unionByName(body)
    body.write.mode("overwrite").text(path)


def wide(table: DataFrame, classes: list[str], row: str = "grp", column: str = "class", value: str = "value") -> DataFrame:
    """A row per group and a column per class; a missing cell is NaN."""
    cells = table.groupBy(row).pivot(column, classes).agg(F.first(F.col(value).cast("double")))
    return cells.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))).alias(c) for c in classes])


def write_group_tables(statistics: dict[str, DataFrame], classes: list[str], prefix: str) -> list[str]:
    """A Parquet table of groups by classes for each statistic; their paths."""
    paths = []
    for name, table in statistics.items():
        paths.append(f"{prefix}.{name}.parquet")
        wide(table, classes).write.mode("overwrite").parquet(paths[-1])
    return paths


def write_labels(labels: DataFrame, prefix: str) -> dict[str, str]:
    """Labels (obs, label, probability) as Parquet and text, and the membership (obs, label) of those that are assigned."""
    paths = {k: f"{prefix}.{k}" for k in ("argmax.parquet", "argmax.tsv", "membership.tsv")}
    labels.select(F.col("obs").cast("string").alias("cell"), F.col("label").alias("cell_type"), "probability").write.mode("overwrite").parquet(paths["argmax.parquet"])
    write_text(labels, paths["argmax.tsv"], "obs", "label", "probability")
    write_text(labels.where("label is not null and label != 'unassigned'"), paths["membership.tsv"], "obs", "label")
    return paths


# The statistics of the evidence table, in its order.
STATISTICS = ["share", "nes", "p", "q", "pip", "fold", "explained", "score", "units"]


def write_evidence(evidence: DataFrame, path: str) -> None:
    """The long evidence table of (grp, class and statistics): cluster (K and the group), celltype, then every statistic; those that weren't scored are NaN."""
    have = set(evidence.columns)
    cells = [(F.coalesce(F.col(s).cast("float"), F.lit(float("nan"))) if s in have else F.lit(float("nan"))).cast("float").alias(s) for s in STATISTICS]
    cluster = F.concat(F.lit("K"), F.col("grp").cast("string")).alias("cluster")
    evidence.select(cluster, F.col("class").alias("celltype"), *cells).write.mode("overwrite").parquet(path)


def signature(tests: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` positive terms of each group by z, ties by term: (grp, rank, term, z, p, q)."""
    by = Window.partitionBy("grp").orderBy(F.desc("z"), "term")
    return tests.where("z > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("grp", "rank", "term", "z", "p", "q")


def write_signature(tests: DataFrame, path: str, top: int = 10) -> None:
    rows = signature(tests, top).repartitionByRange("grp").sortWithinPartitions("grp", "rank")
    write_text(rows, path, "grp", "rank", "term", "z", "p", "q")


def write_vocabulary(frequencies: DataFrame, path: str) -> None:
    """(word, df) lines, commonest first."""
    write_text(frequencies.orderBy(F.desc("df"), "word"), path, "word", "df")


def write_edges(edges: DataFrame, prefix: str) -> list[str]:
    """Edges (kind, a, b, weight): a file for each kind."""
    kinds = sorted(r[0] for r in edges.select("kind").distinct().collect())  # kinds are a few names
    for kind in kinds:
        write_text(edges.where(F.col("kind") == kind), f"{prefix}.{kind}.tsv", "a", "b", "weight")
    return [f"{prefix}.{kind}.tsv" for kind in kinds]


def describe(digest: DataFrame, ranking: DataFrame) -> DataFrame:
    """A JSON text and a Markdown line per group, from (grp, size, label) and (grp, rank, class, effect)."""
    tops = ranking.where("rank <= 3").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("rank", "class", F.round("effect", 4).alias("effect")))).alias("top"))
    both = digest.join(tops, "grp", "left")
    named = F.concat_ws(", ", F.transform(F.coalesce("top", F.array().cast("array<struct<rank:int,class:string,effect:double>>")), lambda t: t["class"]))
    line = F.concat(F.lit("- **"), F.col("grp").cast("string"), F.lit("** ("), F.col("size").cast("string"), F.lit("): "), F.coalesce("label", F.lit("unassigned")), F.lit("; "), named)
    return both.select("grp", F.to_json(F.struct("grp", "size", "label", "top")).alias("json"), line.alias("markdown"))


def save_manifest(spark: SparkSession, manifest: dict, path: str, replace: bool = False) -> None:
    """A run's manifest as one JSON object; one that is there already is an error unless it is to be replaced."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite" if replace else "errorifexists").text(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """A run's manifest: one JSON object; anything else is an error."""
    found = spark.read.text(path, wholetext=True).where("trim(value) != ''").limit(2).collect()
    if len(found) != 1 or not isinstance(manifest := json.loads(found[0][0]), dict):
        raise ValueError(f"{path}: not one JSON object")
    return manifest
