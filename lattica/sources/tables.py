"""The engine's inputs from the driver's tables: counts, cells, panel, terms, taxonomy, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Sparse counts (obs, feature, value); an absent row is a zero."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("obs"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Observations with their group and batch."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("obs"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("batch"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping class-feature panel."""
    p = table(spark, d, "part")
    by_type = p.select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("class"))
    by_size = p.select("p_partkey", F.concat(F.lit("S"), (F.col("p_size") % 7).cast("string")))
    return by_type.union(by_size).distinct()


def terms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("feature"))


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """is_a edges (child, parent): nation, region, ROOT."""
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("child"), F.lit("ROOT").alias("parent"))
    return n.unionByName(r)


def precedence(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, votes): users whose first event of type a came before their first of type b, where more came so than the other way."""
    e = table(spark, d, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    a = first.select("user_id", F.col("event_type").alias("a"), F.col("at").alias("at_a"))
    b = first.select("user_id", F.col("event_type").alias("b"), F.col("at").alias("at_b"))
    votes = a.join(b, "user_id").where("at_a < at_b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
    back = votes.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("votes").alias("against"))
    joined = votes.join(back, ["a", "b"], "left")
    return joined.where("votes > coalesce(against, 0)").select("a", "b", "votes")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("obs"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("grp"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Fine per-observation calls: the panel type of the feature an observation counts most."""
    c = counts(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("label")), "feature")
    per = c.groupBy("obs", "label").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("obs").orderBy(F.desc("value"), "label")
    return per.withColumn("n", F.row_number().over(by)).where("n = 1").select("obs", "label")


#: The same inputs as DuckDB common table expressions.
SQL = {
    "counts": "SELECT o_custkey AS obs, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "cells": "SELECT c_custkey AS obs, c_nationkey AS grp, c_mktsegment AS batch FROM customer",
    "panel": "SELECT p_partkey AS feature, p_type AS class FROM part UNION SELECT p_partkey, 'S' || (p_size % 7) FROM part",
    "terms": "SELECT p_brand AS term, p_partkey AS feature FROM part",
    "taxonomy": "SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region",
    "first_events": "SELECT user_id, event_type, min(row(ts, event_id)) AS seen FROM events GROUP BY 1, 2",
    "votes": "SELECT x.event_type AS a, y.event_type AS b, count(*) AS votes FROM first_events x JOIN first_events y USING (user_id) WHERE x.seen < y.seen GROUP BY 1, 2",
    "precedence": "SELECT v.a, v.b, v.votes FROM votes v LEFT JOIN votes w ON v.a = w.b AND v.b = w.a WHERE v.votes > coalesce(w.votes, 0)",
    "vectors": "SELECT vec_id AS obs, embedding::DOUBLE[] AS vec, label AS grp FROM embeddings",
    "call_sums": "SELECT obs, p_type AS label, sum(value) AS value FROM counts JOIN part ON p_partkey = feature GROUP BY 1, 2",
    "calls": "SELECT obs, label FROM call_sums QUALIFY row_number() OVER (PARTITION BY obs ORDER BY value DESC, label) = 1",
    "sums": "SELECT grp, feature, sum(value) AS value FROM counts JOIN cells USING (obs) GROUP BY 1, 2",
    "profile": "SELECT grp, feature, value / greatest(sum(value) OVER (PARTITION BY grp), 1) AS mu FROM sums",
    "idf": "SELECT feature, ln((SELECT count(DISTINCT class) FROM panel) * 1.0 / count(DISTINCT class)) AS idf FROM panel GROUP BY 1",
    "n_groups": "SELECT count(DISTINCT grp) AS k FROM cells",
    "n_features": "SELECT count(DISTINCT feature) AS m FROM counts",
}
#: What each input stands on.
NEEDS = {
    "votes": ["first_events"], "precedence": ["votes"], "call_sums": ["counts"], "calls": ["call_sums"], "sums": ["counts", "cells"], "profile": ["sums"],
    "idf": ["panel"], "n_groups": ["cells"], "n_features": ["counts"],
}


def with_inputs(query: str, *names: str) -> str:
    """``query`` after the common table expressions that it names, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {head}{', ' if query.lstrip().startswith('+') else ' '}{query.lstrip().removeprefix('+')}" if head else query
