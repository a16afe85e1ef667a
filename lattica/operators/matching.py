"""Labels to taxonomy terms, words that make kinds, species by feature names, layered rules, whitening."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import names as N
from lattica.operators.labels import label_key

#: Ways a label matches, the best first.
WAYS = ("alias", "name", "synonym", "singular", "order", "unqualified")


def match_labels(labels: DataFrame, names: DataFrame, aliases: DataFrame, qualifiers: list[str] = ()) -> DataFrame:
    """(label, id, how): the best way in which any term answers to a label; several terms in it leave it unmatched ('ambiguous').

    ``names`` is (id, name, own); ``aliases`` is (key, id) by label key.  All ways are one keyed join.
    """
    form = lambda c: N.normalise(c)
    terms = names.withColumn("n", form("name")).where("n != ''")
    way = lambda k, key: F.struct(F.lit(k).alias("way"), key.alias("key"))
    own = F.when(F.col("own"), F.lit(1)).otherwise(2)
    bare = F.when(F.col("own"), N.unqualified("n", list(qualifiers)))
    keys = F.array(F.struct(own.alias("way"), F.col("n").alias("key")), way(3, N.singular("n")), way(4, N.word_bag(N.singular("n"))), way(5, bare), way(5, F.when(F.col("own"), F.col("n"))))
    offered = terms.select("id", F.explode(keys).alias("k")).select("id", "k.way", "k.key").where("key is not null and key != ''")
    offered = offered.unionByName(aliases.select("id", F.lit(0).alias("way"), "key")).distinct()
    n = form("label")
    tries = F.array(way(0, label_key("label")), way(1, n), way(2, n), way(3, N.singular(n)), way(4, N.word_bag(N.singular(n))), way(5, n), way(5, N.unqualified(n, list(qualifiers))))
    asked = labels.select("label").distinct()
    found = asked.select("label", F.explode(tries).alias("k")).select("label", "k.way", "k.key").distinct().join(offered, ["way", "key"])
    best = found.groupBy("label", "way").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).groupBy("label").agg(F.min_by(F.struct("n", "id", "way"), "way").alias("b"))
    how = F.when(F.col("b.n") > 1, "ambiguous").otherwise(F.element_at(F.array(*map(F.lit, WAYS)), F.col("b.way") + 1))
    told = best.select("label", F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"), how.alias("how"))
    return asked.join(told, "label", "left")


def placement_counts(matched: DataFrame) -> DataFrame:
    """(how, labels): labels by the way they were placed; those that weren't are 'unmatched'."""
    return matched.groupBy(F.coalesce("how", F.lit("unmatched")).alias("how")).agg(F.count(F.lit(1)).alias("labels"))


def methods_text(counts: DataFrame) -> str:
    """One sentence on how labels were placed, in the order of the ways."""
    n = {r["how"]: r["labels"] for r in counts.collect()}  # a row a way
    parts = [f"{n[w]} by {w}" for w in WAYS if n.get(w)] + [f"{n[w]} {w}" for w in ("ambiguous", "unmatched") if n.get(w)]
    return f"Of {sum(n.values())} labels {', '.join(parts)}." if n else "No labels were placed."


def kind_words(names: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(word, pairs, kinds, share): over pairs of names that differ by one word, how often the longer name's term lies below the shorter's.

    A bag is joined with the bags that lack one of its words, so no two names are compared otherwise.
    """
    bags = names.select("id", N.words(N.normalise("name")).alias("w")).where("size(w) > 0")
    bags = bags.select("id", F.sort_array("w").alias("w"))
    dropped = bags.where("size(w) > 1").select(F.col("id").alias("long"), "w", F.posexplode("w").alias("at", "word"))
    shorter = dropped.select("long", "word", F.array_join(F.expr("filter(w, (x, i) -> i != at)"), " ").alias("bag")).distinct()
    pairs = shorter.join(bags.select(F.col("id").alias("short"), F.array_join("w", " ").alias("bag")), "bag").where("long != short").select("word", "long", "short").distinct()
    below = ancestors.where("id != anc").select(F.col("id").alias("long"), F.col("anc").alias("short"), F.lit(1).alias("kind")).distinct()
    return pairs.join(below, ["long", "short"], "left").groupBy("word").agg(F.count(F.lit(1)).alias("pairs"), F.count("kind").alias("kinds")).withColumn("share", F.col("kinds") / F.col("pairs"))


def species(features: DataFrame, name: str = "feature") -> str | None:
    """'human' or 'mouse' by accession prefixes, else by the letter case of symbols; a tie is none."""
    c = F.col(name)
    votes = features.agg(
        F.count_if(c.rlike(r"^ENSG\d")).alias("h"), F.count_if(c.rlike(r"^ENSMUSG\d")).alias("m"),
        F.count_if(c.rlike(r"^[A-Z][A-Z0-9-]+$") & ~c.rlike("^ENS")).alias("upper"), F.count_if(c.rlike(r"^[A-Z][a-z0-9-]*[a-z][a-z0-9-]*$")).alias("title"),
    ).first()
    a, b = (votes["h"], votes["m"]) if votes["h"] or votes["m"] else (votes["upper"], votes["title"])
    return None if a == b else "human" if a > b else "mouse"


def merge_rules(*layers: str) -> dict:
    """JSON layers merged as RFC 7396 patches, later ones first; keys that start with ``_doc`` are left out."""

    def patch(base, more):
        if not isinstance(more, dict):
            return more
        out = dict(base) if isinstance(base, dict) else {}
        for key, value in more.items():
            if key.startswith("_doc"):
                continue
            if value is None:
                out.pop(key, None)
            else:
                out[key] = patch(out.get(key), value)
        return out

    rules: dict = {}
    for layer in layers:
        read = json.loads(layer)
        if not isinstance(read, dict):
            raise ValueError("a layer of rules is one JSON object")
        rules = patch(rules, read)
    return rules


def prepared(vectors: DataFrame, how: str, key: str = "obs", vec: str = "vec") -> DataFrame:
    """Vectors by geometry: ``l2`` of length one, ``z`` by column (population deviation), ``exp_z`` the same after exp; a constant column is 0."""
    rows = vectors.where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("v"))
    if how == "l2":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
        return rows.select(key, F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias(vec))
    if how not in ("z", "exp_z"):
        raise ValueError(f"no such geometry: {how}")
    if how == "exp_z":
        rows = rows.select(key, F.transform("v", lambda x: F.exp(x)).alias("v"))
    columns = rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    packed = columns.agg(F.sort_array(F.collect_list(F.struct("dim", "m", "s"))).alias("c"))  # a row a dimension
    scaled = F.zip_with("v", "c", lambda x, c: F.when(c["s"] > 0, (x - c["m"]) / c["s"]).otherwise(0.0))
    return rows.crossJoin(F.broadcast(packed)).select(key, scaled.alias(vec))


def whitened(vectors: DataFrame, centre: DataFrame, covariance: DataFrame, key: str = "obs", vec: str = "vec") -> DataFrame:
    """Vectors less the centre (k, centre), times the inverse root of the covariance (i, j, cov; i <= j).

    Eigenvalues below a millionth of the largest are raised to it.  Only the matrix, whose size is
    that of one vector squared, comes to the driver.
    """
    c = {r["k"]: r["centre"] for r in centre.collect()}
    m = np.zeros((len(c), len(c)))
    for r in covariance.collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["cov"]
    values, axes = np.linalg.eigh(m)
    root = axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6 * max(values.max(initial=0.0), 1e-300)))) @ axes.T
    middle = np.array([c[k] for k in sorted(c)])

    @F.pandas_udf("array<double>")
    def apply(rows):
        import pandas as pd

        return pd.Series(list((np.array(rows.tolist(), float).reshape(len(rows), -1) - middle) @ root), index=rows.index) if len(rows) else rows

    return vectors.where(F.col(vec).isNotNull()).select(key, apply(vec).alias(vec))
