"""Labels and calls: keys, shares, digests, rankings, joins by name, evidence and FDR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_key(label: str | Column) -> Column:
    """Words between white space, commas and underscores, joined by underscores."""
    c = F.col(label) if isinstance(label, str) else label
    return F.array_join(F.filter(F.split(c, r"[\s,_]+"), lambda w: w != ""), "_")


def group_id(text: str | Column) -> Column:
    """12, K12 or C12 as an integer; null for anything else."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract(c, r"^\s*[KC]?(\d+)\s*$", 1)
    return F.when(found != "", found).cast("int")


def call_shares(cells: DataFrame, calls: DataFrame) -> DataFrame:
    """Fraction of a group's observations called each label; unassigned ones count in the denominator alone."""
    joined = cells.select("obs", "grp").where("grp is not null").join(calls.select("obs", "label"), "obs", "left")
    n = joined.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))
    return share.where("label is not null and label != 'unassigned'").select("grp", "label", "share")


def group_digest(cells: DataFrame, calls: DataFrame) -> DataFrame:
    """Size and majority label of each group; ties go to the smaller label."""
    joined = cells.select("obs", "grp").where("grp is not null").join(calls, "obs", "left")
    n = joined.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("grp").orderBy(F.col("label").isNull(), F.desc("n"), "label")
    size = F.sum("n").over(Window.partitionBy("grp"))
    return n.select("grp", size.alias("size"), "label", F.row_number().over(by).alias("r")).where("r = 1").select("grp", "size", "label")


def coarse_call(shares: DataFrame, members: DataFrame) -> DataFrame:
    """The coarse class with the largest summed share; ties go to the smaller name."""
    summed = shares.join(members, "label").groupBy("grp", "coarse").agg(F.sum("share").alias("share"))
    by = Window.partitionBy("grp").orderBy(F.desc(F.round("share", 9)), "coarse")
    return summed.withColumn("r", F.row_number().over(by)).where("r = 1").select("grp", "coarse", "share")


def first_hits(labels: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One label for each key: the first in ``order``, else the smallest; null labels take no part."""
    return labels.where("label is not null").groupBy(key).agg(F.min_by("label", F.struct(*([order] if order else []), "label")).alias("label"))


def left_labels(cells: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """Observations with their label (the first hit) or 'unassigned'; if no observation has a label at all, an error."""
    one = first_hits(labels, "obs", order)
    if cells.select("obs").join(one, "obs", "left_semi").isEmpty() and not cells.isEmpty():
        raise ValueError("no observation has a label")
    return cells.select("obs").join(one, "obs", "left").select("obs", F.coalesce("label", F.lit("unassigned")).alias("label"))


def fallback_labels(names: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """Labels by barcode@sample, else by the bare barcode; of several labels of a key the first hit counts."""
    labels = first_hits(labels, "key", order)
    full = labels.select(F.col("key").alias("name"), F.col("label").alias("_full"))
    bare = labels.select(F.col("key").alias("_bare"), F.col("label").alias("_label"))
    joined = names.join(full, "name", "left").withColumn("_bare", F.split_part("name", F.lit("@"), F.lit(1))).join(bare, "_bare", "left")
    return joined.select("name", F.coalesce("_full", "_label").alias("label"))


#: Parts into which a key's rows are dealt where all of them meet, and partitions of that join.
DEALT = 64


def align_repeats(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of equal keys: the n-th goes with the n-th where both sides have as many, else with all.

    Only keys with as many rows on both sides are numbered.  The pairs of the others grow with the square of
    a key's rows, so its left rows are dealt into ``DEALT`` parts, each of which meets all right rows.
    """
    sizes = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    keys = sizes(left, "l_count").join(sizes(right, "r_count"), key)
    same, other = keys.where("l_count = r_count").select(key), keys.where("l_count != r_count").select(key)
    numbered = lambda df, order: df.join(same, key, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    aligned = numbered(left, left_order).join(numbered(right, right_order), [key, "_n"]).drop("_n")
    part = F.pmod(F.xxhash64(left_order), F.lit(DEALT)).cast("int")
    # A number of partitions that isn't lowered at run time: what goes in is small, what comes out isn't.
    each = left.join(other, key, "left_semi").withColumn("_part", part).repartition(4 * DEALT, key, "_part")
    every = right.join(other, key, "left_semi").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).repartition(4 * DEALT, key, "_part")
    crossed = each.join(every.hint("merge"), [key, "_part"]).drop("_part")
    return aligned.unionByName(crossed)


def evidence(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Full outer join of statistic tables on ``key`` by one union and one pivot; NaN is not scored."""
    stacked = None
    for stat, df in tables.items():
        value = F.col("value").cast("double")
        one = df.select(*key, F.lit(stat).alias("stat"), F.when(~F.isnan(value), value).alias("value")).where("value is not null")
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy(*key).pivot("stat", list(tables)).agg(F.first("value"))


def bh(tests: DataFrame, family: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """Benjamini-Hochberg within families; null and NaN values take no part and stay null."""
    clean = F.when(~F.isnan(p), F.col(p))
    some = tests.withColumn("_p", clean)
    by = Window.partitionBy(*family, F.col("_p").isNull()).orderBy("_p")
    size = Window.partitionBy(*family, F.col("_p").isNull())
    # From the largest p down, so that the least of the tail is a running minimum and not made anew for each row.
    tail = Window.partitionBy(*family, F.col("_p").isNull()).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = some.withColumn("_r", F.rank().over(by) + F.count(F.lit(1)).over(Window.partitionBy(*family, "_p")) - 1).withColumn("_m", F.count(F.lit(1)).over(size))
    value = F.least(F.min(F.col("_p") * F.col("_m") / F.col("_r")).over(tail), F.lit(1.0))
    return ranked.withColumn(q, F.when(F.col("_p").isNotNull(), value)).drop("_p", "_r", "_m")


def ranked_methods(evidence_rows: DataFrame, group: str = "grp", reading: str = "share", q: str = "q", nes: str = "nes", label: str = "class") -> DataFrame:
    """Reading from the largest, then q from the smallest, NES from the largest; unknown last, ties by name."""
    by = Window.partitionBy(group).orderBy(F.desc_nulls_last(reading), F.asc_nulls_last(q), F.desc_nulls_last(nes), label)
    return evidence_rows.withColumn("rank", F.row_number().over(by))


def top_calls(calls: DataFrame, group: str = "grp", q: str = "q") -> DataFrame:
    """All calls tied at a group's smallest q."""
    return calls.where(F.col(q).isNotNull()).withColumn("_r", F.rank().over(Window.partitionBy(group).orderBy(q))).where("_r = 1").drop("_r")


def next_foil(ranked: DataFrame, group: str = "grp", label: str = "class", rank: str = "rank") -> DataFrame:
    """The one listed next; for the last one the one before."""
    by = Window.partitionBy(group).orderBy(rank)
    return ranked.withColumn("foil", F.coalesce(F.lead(label).over(by), F.lag(label).over(by), F.first(label).over(by)))


def stars(alignment: DataFrame, group: str = "grp", score: str = "score", q: str = "q", name: str = "term", most: int = 6, level: float = 0.05) -> DataFrame:
    by = Window.partitionBy(group).orderBy(F.desc(score), name)
    return alignment.where(F.col(q) < level).withColumn("star", F.row_number().over(by)).where(F.col("star") <= most)


def method_disagreement(evidence_rows: DataFrame, methods: list[str], group: str = "grp", label: str = "class") -> DataFrame:
    """Each method's first choice, and whether the choices differ."""
    picks = [F.max_by(label, F.when(F.col(m).isNotNull(), F.struct(F.round(m, 9), F.lit(0) - F.col("_order")))).alias(m) for m in methods]
    ordered = evidence_rows.withColumn("_order", F.dense_rank().over(Window.partitionBy(group).orderBy(label)))
    first = ordered.groupBy(group).agg(*picks)
    return first.withColumn("disagree", F.size(F.array_distinct(F.array_compact(F.array(*methods)))) > 1)


def running_union(ranked_terms: DataFrame, group: str = "grp", term: str = "term", rank: str = "rank") -> DataFrame:
    """Top terms shown once, in the order of the groups that list them first."""
    first = ranked_terms.groupBy(term).agg(F.min(F.struct(group, rank)).alias("at"))
    order = Window.orderBy("at", term)  # a row per shown term
    return first.select(term, F.col(f"at.{group}").alias(group), F.row_number().over(order).alias("position"))


def distinct_shared(panel: DataFrame, fact: str, foil: str) -> DataFrame:
    """Features of two classes: in the first alone, in the second alone, or shared."""
    a, b = (panel.where(F.col("class") == c).select("feature") for c in (fact, foil))
    tagged = lambda df, t: df.withColumn("side", F.lit(t))
    return tagged(a.subtract(b), "fact").unionByName(tagged(b.subtract(a), "foil")).unionByName(tagged(a.intersect(b), "shared"))


def panel_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    added = after.subtract(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.subtract(after).withColumn("change", F.lit("dropped")))


def touched_classes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Classes of edited pairs, and classes that share an edited feature."""
    edited = panel_diff(before, after).select("feature", "class")
    sharing = before.unionByName(after).join(edited.select("feature"), "feature", "left_semi").select("class")
    return edited.select("class").unionByName(sharing).distinct()
