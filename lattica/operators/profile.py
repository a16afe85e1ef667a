"""Group profiles from sparse counts: sums, weights, folds, shares and their rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def feature_sums(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Sums over two groupings in one sweep: (kind, key, feature, value), kind is group or batch; observations without one take no part in its sums."""
    joined = counts.join(cells, "obs")
    sets = joined.groupingSets([["grp", "feature"], ["batch", "feature"]], "grp", "batch", "feature")
    summed = sets.agg(F.sum("value").alias("value"), F.grouping_id().alias("_g"))
    by_group = F.expr("_g & 4") == 0  # the bit of grp in the grouping id
    present = F.when(by_group, F.col("grp").isNotNull()).otherwise(F.col("batch").isNotNull())
    return summed.where(present).select(
        F.when(by_group, "group").otherwise("batch").alias("kind"), F.coalesce(F.col("grp").cast("string"), F.col("batch")).alias("key"), "feature", "value"
    )


def group_sums(counts: DataFrame, cells: DataFrame) -> DataFrame:
    return counts.join(cells.select("obs", "grp"), "obs").where("grp is not null").groupBy("grp", "feature").agg(F.sum("value").alias("value"))


def weighted_profile(sums: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(grp, feature, mu): a feature's weighted share of its group's total, the total at least 1."""
    share = F.col("value") / F.greatest(F.sum("value").over(Window.partitionBy("grp")), F.lit(1.0))
    out = sums.withColumn("mu", share)
    if weights is not None:
        out = out.join(weights, "feature", "left").withColumn("mu", F.col("mu") * F.coalesce("weight", F.lit(1.0)))
    return out.select("grp", "feature", "mu")


def batch_membership(cells: DataFrame) -> DataFrame:
    """Fractions of each batch's observations in each group."""
    n = cells.groupBy("batch", "grp").agg(F.count(F.lit(1)).alias("n"))
    return n.select("batch", "grp", (F.col("n") / F.sum("n").over(Window.partitionBy("batch"))).alias("share"))


def empirical_specificity(profile: DataFrame, n_groups: int) -> DataFrame:
    """((max / sum) - 1/K) / (1 - 1/K) of each feature over groups, within 0 and 1."""
    base = 1.0 / n_groups
    agg = profile.groupBy("feature").agg(F.max("mu").alias("top"), F.sum("mu").alias("total"))
    raw = (F.col("top") / F.col("total") - F.lit(base)) / F.lit(1 - base)
    return agg.select("feature", F.when(F.col("total") > 0, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0)).alias("specificity"))


def panel_idf(panel: DataFrame) -> DataFrame:
    """ln(C / classes of the feature); 0 where every class claims it."""
    n = panel.agg(F.countDistinct("class").alias("c"))
    per = panel.groupBy("feature").agg(F.countDistinct("class").alias("n"))
    return per.crossJoin(n).select("feature", F.log(F.col("c") / F.col("n")).alias("idf"))  # n is one row


def log2_fold_change(profile: DataFrame, n_groups: int, n_features: int) -> DataFrame:
    """log2((mean inside + e) / (mean of the other groups + e)); e is the table's mean, absent rows are zeros."""
    mean = profile.agg((F.sum("mu") / F.lit(n_groups * n_features)).alias("e"))
    total = profile.groupBy("feature").agg(F.sum("mu").alias("total"))
    joined = profile.join(total, "feature").crossJoin(mean)
    others = (F.col("total") - F.col("mu")) / F.lit(n_groups - 1)
    return joined.select("grp", "feature", F.log2((F.col("mu") + F.col("e")) / (others + F.col("e"))).alias("log2fc"), "mu")


def specific_features(profile: DataFrame, folds: DataFrame, n_features: int, top: int = 5) -> DataFrame:
    """Features above their group's mean level, by fold change; ties go to the smaller feature."""
    mean = F.sum("mu").over(Window.partitionBy("grp")) / F.lit(n_features)
    above = folds.withColumn("_mean", mean).where(F.col("mu") > F.col("_mean"))
    by = Window.partitionBy("grp").orderBy(F.desc(F.round("log2fc", 9)), "feature")
    return above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("grp", "rank", "feature", "log2fc")


def top_specific(profile: DataFrame, n_groups: int, top: int = 3, quantile: float = 0.9) -> DataFrame:
    """Of the features over the floor, an order statistic of those expressed, the largest against the mean of other groups."""
    level = profile.withColumn("level", F.log1p(F.lit(1e4) * F.col("mu"))).where("mu > 0")
    rank = Window.partitionBy("grp").orderBy("level", "feature")
    size = Window.partitionBy("grp")
    placed = level.withColumn("_i", F.row_number().over(rank) - 1).withColumn("_n", F.count(F.lit(1)).over(size))
    floors = placed.where(F.col("_i") == F.least(F.floor(F.lit(quantile) * F.col("_n")), F.col("_n") - 1)).select("grp", F.col("level").alias("floor"))
    total = level.groupBy("feature").agg(F.sum("level").alias("total"))
    fold = F.col("level") - (F.col("total") - F.col("level")) / F.lit(n_groups - 1)
    kept = level.join(floors, "grp").where("level >= floor").join(total, "feature").withColumn("fold", fold)
    by = Window.partitionBy("grp").orderBy(F.desc(F.round("fold", 9)), "feature")
    return kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("grp", "rank", "feature", "fold")


def detected_share(counts: DataFrame, cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fraction of a group's observations that count a wanted feature; features are pruned before the join."""
    size = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    kept = counts.where("value > 0").join(wanted, "feature", "left_semi").join(cells.select("obs", "grp"), "obs")
    seen = kept.groupBy("grp", "feature").agg(F.countDistinct("obs").alias("n"))
    return seen.join(size, "grp").select("grp", "feature", (F.col("n") / F.col("size")).alias("detected"))


def drop_small_groups(cells: DataFrame, least: int) -> DataFrame:
    """(obs, grp, compact): groups under ``least`` observations become unassigned, others are numbered anew."""
    kept = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).where("grp is not null")
    ids = kept.withColumn("compact", F.row_number().over(Window.orderBy("grp")) - 1).select("grp", "compact")  # a row per group
    return cells.join(ids, "grp", "left").select("obs", "grp", F.col("compact").cast("int").alias("compact"))


def softmax_shares(values: DataFrame, key: str, value: str) -> DataFrame:
    by = Window.partitionBy(key)
    e = F.exp(F.col(value) - F.max(value).over(by))
    return values.withColumn("_e", e).withColumn("share", F.col("_e") / F.sum("_e").over(by)).drop("_e")


def row_zscores(profile: DataFrame, n_groups: int, clip: float = 3.0) -> DataFrame:
    """z of a feature across groups (population deviation, absent groups are zeros, 0 where flat), clipped."""
    agg = profile.groupBy("feature").agg(F.sum("mu").alias("s"), F.sum(F.col("mu") * F.col("mu")).alias("ss"))
    mean = F.col("s") / n_groups
    sd = F.sqrt(F.greatest(F.col("ss") / n_groups - mean * mean, F.lit(0.0)))
    z = F.when(sd > 1e-12, (F.col("mu") - mean) / sd).otherwise(0.0)
    return profile.join(agg, "feature").select("grp", "feature", F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)).alias("z"))


def regroup_sums(sums: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sums of merged groups: (grp, new_grp) maps, sums add."""
    return sums.join(mapping, "grp").groupBy("new_grp", "feature").agg(F.sum("value").alias("value"))


def regroup_profile(profile: DataFrame, cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """A new group's profile: the mean of those its observations came from, weighted by them."""
    n = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(mapping, "grp")
    total = n.groupBy("new_grp").agg(F.sum("n").alias("total"))
    weighted = profile.join(n, "grp").groupBy("new_grp", "feature").agg(F.sum(F.col("mu") * F.col("n")).alias("s"))
    return weighted.join(total, "new_grp").select("new_grp", "feature", (F.col("s") / F.col("total")).alias("mu"))


def module_scores(profile: DataFrame, panel: DataFrame, n_groups: int) -> DataFrame:
    """(grp, class, score): idf-weighted mean over a class's features of z(log1p(1e4 mu)) across groups, absent rows being zeros."""
    level = profile.select("grp", "feature", F.log1p(F.lit(1e4) * F.col("mu")).alias("mu"))
    agg = level.groupBy("feature").agg(F.sum("mu").alias("s"), F.sum(F.col("mu") * F.col("mu")).alias("ss"))
    mean = F.col("s") / n_groups
    sd = F.sqrt(F.greatest(F.col("ss") / n_groups - mean * mean, F.lit(0.0)))
    flat = agg.select("feature", mean.alias("mean"), sd.alias("sd")).where("sd > 1e-12")
    weighted = panel.join(panel_idf(panel), "feature").join(flat, "feature")
    # z of a zero level is -mean/sd: a class's score begins there and present rows add level/sd.
    base = weighted.groupBy("class").agg(F.sum("idf").alias("w"), F.sum(-F.col("idf") * F.col("mean") / F.col("sd")).alias("base"))
    present = level.join(weighted, "feature").groupBy("grp", "class").agg(F.sum(F.col("idf") * F.col("mu") / F.col("sd")).alias("above"))
    groups = profile.select("grp").distinct()
    grid = groups.crossJoin(base.where("w > 0"))  # groups by classes, both few
    return grid.join(present, ["grp", "class"], "left").select("grp", "class", ((F.col("base") + F.coalesce("above", F.lit(0.0))) / F.col("w")).alias("score"))


def best_class(scores: DataFrame) -> DataFrame:
    by = Window.partitionBy("grp").orderBy(F.desc(F.round("score", 9)), "class")
    return scores.withColumn("rank", F.row_number().over(by)).where("rank = 1").select("grp", "class", "score")


def term_effects(sums: DataFrame, terms: DataFrame, n_groups: int) -> DataFrame:
    """Mean of log1p(CP10K) in a term's features less that of the other annotated ones, less its median over groups."""
    level = sums.select("grp", "feature", F.log1p(1e4 * F.col("value") / F.sum("value").over(Window.partitionBy("grp"))).alias("x"))
    universe = terms.select("feature").distinct()
    n_all = universe.agg(F.count(F.lit(1)).alias("n_all"))
    total = level.join(universe, "feature", "left_semi").groupBy("grp").agg(F.sum("x").alias("all_x"))
    members = terms.distinct()
    size = members.groupBy("term").agg(F.count(F.lit(1)).alias("n_in"))
    inside = level.join(members, "feature").groupBy("grp", "term").agg(F.sum("x").alias("in_x"))
    grid = total.crossJoin(size).crossJoin(n_all).join(inside, ["grp", "term"], "left").withColumn("in_x", F.coalesce("in_x", F.lit(0.0)))
    raw = F.col("in_x") / F.col("n_in") - (F.col("all_x") - F.col("in_x")) / (F.col("n_all") - F.col("n_in"))
    effect = grid.where("n_all > n_in").select("grp", "term", raw.alias("raw"))
    middle = effect.groupBy("term").agg(F.expr("percentile(raw, 0.5)").alias("middle"))
    return effect.join(middle, "term").select("grp", "term", (F.col("raw") - F.col("middle")).alias("effect"))


def level_rows(rows: DataFrame) -> DataFrame:
    """One row per gene: plain or requested channel, spliced, total, other counts, other; ties by row order."""
    parts = F.split("row_name", "/")
    channel = F.when(F.size(parts) == 1, "").otherwise(F.element_at(parts, -1))
    rank = F.when(channel == "", 0).when(channel == "spliced", 1).when(channel == "total", 2).when(channel == "unspliced", 3).otherwise(5)
    named = rows.select("row_index", "row_name", F.element_at(parts, 1).alias("gene"), rank.alias("channel_rank"))
    by = Window.partitionBy("gene").orderBy("channel_rank", "row_index")
    return named.withColumn("n", F.row_number().over(by)).where("n = 1").select("gene", "row_index", "row_name", "channel_rank")
