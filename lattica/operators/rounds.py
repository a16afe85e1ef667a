"""Curation rounds: decisions applied to groups, history, and checks of calls against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def refusals(decisions: DataFrame, groups: DataFrame) -> DataFrame:
    """(line, reason) of each decision that breaks a rule; a round applies only if this is empty."""
    known = groups.select(F.col("grp").alias("_g"), F.lit(True).alias("_known"))
    marker = F.col("action").isin("markers_add", "markers_drop")
    one = decisions.select("line", F.explode_outer("groups").alias("_g"), "action").join(known, "_g", "left")
    unknown = one.where("_g is not null and _known is null").select("line", F.lit("no such group").alias("reason"))
    twice = one.where("_g is not null and action not in ('markers_add', 'markers_drop')").withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("line"))).where("_n > 1").select("line", F.lit("group decided twice").alias("reason"))
    n = F.coalesce(F.size("groups"), F.lit(0))
    reason = (
        F.when(F.coalesce(F.trim("rationale"), F.lit("")) == "", "no rationale")
        .when(marker & (n > 0), "a marker edit names no groups")
        .when(marker & (F.col("label").isNull() | (F.coalesce(F.size("features"), F.lit(0)) < 1)), "a marker edit needs a label and features")
        .when((F.col("action") == "label") & ((n != 1) | F.col("label").isNull()), "a label takes one group and a label")
        .when((F.col("action") == "merge") & (n < 2), "a merge takes two groups")
        .when(~F.col("action").isin("label", "merge", "keep", "markers_add", "markers_drop"), "no such action")
    )
    own = decisions.select("line", reason.alias("reason")).where("reason is not null")
    return own.unionByName(unknown).unionByName(twice).distinct()


def next_group_id(groups: DataFrame, history: DataFrame) -> DataFrame:
    """One more than any id in use or in the history."""
    return groups.select("grp").unionByName(history.select("grp")).agg((F.coalesce(F.max("grp"), F.lit(-1)) + 1).alias("next_id"))


def apply_decisions(decisions: DataFrame, cells: DataFrame, history: DataFrame) -> DataFrame:
    """(obs, grp, label) after the round: merges take new ids in order of their lines, labels replace labels."""
    start = next_group_id(cells, history)
    merges = decisions.where("action = 'merge'").withColumn("_k", F.row_number().over(Window.orderBy("line")) - 1)  # a row per merge of one round
    into = merges.crossJoin(start).select(F.explode("groups").alias("grp"), (F.col("next_id") + F.col("_k")).cast("int").alias("_into"), F.col("label").alias("_merged"))
    named = decisions.where("action = 'label'").select(F.element_at("groups", 1).alias("grp"), F.col("label").alias("_named"))
    joined = cells.join(into, "grp", "left").join(named, "grp", "left")
    return joined.select("obs", F.coalesce("_into", "grp").alias("grp"), F.coalesce("_named", "_merged", "label").alias("label"))


def history_of(decisions: DataFrame, cells: DataFrame, history: DataFrame, round_no: int) -> DataFrame:
    """(grp, round, action, merged_from, merged_into) entries of a round, before the older ones."""
    start = next_group_id(cells, history)
    merges = decisions.where("action = 'merge'").withColumn("_k", F.row_number().over(Window.orderBy("line")) - 1).crossJoin(start)
    new_id = (F.col("next_id") + F.col("_k")).cast("int")
    old = merges.select(F.explode("groups").alias("grp"), F.lit("merge").alias("action"), F.lit(None).cast("array<int>").alias("merged_from"), new_id.alias("merged_into"))
    new = merges.select(new_id.alias("grp"), F.lit("merge").alias("action"), F.sort_array("groups").alias("merged_from"), F.lit(None).cast("int").alias("merged_into"))
    rest = decisions.where("action in ('label', 'keep')").select(F.explode("groups").alias("grp"), "action", F.lit(None).cast("array<int>").alias("merged_from"), F.lit(None).cast("int").alias("merged_into"))
    fresh = old.unionByName(new).unionByName(rest).withColumn("round", F.lit(round_no))
    return fresh.unionByName(history, allowMissingColumns=True)


def last_edit_wins(edits: DataFrame) -> DataFrame:
    """Pending edits of a group: the last label or keep; every marker edit stays, marker edits first."""
    marker = F.col("action").isin("markers_add", "markers_drop")
    last = edits.where(~marker).withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    both = edits.where(marker).unionByName(last)
    return both.withColumn("position", F.row_number().over(Window.orderBy(~F.col("action").isin("markers_add", "markers_drop"), "seq")))


def evidence_agrees(labels: DataFrame, tied: DataFrame, members: DataFrame) -> DataFrame:
    """Whether a group's label is among its calls tied at the top; a coarse label agrees through its members."""
    fine = labels.join(tied, "grp", "left").join(members.select(F.col("label").alias("class"), "coarse"), "class", "left")
    hit = (F.col("label") == F.col("class")) | (F.col("label") == F.col("coarse"))
    return fine.groupBy("grp").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("agrees"))


def cells_by_label(cells: DataFrame) -> DataFrame:
    """Observations of each label, unassigned last."""
    n = cells.groupBy(F.coalesce("label", F.lit("unassigned")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("position", F.row_number().over(Window.orderBy(F.col("label") == "unassigned", F.desc("n"), "label")))
