"""Call, label, evidence and decision queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import labels as L
from lattica.operators import rounds as R
from lattica.plans import expression as E
from lattica.sources import tables as T
from lattica.sources.tables import with_inputs

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_MEMBERS = "members AS (SELECT DISTINCT p_type AS label, CASE WHEN p_type < 'L' THEN 'early' ELSE 'late' END AS coarse FROM part)"
_SHARES = "+ shares AS (SELECT grp, label, count(*) * 1.0 / any_value(size) AS share FROM cells JOIN calls USING (obs) JOIN (SELECT grp, count(*) AS size FROM cells GROUP BY 1) s USING (grp) GROUP BY 1, 2)"


def _members(spark, d):
    types = T.table(spark, d, "part").select(F.col("p_type").alias("label")).distinct()
    return types.withColumn("coarse", F.when(F.col("label") < "L", "early").otherwise("late"))


@query("label_key", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name, '[\\s,_]+'), lambda w: w <> ''), '_') AS key FROM part")
def label_key(spark, d):
    return T.table(spark, d, "part").select("p_partkey", L.label_key("p_name").alias("key"))


@query("call_shares", with_inputs(_SHARES + " SELECT grp, label, round(share, 6) AS share FROM shares", "cells", "calls"))
def call_shares(spark, d):
    return E.r6(L.call_shares(T.cells(spark, d), T.calls(spark, d)), "share")


@query("group_digest", with_inputs("""+ n AS (SELECT grp, label, count(*) AS n FROM cells LEFT JOIN calls USING (obs) GROUP BY 1, 2)
    SELECT grp, (sum(n) OVER (PARTITION BY grp))::BIGINT AS size, label FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY label IS NULL, n DESC, label) = 1""", "cells", "calls"))
def group_digest(spark, d):
    return L.group_digest(T.cells(spark, d), T.calls(spark, d))


@query("coarse_call", with_inputs(_SHARES + ", " + _MEMBERS + """, c AS (SELECT grp, coarse, sum(share) AS share FROM shares JOIN members USING (label) GROUP BY 1, 2)
    SELECT grp, coarse, round(share, 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(share, 9) DESC, coarse) = 1""", "cells", "calls"))
def coarse_call(spark, d):
    return E.r6(L.coarse_call(L.call_shares(T.cells(spark, d), T.calls(spark, d)), _members(spark, d)), "share")


@query("left_outer_labels", with_inputs("SELECT obs, coalesce(label, 'unassigned') AS label FROM cells LEFT JOIN calls USING (obs)", "cells", "calls"))
def left_outer_labels(spark, d):
    return L.left_labels(T.cells(spark, d), T.calls(spark, d))


@query("fallback_key_join", """
    WITH names AS (SELECT c_name || CASE WHEN c_custkey % 2 = 0 THEN '@' || c_mktsegment ELSE '' END AS name FROM customer),
    labels AS (SELECT c_name || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN '@' || c_mktsegment ELSE '' END AS key, c_custkey % 7 AS label FROM customer)
    SELECT name, coalesce(f.label, b.label) AS label FROM names LEFT JOIN labels f ON f.key = name LEFT JOIN labels b ON b.key = split_part(name, '@', 1)""")
def fallback_key_join(spark, d):
    c = T.table(spark, d, "customer")
    at = F.concat(F.lit("@"), F.col("c_mktsegment"))
    names = c.select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, at).otherwise("")).alias("name"))
    keys = c.select(F.concat("c_name", F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 2 == 0), at).otherwise("")).alias("key"), (F.col("c_custkey") % 7).alias("label"))
    return L.fallback_labels(names, keys)


@query("repeated_key_align", """
    WITH l AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey) AS c FROM customer),
    r AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier)
    SELECT k, c_custkey, s_suppkey FROM l JOIN r USING (k) WHERE l.c <> r.c OR l.n = r.n""")
def repeated_key_align(spark, d):
    left = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    right = T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return L.align_repeats(left, right, "k", "c_custkey", "s_suppkey")


def _evidence(spark, d):
    """share from calls, fold from log means, score from module scores, all on (grp, class)."""
    share = L.call_shares(T.cells(spark, d), T.calls(spark, d)).select("grp", F.col("label").alias("class"), F.col("share").alias("value"))
    score = E.scores(spark, d).select("grp", "class", F.col("score").alias("value"))
    sums = E._sums(spark, d).join(T.panel(spark, d), "feature").groupBy("grp", "class").agg(F.sum("value").alias("value"))
    return L.evidence({"share": share, "score": score, "total": sums}, ["grp", "class"])


_EVIDENCE = E._MODULE + ", " + _SHARES.removeprefix("+") + """, ev AS (
    SELECT grp, class, share, score, total FROM (SELECT grp, label AS class, share FROM shares) a
    FULL JOIN scores USING (grp, class) FULL JOIN (SELECT grp, class, sum(value) AS total FROM sums JOIN panel USING (feature) GROUP BY 1, 2) t USING (grp, class))"""
_EVIDENCE_NEEDS = ("profile", "panel", "idf", "n_groups", "calls")


@query("evidence_pivot", with_inputs(_EVIDENCE + " SELECT grp, class, round(share, 6) AS share, round(score, 6) AS score, total FROM ev", *_EVIDENCE_NEEDS))
def evidence_pivot(spark, d):
    return E.r6(_evidence(spark, d), "share", "score")


@query("method_ranking", with_inputs(_EVIDENCE + """ SELECT grp, class, row_number() OVER (PARTITION BY grp ORDER BY round(share, 9) DESC NULLS LAST, -round(score, 9) NULLS LAST, total DESC NULLS LAST, class) AS rank FROM ev""", *_EVIDENCE_NEEDS))
def method_ranking(spark, d):
    rows = _evidence(spark, d).select("grp", "class", F.round("share", 9).alias("share"), (-F.round("score", 9)).alias("q"), F.col("total").alias("nes"))
    return L.ranked_methods(rows).select("grp", "class", "rank")


@query("next_foil", with_inputs(_EVIDENCE + """, r AS (SELECT grp, class, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC NULLS LAST, class) AS rank FROM ev)
    SELECT grp, class, rank, coalesce(lead(class) OVER w, lag(class) OVER w, first(class) OVER w) AS foil FROM r WINDOW w AS (PARTITION BY grp ORDER BY rank)""", *_EVIDENCE_NEEDS))
def next_foil(spark, d):
    rows = _evidence(spark, d).select("grp", "class", F.round("score", 9).alias("share"), F.lit(None).cast("double").alias("q"), F.lit(None).cast("double").alias("nes"))
    return L.next_foil(L.ranked_methods(rows)).select("grp", "class", "rank", "foil")


@query("method_disagreement", with_inputs(_EVIDENCE + """, f AS (SELECT grp,
    first(class ORDER BY round(share, 9) DESC NULLS LAST, class) AS share, first(class ORDER BY round(score, 9) DESC NULLS LAST, class) AS score, first(class ORDER BY round(total, 9) DESC NULLS LAST, class) AS total FROM ev GROUP BY 1)
    SELECT *, NOT (share = score AND score = total) AS disagree FROM f""", *_EVIDENCE_NEEDS))
def method_disagreement(spark, d):
    return L.method_disagreement(_evidence(spark, d), ["share", "score", "total"])


_P = "t AS (SELECT l_returnflag AS family, l_suppkey AS id, CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE least(round(avg(l_discount) * 10, 3), 1) END AS p FROM lineitem GROUP BY 1, 2)"
_BH = _P + """, r AS (SELECT family, id, p, rank() OVER (PARTITION BY family ORDER BY p) + count(*) OVER (PARTITION BY family, p) - 1 AS r, count(*) OVER (PARTITION BY family) AS m FROM t WHERE p IS NOT NULL),
    q AS (SELECT family, id, least(min(p * m / r) OVER (PARTITION BY family ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM r)"""


def _tests(spark, d):
    avg = T.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("id")).agg(F.avg("l_discount").alias("a"))
    return avg.select("family", "id", F.when(F.col("id") % 17 != 0, F.least(F.round(F.col("a") * 10, 3), F.lit(1.0))).alias("p"))


@query("bh_fdr", f"WITH {_BH} SELECT t.family, t.id, round(q, 6) AS q FROM t LEFT JOIN q ON t.family = q.family AND t.id = q.id")
def bh_fdr(spark, d):
    return E.r6(L.bh(_tests(spark, d), ["family"]).select("family", "id", "q"), "q")


@query("tied_top_calls", f"WITH {_BH} SELECT family, id FROM q QUALIFY rank() OVER (PARTITION BY family ORDER BY round(q, 9)) = 1")
def tied_top_calls(spark, d):
    rows = L.bh(_tests(spark, d), ["family"]).withColumn("q", F.round("q", 9))
    return L.top_calls(rows, "family").select("family", "id")


@query("group_stars", f"WITH {_BH} SELECT family, id, row_number() OVER (PARTITION BY family ORDER BY p, id) AS star FROM q JOIN t USING (family, id) WHERE q < 0.6 QUALIFY star <= 6")
def group_stars(spark, d):
    rows = L.bh(_tests(spark, d), ["family"]).withColumn("score", -F.col("p"))
    return L.stars(rows, "family", "score", "q", "id", 6, 0.6).select("family", "id", "star")


@query("running_union_terms", with_inputs(E._EFFECT + """, x AS (SELECT grp, term, raw - median(raw) OVER (PARTITION BY term) AS e FROM r),
    k AS (SELECT grp, term, row_number() OVER (PARTITION BY grp ORDER BY round(e, 9) DESC, term) AS rank FROM x WHERE e > 0 QUALIFY rank <= 3),
    f AS (SELECT term, min(grp * 100 + rank) AS seat FROM k GROUP BY 1)
    SELECT term, (seat // 100)::INTEGER AS grp, row_number() OVER (ORDER BY seat, term) AS position FROM f""", "sums", "terms"))
def running_union_terms(spark, d):
    from pyspark.sql.window import Window

    effects = E.P.term_effects(E._sums(spark, d), T.terms(spark, d), 0).where("effect > 0")
    by = Window.partitionBy("grp").orderBy(F.desc(F.round("effect", 9)), "term")
    return L.running_union(effects.withColumn("rank", F.row_number().over(by)).where("rank <= 3"))


@query("set_distinct_shared", with_inputs("""
    SELECT feature, CASE WHEN count(*) = 2 THEN 'shared' WHEN any_value(class) = 'S1' THEN 'fact' ELSE 'foil' END AS side
    FROM panel WHERE class = 'S1' OR class = (SELECT min(p_type) FROM part) GROUP BY feature""", "panel"))
def set_distinct_shared(spark, d):
    foil = T.table(spark, d, "part").agg(F.min("p_type")).first()[0] or ""
    return L.distinct_shared(T.panel(spark, d), "S1", foil)


_AFTER = "after AS (SELECT feature, class FROM panel WHERE class <> 'S6' UNION SELECT feature + 1, class FROM panel WHERE class = 'S6')"


def _after(spark, d):
    p = T.panel(spark, d)
    return p.where("class != 'S6'").union(p.where("class = 'S6'").select(F.col("feature") + 1, "class")).distinct()


@query("panel_diff", with_inputs(f"+{_AFTER} SELECT feature, class, 'added' AS change FROM (FROM after EXCEPT FROM panel) UNION ALL SELECT feature, class, 'dropped' FROM (FROM panel EXCEPT FROM after)", "panel"))
def panel_diff(spark, d):
    return L.panel_diff(T.panel(spark, d), _after(spark, d))


@query("touched_classes", with_inputs(f"""+{_AFTER}, edited AS ((FROM after EXCEPT FROM panel) UNION (FROM panel EXCEPT FROM after))
    SELECT class FROM edited UNION SELECT class FROM panel WHERE feature IN (SELECT feature FROM edited) UNION SELECT class FROM after WHERE feature IN (SELECT feature FROM edited)""", "panel"))
def touched_classes(spark, d):
    return L.touched_classes(T.panel(spark, d), _after(spark, d))


@query("set_union_bag", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
def set_union_bag(spark, d):
    return T.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(T.table(spark, d, "supplier").select("s_nationkey"))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return T.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(T.table(spark, d, "supplier").select("s_nationkey"))


@query("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def set_except(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(T.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select("l_partkey"))


@query("semi_join_panel", with_inputs("SELECT obs, feature, value FROM counts WHERE feature IN (SELECT feature FROM panel WHERE class = 'S2')", "counts", "panel"))
def semi_join_panel(spark, d):
    return T.counts(spark, d).join(T.panel(spark, d).where("class = 'S2'"), "feature", "left_semi").select("obs", "feature", "value")


@query("term_reconcile", with_inputs("SELECT term, feature FROM terms WHERE feature IN (SELECT feature FROM counts) AND term IN (SELECT term FROM terms WHERE feature IN (SELECT feature FROM counts) GROUP BY 1 HAVING count(DISTINCT feature) BETWEEN 20 AND 500)", "terms", "counts"))
def term_reconcile(spark, d):
    matched = T.terms(spark, d).join(T.counts(spark, d).select("feature").distinct(), "feature", "left_semi").distinct()
    sized = matched.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n between 20 and 500").select("term")
    return matched.join(sized, "term", "left_semi").select("term", "feature")


_DECISIONS = """dec AS (SELECT r_regionkey + 1 AS line, CASE r_regionkey % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'label' ELSE 'keep' END AS action,
    CASE r_regionkey % 3 WHEN 0 THEN [r_regionkey * 5, r_regionkey * 5 + 1] ELSE [r_regionkey * 5] END AS groups, 'L_' || r_name AS label FROM region WHERE r_regionkey <= 4)"""


def _decisions(spark, d):
    r, k = T.table(spark, d, "region").where("r_regionkey <= 4"), F.col("r_regionkey")
    action = F.when(k % 3 == 0, "merge").when(k % 3 == 1, "label").otherwise("keep")
    groups = F.when(k % 3 == 0, F.array(k * 5, k * 5 + 1)).otherwise(F.array(k * 5))
    return r.select((k + 1).alias("line"), action.alias("action"), groups.alias("groups"), F.concat(F.lit("L_"), F.col("r_name")).alias("label"), F.lit("because").alias("rationale"), F.lit(None).cast("array<string>").alias("features"))


def _labelled(spark, d):
    return T.cells(spark, d).select("obs", "grp", F.lit(None).cast("string").alias("label"))


def _history(spark):
    return spark.createDataFrame([(30, 0, "merge")], "grp int, round int, action string")


_INTO = "m AS (SELECT groups, label, 31 + row_number() OVER (ORDER BY line) - 1 AS into_id FROM dec WHERE action = 'merge')"


@query("decisions_apply", with_inputs(f"+{_DECISIONS}, {_INTO} SELECT obs, coalesce(i.into_id, c.grp)::INTEGER AS grp, coalesce(n.label, i.label) AS label FROM cells c LEFT JOIN (SELECT unnest(groups) AS grp, into_id, label FROM m) i ON i.grp = c.grp LEFT JOIN (SELECT groups[1] AS grp, label FROM dec WHERE action = 'label') n ON n.grp = c.grp", "cells"))
def decisions_apply(spark, d):
    return R.apply_decisions(_decisions(spark, d), _labelled(spark, d), _history(spark))


#: Decisions that break a rule each, beside those of the round (which break none): line, action, groups, label, rationale, features, reason.
_BREAKING = [
    (101, "label", [2, 3], "x", "why", None, "a label takes one group and a label"),
    (102, "keep", [1000], None, "why", None, None),
    (103, "keep", [4], None, " ", None, "no rationale"),
    (104, "merge", [6], "y", "why", None, "a merge takes two groups"),
    (105, "explode", [7], None, "why", None, "no such action"),
    (106, "markers_add", [8], "z", "why", ["f"], "a marker edit names no groups"),
    (107, "markers_drop", [], "z", "why", [], "a marker edit needs a label and features"),
    (108, "keep", [0], None, "why", None, "group decided twice"),
]
_REASONS = ", ".join(f"({line}, '{reason}')" for line, *_, reason in _BREAKING if reason)
_NAMED = ", ".join(f"({line}, {g})" for line, _, groups, *_ in _BREAKING for g in groups)


@query("decision_refusals", f"""WITH {_DECISIONS}, named(line, grp) AS (SELECT line, unnest(groups) FROM dec UNION ALL VALUES {_NAMED})
    SELECT line::INTEGER AS line, reason FROM (VALUES {_REASONS}) v(line, reason) UNION SELECT line, 'no such group' FROM named WHERE grp NOT IN (SELECT c_nationkey FROM customer)""")
def decision_refusals(spark, d):
    schema = "line int, action string, groups array<int>, label string, rationale string, features array<string>, reason string"
    broken = spark.createDataFrame(_BREAKING, schema).drop("reason")
    return R.refusals(_decisions(spark, d).unionByName(broken), T.cells(spark, d).select("grp").distinct())


@query("history_merge", f"""WITH {_DECISIONS}, {_INTO}
    SELECT grp::INTEGER AS grp, action, merged_from, merged_into::INTEGER AS merged_into, round FROM (
    SELECT unnest(groups) AS grp, 'merge' AS action, NULL::VARCHAR AS merged_from, into_id AS merged_into, 1 AS round FROM m
    UNION ALL SELECT into_id, 'merge', array_to_string(list_sort(groups), ','), NULL, 1 FROM m
    UNION ALL SELECT unnest(groups), action, NULL, NULL, 1 FROM dec WHERE action <> 'merge' UNION ALL SELECT 30, 'merge', NULL, NULL, 0)""")
def history_merge(spark, d):
    rows = R.history_of(_decisions(spark, d), _labelled(spark, d), _history(spark), 1)
    return rows.withColumn("merged_from", F.array_join(F.col("merged_from").cast("array<string>"), ","))


@query("evidence_agrees", with_inputs(_EVIDENCE + ", " + _MEMBERS + """, top AS (SELECT grp, class FROM ev QUALIFY rank() OVER (PARTITION BY grp ORDER BY round(score, 2) DESC NULLS LAST) = 1),
    lab AS (SELECT grp, arg_max(label, row(share, label)) AS label FROM shares GROUP BY 1)
    SELECT lab.grp, coalesce(bool_or(lab.label = top.class OR lab.label = members.coarse), false) AS agrees FROM lab LEFT JOIN top USING (grp) LEFT JOIN members ON members.label = top.class GROUP BY 1""", *_EVIDENCE_NEEDS))
def evidence_agrees(spark, d):
    shares = L.call_shares(T.cells(spark, d), T.calls(spark, d))
    labels = shares.groupBy("grp").agg(F.max_by("label", F.struct("share", "label")).alias("label"))
    tied = L.top_calls(_evidence(spark, d).select("grp", "class", (-F.round("score", 2)).alias("q"))).select("grp", "class")
    return R.evidence_agrees(labels, tied, _members(spark, d))


@query("cells_by_label", with_inputs("""+ n AS (SELECT coalesce(CASE WHEN c_acctbal >= 0 THEN label END, 'unassigned') AS label, count(*) AS n FROM customer LEFT JOIN calls ON obs = c_custkey GROUP BY 1)
    SELECT label, n, row_number() OVER (ORDER BY label = 'unassigned', n DESC, label) AS position FROM n""", "cells", "calls"))
def cells_by_label(spark, d):
    joined = T.table(spark, d, "customer").select(F.col("c_custkey").alias("obs"), "c_acctbal").join(T.calls(spark, d), "obs", "left")
    return R.cells_by_label(joined.withColumn("label", F.when(F.col("c_acctbal") >= 0, F.col("label"))))
