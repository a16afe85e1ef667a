"""Profile, fold and score queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import profile as P
from lattica.sources import tables as T
from lattica.sources.tables import with_inputs

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(df, *columns):
    """Doubles to six decimals, as the oracle gives them."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _sums(spark, d):
    return P.group_sums(T.counts(spark, d), T.cells(spark, d))


def _profile(spark, d):
    return P.weighted_profile(_sums(spark, d))


def _sizes(spark, d):
    """Groups and features of the table: two numbers."""
    k = T.cells(spark, d).agg(F.countDistinct("grp")).first()[0]
    m = T.counts(spark, d).agg(F.countDistinct("feature")).first()[0]
    return max(k, 2), max(m, 1)


@query("group_feature_sums", with_inputs("""
    SELECT 'group' AS kind, grp::VARCHAR AS key, feature, sum(value) AS value FROM counts JOIN cells USING (obs) GROUP BY grp, feature
    UNION ALL SELECT 'batch', batch, feature, sum(value) FROM counts JOIN cells USING (obs) GROUP BY batch, feature""", "counts", "cells"))
def group_feature_sums(spark, d):
    return P.feature_sums(T.counts(spark, d), T.cells(spark, d))


@query("weighted_profile", with_inputs("SELECT grp, feature, round(mu, 9) AS mu FROM profile", "profile"))
def weighted_profile(spark, d):
    return _profile(spark, d).withColumn("mu", F.round("mu", 9))


@query("batch_membership", with_inputs("SELECT batch, grp, round(count(*) / sum(count(*)) OVER (PARTITION BY batch), 6) AS share FROM cells GROUP BY 1, 2", "cells"))
def batch_membership(spark, d):
    return r6(P.batch_membership(T.cells(spark, d)), "share")


@query("empirical_specificity", with_inputs("""
    SELECT feature, round(least(greatest((max(mu) / sum(mu) - 1.0 / k) / (1 - 1.0 / k), 0), 1), 6) AS specificity
    FROM profile, n_groups GROUP BY feature, k""", "profile", "n_groups"))
def empirical_specificity(spark, d):
    return r6(P.empirical_specificity(_profile(spark, d), _sizes(spark, d)[0]), "specificity")


@query("panel_idf", with_inputs("SELECT feature, round(idf, 6) AS idf FROM idf", "idf"))
def panel_idf(spark, d):
    return r6(P.panel_idf(T.panel(spark, d)), "idf")


_FOLD = """+
    e AS (SELECT sum(mu) / (k * m) AS e FROM profile, n_groups, n_features GROUP BY k, m),
    folds AS (SELECT grp, feature, mu, log2((mu + e) / ((sum(mu) OVER (PARTITION BY feature) - mu) / (k - 1) + e)) AS log2fc FROM profile, e, n_groups)
"""


@query("log2_fold_change", with_inputs(_FOLD + "SELECT grp, feature, round(log2fc, 6) AS log2fc FROM folds", "profile", "n_groups", "n_features"))
def log2_fold_change(spark, d):
    return r6(P.log2_fold_change(_profile(spark, d), *_sizes(spark, d)).select("grp", "feature", "log2fc"), "log2fc")


@query("specific_features", with_inputs(_FOLD + """, ranked AS (
    SELECT *, sum(mu) OVER (PARTITION BY grp) / m AS mean FROM folds, n_features)
    SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY round(log2fc, 9) DESC, feature) AS rank, feature, round(log2fc, 6) AS log2fc
    FROM ranked WHERE mu > mean QUALIFY rank <= 5""", "profile", "n_groups", "n_features"))
def specific_features(spark, d):
    k, m = _sizes(spark, d)
    p = _profile(spark, d)
    return r6(P.specific_features(p, P.log2_fold_change(p, k, m), m), "log2fc")


@query("top_specific_prompt", with_inputs("""+
    l AS (SELECT grp, feature, ln(1 + 1e4 * mu) AS level FROM profile WHERE mu > 0),
    i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY level, feature) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n, sum(level) OVER (PARTITION BY feature) AS total FROM l),
    f AS (SELECT grp, level AS floor_level FROM i WHERE i = least(floor(0.9 * n), n - 1)),
    j AS (SELECT i.grp, feature, level - (total - level) / (k - 1) AS fold FROM i JOIN f ON i.grp = f.grp AND level >= floor_level, n_groups)
    SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY round(fold, 9) DESC, feature) AS rank, feature, round(fold, 6) AS fold FROM j QUALIFY rank <= 3""", "profile", "n_groups"))
def top_specific_prompt(spark, d):
    return r6(P.top_specific(_profile(spark, d), _sizes(spark, d)[0]), "fold")


@query("detected_share", with_inputs("""
    SELECT grp, feature, round(count(DISTINCT obs) / any_value(size), 6) AS detected
    FROM counts JOIN cells USING (obs) JOIN (SELECT grp, count(*) AS size FROM cells GROUP BY 1) s USING (grp)
    WHERE value > 0 AND feature IN (SELECT feature FROM panel WHERE class = 'S0') GROUP BY 1, 2""", "counts", "cells", "panel"))
def detected_share(spark, d):
    wanted = T.panel(spark, d).where("class = 'S0'").select("feature")
    return r6(P.detected_share(T.counts(spark, d), T.cells(spark, d), wanted), "detected")


@query("drop_small_groups", with_inputs("""+
    kept AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS compact FROM cells WHERE grp IS NOT NULL GROUP BY grp HAVING count(*) >= 60)
    SELECT obs, grp, compact::INTEGER AS compact FROM cells LEFT JOIN kept USING (grp)""", "cells"))
def drop_small_groups(spark, d):
    return P.drop_small_groups(T.cells(spark, d), 60)


@query("softmax_shares", """
    WITH e AS (SELECT c_nationkey, c_custkey, exp(c_acctbal / 1000 - max(c_acctbal / 1000) OVER (PARTITION BY c_nationkey)) AS e FROM customer)
    SELECT c_nationkey, c_custkey, round(e / sum(e) OVER (PARTITION BY c_nationkey), 6) AS share FROM e""")
def softmax_shares(spark, d):
    c = T.table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 1000).alias("v"))
    return r6(P.softmax_shares(c, "c_nationkey", "v").select("c_nationkey", "c_custkey", "share"), "share")


_Z = """+
    a AS (SELECT feature, sum(mu) AS s, sum(mu * mu) AS ss FROM profile GROUP BY 1),
    z AS (SELECT grp, feature, sqrt(greatest(ss / k - (s / k) * (s / k), 0)) AS sd, mu - s / k AS dev FROM profile JOIN a USING (feature), n_groups)
"""


@query("row_zscore", with_inputs(_Z + "SELECT grp, feature, round(least(greatest(CASE WHEN sd > 1e-12 THEN dev / sd ELSE 0 END, -3), 3), 4) AS z FROM z", "profile", "n_groups"))
def row_zscore(spark, d):
    return P.row_zscores(_profile(spark, d), _sizes(spark, d)[0]).withColumn("z", F.round("z", 4))


@query("regroup_sums", with_inputs("SELECT grp % 5 AS new_grp, feature, sum(value) AS value FROM sums GROUP BY 1, 2", "sums"))
def regroup_sums(spark, d):
    mapping = T.cells(spark, d).select("grp").distinct().withColumn("new_grp", F.col("grp") % 5)
    return P.regroup_sums(_sums(spark, d), mapping)


@query("regroup_profile", with_inputs("""+
    n AS (SELECT grp, count(*) AS n FROM cells GROUP BY 1), t AS (SELECT grp % 5 AS new_grp, sum(n) AS total FROM n GROUP BY 1)
    SELECT new_grp, feature, round(sum(mu * n) / any_value(total), 9) AS mu FROM profile JOIN n USING (grp) JOIN t ON new_grp = grp % 5 GROUP BY 1, 2""", "profile", "cells"))
def regroup_profile(spark, d):
    mapping = T.cells(spark, d).select("grp").distinct().withColumn("new_grp", F.col("grp") % 5)
    return P.regroup_profile(_profile(spark, d), T.cells(spark, d), mapping).withColumn("mu", F.round("mu", 9))


_MODULE = """+
    l AS (SELECT grp, feature, ln(1 + 1e4 * mu) AS x FROM profile),
    a AS (SELECT feature, sum(x) / k AS mean, sqrt(greatest(sum(x * x) / k - (sum(x) / k) * (sum(x) / k), 0)) AS sd FROM l, n_groups GROUP BY feature, k),
    w AS (SELECT class, feature, idf, mean, sd FROM panel JOIN idf USING (feature) JOIN a USING (feature) WHERE sd > 1e-12),
    g AS (SELECT DISTINCT grp FROM profile),
    scores AS (SELECT g.grp, class, sum(idf * (coalesce(x, 0) - mean) / sd) / sum(idf) AS score
               FROM g CROSS JOIN w LEFT JOIN l ON l.grp = g.grp AND l.feature = w.feature GROUP BY 1, 2 HAVING sum(idf) > 0)
"""


def scores(spark, d):
    return P.module_scores(_profile(spark, d), T.panel(spark, d), _sizes(spark, d)[0])


@query("module_score_approx", with_inputs(_MODULE + "SELECT grp, class, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, class) = 1", "profile", "panel", "idf", "n_groups"))
def module_score_approx(spark, d):
    return r6(P.best_class(scores(spark, d)), "score")


@query("module_scores", with_inputs(_MODULE + "SELECT grp, class, round(score, 6) AS score FROM scores", "profile", "panel", "idf", "n_groups"))
def module_scores(spark, d):
    return r6(scores(spark, d), "score")


_EFFECT = """+
    l AS (SELECT grp, feature, ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY grp)) AS x FROM sums),
    u AS (SELECT DISTINCT feature FROM terms), n AS (SELECT count(*) AS n_all FROM u),
    t AS (SELECT grp, sum(x) AS all_x FROM l WHERE feature IN (SELECT feature FROM u) GROUP BY 1),
    s AS (SELECT term, count(DISTINCT feature) AS n_in FROM terms GROUP BY 1),
    i AS (SELECT grp, term, sum(x) AS in_x FROM l JOIN terms USING (feature) GROUP BY 1, 2),
    r AS (SELECT t.grp, s.term, coalesce(in_x, 0) / n_in - (all_x - coalesce(in_x, 0)) / (n_all - n_in) AS raw
          FROM t CROSS JOIN s CROSS JOIN n LEFT JOIN i ON i.grp = t.grp AND i.term = s.term WHERE n_all > n_in)
"""


@query("term_effect", with_inputs(_EFFECT + "SELECT grp, term, round(raw - median(raw) OVER (PARTITION BY term), 6) AS effect FROM r", "sums", "terms"))
def term_effect(spark, d):
    return r6(P.term_effects(_sums(spark, d), T.terms(spark, d), _sizes(spark, d)[0]), "effect")


@query("level_row", """
    WITH r AS (SELECT p_partkey AS row_index, split_part(p_brand, '#', 1) || (p_partkey % 40) || CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '/rna/spliced' WHEN 2 THEN '/rna/total' WHEN 3 THEN '/rna/unspliced' ELSE '/rna/site' END AS row_name FROM part),
    c AS (SELECT *, split_part(row_name, '/', 1) AS gene, CASE WHEN row_name NOT LIKE '%/%' THEN 0 WHEN row_name LIKE '%/spliced' THEN 1 WHEN row_name LIKE '%/total' THEN 2 WHEN row_name LIKE '%/unspliced' THEN 3 ELSE 5 END AS channel_rank FROM r)
    SELECT gene, row_index, row_name, channel_rank FROM c QUALIFY row_number() OVER (PARTITION BY gene ORDER BY channel_rank, row_index) = 1""")
def level_row(spark, d):
    p = T.table(spark, d, "part")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "/rna/spliced", "/rna/total", "/rna/unspliced", "/rna/site")]), F.col("p_size") % 5 + 1)
    names = F.concat(F.split_part("p_brand", F.lit("#"), F.lit(1)), (F.col("p_partkey") % 40).cast("string"), suffix)
    return P.level_rows(p.select(F.col("p_partkey").alias("row_index"), names.alias("row_name")))


@query("heatmap_values", with_inputs(_FOLD + """, det AS (SELECT grp, feature, count(DISTINCT obs) AS n FROM counts JOIN cells USING (obs) WHERE value > 0 GROUP BY 1, 2), size AS (SELECT grp, count(*) AS size FROM cells GROUP BY 1)
    SELECT f.grp, f.feature, round(f.mu, 9) AS mean, round(log2fc, 6) AS log2fc, round(n / size, 6) AS frac
    FROM folds f JOIN det USING (grp, feature) JOIN size USING (grp) WHERE feature IN (SELECT feature FROM panel WHERE class = 'S1')""", "profile", "n_groups", "n_features", "panel"))
def heatmap_values(spark, d):
    k, m = _sizes(spark, d)
    wanted = T.panel(spark, d).where("class = 'S1'").select("feature")
    folds = P.log2_fold_change(_profile(spark, d), k, m).join(wanted, "feature", "left_semi")
    detected = P.detected_share(T.counts(spark, d), T.cells(spark, d), wanted)
    return folds.join(detected, ["grp", "feature"]).select("grp", "feature", F.round("mu", 9).alias("mean"), F.round("log2fc", 6).alias("log2fc"), F.round("detected", 6).alias("frac"))
