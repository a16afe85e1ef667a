"""Model queries; SQL expresses none but the selection over a star tree."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import communities as K
from lattica.operators import enrichment as R
from lattica.operators import graph as G
from lattica.operators import models as M
from lattica.operators import profile as P
from lattica.operators import rescoring as O
from lattica.operators import set_vectors as V
from lattica.operators import sparse_effects as S
from lattica.plans import curation as C
from lattica.plans import expression as E
from lattica.plans import graphs as N
from lattica.sources import tables as T
from lattica.sources.shared import held
from lattica.sources.tables import with_inputs

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("tree_bh_star", f"WITH {C._BH}, n AS (SELECT family, id FROM q WHERE q <= 0.6) SELECT t.family, t.id::VARCHAR AS id, n.id IS NOT NULL AS selected FROM t LEFT JOIN n USING (family, id)")
def tree_bh_star(spark, d):
    tests = C._tests(spark, d)
    ids = tests.select("id").distinct()
    nodes = ids.select(F.col("id").cast("string").alias("child"), F.lit("root").alias("parent"))
    families = tests.select(F.ascii("family").alias("grp"), F.col("id").cast("string").alias("class"), "p")
    return M.tree_selection(families, nodes, 0.6).select(F.char("grp").alias("family"), F.col("class").alias("id"), "selected")


def _levels(spark, d):
    sums = held(E._sums(spark, d))
    level = sums.select("grp", "feature", F.log1p(1e4 * F.col("value") / F.sum("value").over(Window.partitionBy("grp"))).alias("x"))
    return sums, level


@query("decoy_term_test")
def decoy_term_test(spark, d):
    sums, level = _levels(spark, d)
    members = T.terms(spark, d).select(F.col("term").alias("set"), "feature").distinct()
    return M.matched_test(level, members, M.strata(sums))


@query("class_enrichment")
def class_enrichment(spark, d):
    """Running-sum score of each class's features, ranked by specificity in each group, against matched random sets."""
    sums = held(E._sums(spark, d))
    profile = P.weighted_profile(sums)
    share = F.col("mu") / F.sum("mu").over(Window.partitionBy("feature"))
    level = profile.select("grp", "feature", share.alias("x"))
    panel = T.panel(spark, d)
    members = panel.join(P.panel_idf(panel), "feature").select(F.col("class").alias("set"), "feature", F.col("idf").alias("weight"))
    return R.enrichment_test(level, members, M.strata(sums), least=3)


@query("susie_calls")
def susie_calls(spark, d):
    """Sampled class effects of each group, with credible sets and the chains' agreement."""
    return S.class_effects(E._sums(spark, d), T.panel(spark, d), T.cells(spark, d).select("grp").distinct())


@query("vector_communities")
def vector_communities(spark, d):
    """Communities of the neighbour graph of all vectors; an edge found both ways weighs twice."""
    v = T.vectors(spark, d)
    edges = N._knn(spark, d).select(F.col("obs").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("weight"))
    return K.communities(edges, v.select(F.col("obs").alias("node")), smallest=3)


def _feature_sets(spark, d):
    """Vectors as features; the groups' and the brands' members are the sets."""
    v = T.vectors(spark, d)
    groups = v.select(F.concat(F.lit("group "), F.col("grp").cast("string")).alias("set"), F.col("obs").alias("feature"))
    brands = T.terms(spark, d).select(F.col("term").alias("set"), "feature")
    return v.select(F.col("obs").alias("feature"), "vec"), groups.unionByName(brands)


@query("set_vectors")
def set_vectors(spark, d):
    """Each set's nearness to its features against 99 decoys of its size."""
    return V.against_decoys(V.set_vectors(*_feature_sets(spark, d)))


@query("units_regions")
def units_regions(spark, d):
    return M.regions(T.vectors(spark, d))


@query("joined_groups")
def joined_groups(spark, d):
    return M.joined_pairs(G.connectivity(N._knn(spark, d), T.vectors(spark, d)))


@query("diffusion_pseudotime")
def diffusion_pseudotime(spark, d):
    v = T.vectors(spark, d)
    first = v.agg(F.min("grp").alias("grp"))
    roots = G.medoids(v.join(first, "grp", "left_semi"))
    return M.pseudotime(G.gauss_kernel(held(N._knn(spark, d))), roots)  # all pairs are compared once


@query("rescored_round", with_inputs("""+ lv AS (SELECT grp, feature, ln(1 + 10000 * value / sum(value) OVER (PARTITION BY grp)) AS x FROM sums),
    kept AS (SELECT feature, class FROM panel WHERE NOT (class = 'S1' AND feature % 3 = 0)),
    w AS (SELECT feature, class, ln((SELECT count(DISTINCT class) FROM kept) * 1.0 / count(*) OVER (PARTITION BY feature)) AS weight FROM kept),
    total AS (SELECT class, sum(weight) AS total FROM w GROUP BY 1), s AS (SELECT grp, class, sum(x * weight) AS s FROM lv JOIN w USING (feature) GROUP BY 1, 2)
    SELECT g.grp, t.class, round(coalesce(s.s, 0) / t.total, 6) AS score FROM (SELECT DISTINCT grp FROM lv) g CROSS JOIN total t LEFT JOIN s ON s.grp = g.grp AND s.class = t.class""", "sums", "panel"))
def rescored_round(spark, d):
    """A class loses features: it and those that share them are scored again, the others' scores are taken over."""
    _, level = _levels(spark, d)
    panel = T.panel(spark, d)
    weighted = lambda p: p.join(P.panel_idf(p), "feature").select(F.col("class").alias("set"), "feature", F.col("idf").alias("weight"))
    before, after = weighted(panel), weighted(panel.where("not (class = 'S1' and feature % 3 = 0)"))
    scores = O.rescored(O.weighted_means, O.weighted_means(level, before), (level, level), (before, after))
    return scores.select("grp", F.col("set").alias("class"), F.round("score", 6).alias("score"))
