"""Taxonomy, precedence, neighbour and ordering queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import profile as P
from lattica.plans.expression import r6
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


def recursive(head: str, *names: str) -> str:
    return with_inputs(head, *names).replace("WITH ", "WITH RECURSIVE ", 1)


_UP = """+ up(id, anc, depth) AS (SELECT DISTINCT id, id, 0 FROM (SELECT child AS id FROM taxonomy UNION SELECT parent FROM taxonomy)
    UNION SELECT up.id, t.parent, up.depth + 1 FROM up JOIN taxonomy t ON t.child = up.anc), anc AS (SELECT id, anc, min(depth) AS depth FROM up GROUP BY 1, 2)"""


@query("taxonomy_closure", recursive(_UP + " SELECT id, anc, depth FROM anc", "taxonomy"))
def taxonomy_closure(spark, d):
    return G.closure(T.taxonomy(spark, d))


@query("nearest_shared_class", recursive(_UP + """, o AS (SELECT * FROM anc WHERE id LIKE 'N%' AND depth > 0), s AS (SELECT anc FROM o GROUP BY 1 HAVING count(DISTINCT id) >= 2)
    SELECT id, arg_min(anc, row(depth, anc)) AS anc FROM o JOIN s USING (anc) GROUP BY 1""", "taxonomy"))
def nearest_shared_class(spark, d):
    t = T.taxonomy(spark, d)
    return G.nearest_shared(t.where("child like 'N%'").select(F.col("child").alias("id")), G.closure(t))


@query("lca_of_parts", recursive(_UP + """, parts AS (SELECT DISTINCT c_mktsegment || (c_custkey % 40) AS label, 'N' || c_nationkey AS id FROM customer),
    b AS (SELECT anc, count(*) AS below FROM anc GROUP BY 1), n AS (SELECT label, count(DISTINCT id) AS parts FROM parts GROUP BY 1),
    h AS (SELECT label, anc, count(DISTINCT id) AS held FROM parts JOIN anc USING (id) GROUP BY 1, 2)
    SELECT label, arg_min(anc, row(below, anc)) AS anc FROM h JOIN n USING (label) JOIN b USING (anc) WHERE held = parts GROUP BY 1""", "taxonomy"))
def lca_of_parts(spark, d):
    c = T.table(spark, d, "customer")
    parts = c.select(F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("label"), F.concat(F.lit("N"), "c_nationkey").alias("id")).distinct()
    return G.common_ancestor(parts, G.closure(T.taxonomy(spark, d)))


_STATED = "+ e AS (SELECT DISTINCT least(c_nationkey, p_size) AS a, greatest(c_nationkey, p_size) AS b FROM customer JOIN part ON p_partkey = c_custkey WHERE c_nationkey <> p_size)"


def _edges(spark, d):
    """An acyclic graph: from the smaller to the larger of a nation and a size."""
    x, y = F.col("c_nationkey"), F.col("p_size")
    j = T.table(spark, d, "customer").join(T.table(spark, d, "part"), F.col("p_partkey") == F.col("c_custkey"))
    return j.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


_REACH = _STATED + ", reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)"


@query("reachability", recursive(_REACH + " SELECT a, b FROM reach", "cells"))
def reachability(spark, d):
    return G.reachability(_edges(spark, d))


@query("transitive_reduction", recursive(_REACH + " SELECT a, b FROM reach WHERE NOT EXISTS (SELECT 1 FROM reach x JOIN reach y ON x.b = y.a WHERE x.a = reach.a AND y.b = reach.b)", "cells"))
def transitive_reduction(spark, d):
    return G.reduction(_edges(spark, d))


@query("cycle_detect", recursive("+ e AS (SELECT DISTINCT user_id % 12 AS a, (user_id * 5 + 1) % 17 AS b FROM events), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS node FROM reach WHERE a = b", "cells"))
def cycle_detect(spark, d):
    u = F.col("user_id")
    return G.cycles(T.table(spark, d, "events").select((u % 12).alias("a"), ((u * 5 + 1) % 17).alias("b")).distinct())


@query("layered_override", """SELECT user_id % 7 AS a, user_id % 11 AS b, event_type AS layer, event_id AS line FROM events WHERE user_id % 7 <> user_id % 11
    QUALIFY row_number() OVER (PARTITION BY least(user_id % 7, user_id % 11), greatest(user_id % 7, user_id % 11) ORDER BY event_type DESC, event_id DESC) = 1""")
def layered_override(spark, d):
    u = F.col("user_id")
    e = T.table(spark, d, "events").select((u % 7).alias("a"), (u % 11).alias("b"), F.col("event_type").alias("layer"), F.col("event_id").alias("line"))
    return G.layered(e.where("a != b"))


@query("precedence_votes", with_inputs("SELECT a, b, votes FROM precedence", "precedence"))
def precedence_votes(spark, d):
    return T.precedence(spark, d)


_COMP = "+ e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY lang, n_chars) AS b FROM documents UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY source, n_chars) FROM documents), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, other) AS (SELECT a, a FROM both_ways UNION SELECT w.node, x.b FROM walk w JOIN both_ways x ON x.a = w.other)"


@query("connected_components", recursive(_COMP + " SELECT node, min(other) AS component FROM walk GROUP BY 1", "cells"))
def connected_components(spark, d):
    """Documents of equal length that share a language or a source, over any number of steps."""
    docs = T.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    to = lambda c: docs.groupBy(c, "n_chars").agg(F.min("doc_id").alias("b")).join(docs, [c, "n_chars"]).select(F.col("doc_id").alias("a"), "b")
    return G.components(to("lang").union(to("source")).distinct())


_PATHS = "+ e AS (SELECT parent AS a, child AS b FROM taxonomy), walk(node, path) AS (SELECT DISTINCT a, [a] FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT e.b, list_append(w.path, e.b) FROM walk w JOIN e ON e.a = w.node), paths AS (SELECT array_to_string(path, ' > ') AS lineage, path FROM walk WHERE node NOT IN (SELECT a FROM e))"


def _dag(spark, d):
    return T.taxonomy(spark, d).select(F.col("parent").alias("a"), F.col("child").alias("b"))


@query("lineage_paths", recursive(_PATHS + " SELECT lineage FROM paths", "taxonomy"))
def lineage_paths(spark, d):
    return G.lineages(_dag(spark, d)).select(F.array_join("path", " > ").alias("lineage"))


@query("lineage_weights", recursive(_PATHS + " SELECT class, lineage, round(1.0 / count(*) OVER (PARTITION BY class), 6) AS weight FROM (SELECT lineage, unnest(path) AS class FROM paths)", "taxonomy"))
def lineage_weights(spark, d):
    return r6(G.lineage_weights(G.lineages(_dag(spark, d))), "weight")


@query("branch_points", recursive(_PATHS + """ SELECT DISTINCT x.path[len(list_filter(range(1, least(len(x.path), len(y.path)) + 1), lambda i: x.path[1:i] = y.path[1:i]))] AS class
    FROM paths x JOIN paths y ON x.path[1] = y.path[1] AND x.lineage < y.lineage""", "taxonomy"))
def branch_points(spark, d):
    return G.branch_points(G.lineages(_dag(spark, d)))


_DIST = "sqrt(list_sum(list_transform(list_zip(x.vec, y.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_KNN = f"+ knn AS (SELECT x.obs, y.obs AS other, {_DIST} AS score, row_number() OVER (PARTITION BY x.obs ORDER BY round(score, 12), y.obs) AS rank FROM vectors x JOIN vectors y ON x.obs <> y.obs QUALIFY rank <= 8)"


def _knn(spark, d):
    v = T.vectors(spark, d).select("obs", "vec")
    return G.blocked_top_k(v, v, 8, "l2")


@query("knn_l2", with_inputs(_KNN + " SELECT obs, rank, other, round(score, 6) AS score FROM knn", "vectors"))
def knn_l2(spark, d):
    return r6(_knn(spark, d), "score")


_COS = "+ c AS (SELECT x.obs, y.obs AS other, list_cosine_similarity(x.vec, y.vec) AS score FROM vectors x JOIN vectors y ON x.obs <> y.obs)"


@query("topk_cosine", with_inputs(_COS + " SELECT obs, row_number() OVER (PARTITION BY obs ORDER BY round(score, 12) DESC, other) AS rank, other, round(score, 6) AS score FROM c QUALIFY rank <= 5", "vectors"))
def topk_cosine(spark, d):
    v = T.vectors(spark, d).select("obs", "vec")
    return r6(G.blocked_top_k(v, v, 5, "cosine"), "score")


@query("csls_topk", with_inputs(_COS + """, n AS (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY round(score, 12) DESC, other) AS i FROM c),
    r AS (SELECT obs, avg(score) AS r FROM n WHERE i <= 10 GROUP BY 1), s AS (SELECT n.obs, n.other, 2 * score - a.r - b.r AS csls FROM n JOIN r a ON a.obs = n.obs JOIN r b ON b.obs = n.other)
    SELECT obs, row_number() OVER (PARTITION BY obs ORDER BY round(csls, 12) DESC, other) AS rank, other, round(csls, 6) AS csls FROM s QUALIFY rank <= 5""", "vectors"))
def csls_topk(spark, d):
    return r6(G.csls_top_k(T.vectors(spark, d).select("obs", "vec"), 5, 10), "csls")


@query("centroid_neighbours", with_inputs("""+ dims AS (SELECT grp, generate_subscripts(vec, 1) AS k, unnest(vec) AS x FROM vectors), m AS (SELECT grp, k, avg(x) AS x FROM dims GROUP BY 1, 2), v AS (SELECT grp, list(x ORDER BY k) AS centre FROM m GROUP BY 1)
    SELECT v.grp, row_number() OVER (PARTITION BY v.grp ORDER BY round(list_cosine_similarity(centre, vec), 12) DESC, obs) AS rank, obs, round(list_cosine_similarity(centre, vec), 6) AS score FROM v CROSS JOIN vectors QUALIFY rank <= 5""", "vectors"))
def centroid_neighbours(spark, d):
    v = T.vectors(spark, d)
    dims = v.select("grp", F.posexplode("vec").alias("k", "x")).groupBy("grp", "k").agg(F.avg("x").alias("x"))
    centres = dims.groupBy(F.col("grp").cast("long").alias("obs")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vec"))
    top = G.blocked_top_k(centres, v.select("obs", "vec"), 5, "cosine", exclude_self=False)
    return r6(top.select(F.col("obs").cast("int").alias("grp"), "rank", F.col("other").alias("obs"), "score"), "score")


_PAGA = _KNN + """, ends AS (SELECT a.grp AS ga, b.grp AS gb FROM knn JOIN vectors a ON a.obs = knn.obs JOIN vectors b ON b.obs = knn.other),
    per AS (SELECT grp, count(*) AS n, any_value(e) AS e FROM vectors JOIN (SELECT ga, count(*) AS e FROM ends GROUP BY 1) o ON ga = grp GROUP BY 1),
    btw AS (SELECT least(ga, gb) AS a, greatest(ga, gb) AS b, count(*) AS edges FROM ends WHERE ga <> gb GROUP BY 1, 2),
    pairs AS (SELECT x.grp AS a, y.grp AS b, coalesce(edges, 0) AS edges, (x.e * y.n + y.e * x.n) / ((SELECT count(*) FROM vectors) - 1) AS expected FROM per x JOIN per y ON x.grp < y.grp LEFT JOIN btw ON btw.a = x.grp AND btw.b = y.grp),
    conn AS (SELECT *, CASE WHEN edges = 0 THEN 0 WHEN expected <= 0 THEN 1 ELSE least(edges / expected, 1) END AS ratio FROM pairs)"""


@query("paga_connectivity", with_inputs(_PAGA + " SELECT a, b, edges, round(expected, 6) AS expected, round(ratio, 6) AS ratio FROM conn", "vectors"))
def paga_connectivity(spark, d):
    return r6(G.connectivity(_knn(spark, d), T.vectors(spark, d)), "expected", "ratio")


@query("edge_verdicts", with_inputs(_PAGA + """, p AS (SELECT *, b = a + 1 AS in_prior FROM conn), v AS (SELECT *, CASE WHEN in_prior AND ratio >= 0.1 THEN 'supported' WHEN in_prior AND ratio > 0 THEN 'weak' WHEN in_prior THEN 'unsupported' WHEN ratio >= 0.1 THEN 'candidate' END AS verdict FROM p)
    SELECT a, b, round(ratio, 6) AS ratio, in_prior, verdict FROM v WHERE verdict IS NOT NULL""", "vectors"))
def edge_verdicts(spark, d):
    v = T.vectors(spark, d)
    prior = v.select(F.col("grp").alias("a"), (F.col("grp") + 1).alias("b")).distinct()
    return r6(G.edge_verdicts(G.connectivity(_knn(spark, d), v), prior), "ratio")


@query("gauss_kernel", with_inputs(_KNN + """, s AS (SELECT obs, median(score * score) AS s2 FROM knn GROUP BY 1),
    w AS (SELECT knn.obs AS i, other AS j, sqrt(2 * sqrt(a.s2 * b.s2) / (a.s2 + b.s2)) * exp(-score * score / (a.s2 + b.s2)) AS w FROM knn JOIN s a ON a.obs = knn.obs JOIN s b ON b.obs = other)
    SELECT i, j, round(max(w), 6) AS w FROM (FROM w UNION ALL SELECT j, i, w FROM w) GROUP BY 1, 2""", "vectors"))
def gauss_kernel(spark, d):
    return r6(G.gauss_kernel(_knn(spark, d)), "w")


_DIMS = "+ dims AS (SELECT obs, grp, generate_subscripts(vec, 1) - 1 AS k, unnest(vec) AS x FROM vectors), gm AS (SELECT grp, k, avg(x) AS m FROM dims GROUP BY 1, 2)"


@query("medoid", with_inputs(_DIMS + ", dd AS (SELECT grp, obs, sum((x - m) * (x - m)) AS d2 FROM dims JOIN gm USING (grp, k) GROUP BY 1, 2) SELECT grp, obs, round(d2, 6) AS d2 FROM dd QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(d2, 12), obs) = 1", "vectors"))
def medoid(spark, d):
    return r6(G.medoids(T.vectors(spark, d)), "d2")


@query("balanced_centre", with_inputs(_DIMS + " SELECT k, round(avg(m), 6) AS centre FROM gm GROUP BY 1", "vectors"))
def balanced_centre(spark, d):
    return r6(G.balanced_centre(T.vectors(spark, d)), "centre")


@query("within_covariance", with_inputs(_DIMS + """, r AS (SELECT obs, k, x - m AS r FROM dims JOIN gm USING (grp, k))
    SELECT a.k AS i, b.k AS j, round(sum(a.r * b.r) / (SELECT count(*) - count(DISTINCT grp) FROM vectors), 6) AS cov FROM r a JOIN r b USING (obs) WHERE a.k <= b.k GROUP BY 1, 2""", "vectors"))
def within_covariance(spark, d):
    return r6(G.within_covariance(T.vectors(spark, d)), "cov")


@query("embedding_module_score", with_inputs(_DIMS + """, c AS (SELECT k, avg(m) AS centre FROM gm GROUP BY 1), u AS (SELECT gm.grp AS class, k, m - centre AS u FROM gm JOIN c USING (k)),
    s AS (SELECT obs, class, sum((x - centre) * u) AS score FROM dims JOIN c USING (k) JOIN u USING (k) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY obs ORDER BY round(score, 9) DESC, class))
    SELECT obs, class, round(score, 6) AS score, round(score - nxt, 6) AS margin FROM r WHERE n = 1""", "vectors"))
def embedding_module_score(spark, d):
    v = T.vectors(spark, d)
    centre = G.balanced_centre(v)
    means = v.select("grp", F.posexplode("vec").alias("k", "x")).groupBy("grp", "k").agg(F.avg("x").alias("m"))
    directions = means.join(centre, "k").select(F.col("grp").alias("class"), "k", (F.col("m") - F.col("centre")).alias("u"))
    return r6(G.module_score_embedding(v, centre, directions), "score", "margin")


_TIMES = "times AS (SELECT event_type AS grp, value AS t FROM events)"


def _times(spark, d):
    return T.table(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("value").alias("t"))


@query("order_agreement", f"WITH {_TIMES}, m AS (SELECT grp, median(t) AS m FROM times GROUP BY 1) SELECT m.grp AS a, times.grp AS b, round(avg((t > m)::INTEGER), 6) AS share FROM m JOIN times ON m.grp < times.grp GROUP BY 1, 2")
def order_agreement(spark, d):
    kinds = _times(spark, d).select("grp").distinct()
    edges = kinds.select(F.col("grp").alias("a")).crossJoin(kinds.select(F.col("grp").alias("b"))).where("a < b")
    return r6(G.order_agreement(_times(spark, d), edges), "share")


@query("type_order_quantiles", f"WITH {_TIMES} SELECT grp, round(quantile_cont(t, 0.25), 6) AS q1, round(median(t), 6) AS median, round(quantile_cont(t, 0.75), 6) AS q3, count(*) AS n FROM times GROUP BY 1")
def type_order_quantiles(spark, d):
    return r6(G.type_order(_times(spark, d)), "q1", "median", "q3")


@query("eta2_components", with_inputs(_DIMS + """, t AS (SELECT k, avg(x) AS m, stddev_pop(x) AS sd, count(*) AS n FROM dims GROUP BY 1), p AS (SELECT k, grp, avg(x) AS mg, count(*) AS ng FROM dims GROUP BY 1, 2)
    SELECT k, round(any_value(sd), 6) AS sd, round(sum(ng * (mg - m) * (mg - m)) / (any_value(n) * any_value(sd) * any_value(sd)), 6) AS eta2 FROM p JOIN t USING (k) GROUP BY 1""", "vectors"))
def eta2_components(spark, d):
    return r6(G.component_facts(T.vectors(spark, d).select("grp", F.posexplode("vec").alias("k", "x"))), "sd", "eta2")


@query("marker_jaccard_idf", with_inputs("""+ p AS (SELECT * FROM panel JOIN idf USING (feature)), w AS (SELECT class, sum(idf) AS w FROM p GROUP BY 1), s AS (SELECT x.class AS a, y.class AS b, sum(x.idf) AS s FROM p x JOIN p y ON x.feature = y.feature AND x.class < y.class GROUP BY 1, 2)
    SELECT a, b, round(s / (wa.w + wb.w - s), 6) AS jaccard FROM s JOIN w wa ON wa.class = a JOIN w wb ON wb.class = b""", "panel", "idf"))
def marker_jaccard_idf(spark, d):
    panel = T.panel(spark, d)
    return r6(G.weighted_jaccard(panel, P.panel_idf(panel)), "jaccard")


@query("indicator_correlation", with_inputs("""+ n AS (SELECT class, count(*)::DOUBLE AS n FROM panel GROUP BY 1), b AS (SELECT x.class AS a, y.class AS b, count(*) AS c FROM panel x JOIN panel y ON x.feature = y.feature AND x.class < y.class GROUP BY 1, 2), m AS (SELECT count(*)::DOUBLE AS m FROM part)
    SELECT x.class AS a, y.class AS b, round(abs((coalesce(c, 0) * m - x.n * y.n) / sqrt(x.n * (m - x.n) * y.n * (m - y.n))), 6) AS r FROM n x JOIN n y ON x.class < y.class CROSS JOIN m LEFT JOIN b ON b.a = x.class AND b.b = y.class""", "panel"))
def indicator_correlation(spark, d):
    return r6(G.indicator_correlation(T.panel(spark, d), T.table(spark, d, "part").count()), "r")
