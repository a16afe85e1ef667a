"""Name, selection and edit queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators import graph as G
from lattica.operators import labels as L
from lattica.operators import matching as M
from lattica.operators import names as N
from lattica.operators import priors as PR
from lattica.operators import selection as C
from lattica.sources import tables as T
from lattica.sources.tables import with_inputs

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_PLAIN = "array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[\\s,_]+'), lambda w: w <> ''), ' ')"


@query("normal_names", f"""WITH n AS (SELECT p_partkey, {_PLAIN} AS name FROM part)
    SELECT p_partkey, name, array_to_string(list_sort(string_split(name, ' ')), ' ') AS bag,
        array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN length(w) >= 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END), ' ') AS single FROM n""")
def normal_names(spark, d):
    n = T.table(spark, d, "part").select("p_partkey", N.normalise("p_name").alias("name"))
    return n.select("p_partkey", "name", N.word_bag("name").alias("bag"), N.singular("name").alias("single"))


def _feature_rows(spark, d):
    k = F.col("p_partkey").cast("string")
    accession = F.concat(F.lit("ENSG"), F.lpad(k, 11, "0"), F.lit("_"))
    part = T.table(spark, d, "part")
    rows = part.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, accession).otherwise(""), F.lit("SYM"), k).alias("feature"))
    asked = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("absent"), k)).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("sym"), k)).otherwise(F.concat(F.lit("SYM"), k))
    return part.select(asked.alias("feature"), F.col("p_type").alias("class")), rows


_ASKED = """asked AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'absent' WHEN p_partkey % 2 = 0 THEN 'sym' ELSE 'SYM' END || p_partkey AS feature, p_type AS class,
    CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') || '_' ELSE '' END || 'SYM' || p_partkey END AS row FROM part)"""


@query("feature_matching", f"WITH {_ASKED} SELECT feature, class, row FROM asked")
def feature_matching(spark, d):
    return N.match_features(*_feature_rows(spark, d))


@query("panel_coverage", f"""WITH {_ASKED} SELECT count(DISTINCT feature) AS features, count(DISTINCT feature) FILTER (row IS NOT NULL) AS measured,
    (SELECT string_agg(feature, ', ' ORDER BY feature) FROM (SELECT DISTINCT feature FROM asked WHERE row IS NULL ORDER BY feature LIMIT 5)) AS missing,
    round(count(DISTINCT feature) FILTER (row IS NOT NULL) * 1.0 / count(DISTINCT feature), 6) AS share,
    count(DISTINCT feature) FILTER (row IS NOT NULL) * 1.0 / count(DISTINCT feature) < 0.5 AS warning FROM asked""")
def panel_coverage(spark, d):
    return N.panel_coverage(N.match_features(*_feature_rows(spark, d))).withColumn("share", F.round("share", 6))


@query("hidden_features", "SELECT p_partkey::VARCHAR AS feature FROM part WHERE p_partkey::VARCHAR LIKE '%1' OR p_partkey::VARCHAR LIKE '2%5' OR p_partkey = 12")
def hidden_features(spark, d):
    features = T.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("feature"))
    return N.hidden(features, spark.createDataFrame([("*1",), ("12",), ("2*5",), ("9.*",)], "pattern string"))


@query("measure_columns", """SELECT l_orderkey, l_linenumber, round(pow(2, round(2 * log2(l_quantity)) / 2))::BIGINT AS bin, round(ln((l_quantity + 0.5) / 10.5), 6) AS fold,
    round(1 / (l_quantity + 0.5), 6) AS variance, strftime(make_timestamp(l_orderkey::BIGINT * 1000003 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, 'order ' || l_orderkey || '. line' AS told FROM lineitem""")
def measure_columns(spark, d):
    l = T.table(spark, d, "lineitem")
    y = F.col("l_quantity").cast("double")
    return l.select(
        "l_orderkey", "l_linenumber", N.size_bin(y).alias("bin"), F.round(N.log_fold(y, F.lit(10.0)), 6).alias("fold"), F.round(N.log_fold_variance(y), 6).alias("variance"),
        N.utc_timestamp(F.col("l_orderkey").cast("long") * 1000003).alias("at"), N.sentence(F.concat(F.lit("order "), "l_orderkey"), F.lit(" line ")).alias("told"),
    )


@query("term_search", f"""WITH n AS (SELECT p_partkey AS id, {_PLAIN} AS n, length(p_name) AS l FROM part), q AS (SELECT min(string_split(n, ' ')[1]) AS q FROM n)
    SELECT id, n = q AS whole, CASE WHEN starts_with(n, q) THEN 0 ELSE 1 END AS "at" FROM n, q WHERE contains(n, q) ORDER BY whole DESC, "at", l, id LIMIT 10""")
def term_search(spark, d):
    names = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(True).alias("own"))
    asked = names.agg(F.min(F.split(N.normalise("name"), " ")[0])).first()[0]
    return N.search(names, asked or "", limit=10)


@query("pass_rows", with_inputs("SELECT obs, c.obs % 7 AS place, list_sum(vec) AS total FROM cells c JOIN vectors v USING (obs)", "cells", "vectors"))
def pass_rows(spark, d):
    observations = T.cells(spark, d).select("obs", (F.col("obs") % 7).alias("place"))
    return C.pass_rows(T.vectors(spark, d).select("obs", "vec"), observations).select("obs", "place", F.aggregate("vec", F.lit(0.0), lambda t, x: t + x).alias("total"))


@query("regroup_map", """SELECT c_nationkey AS old, c_mktsegment AS new, count(*) AS held, (sum(count(*)) OVER (PARTITION BY c_nationkey))::BIGINT AS of FROM customer GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) = 1""")
def regroup_map(spark, d):
    cells = T.cells(spark, d)
    return C.regroup_map(cells.select("obs", "grp"), cells.select("obs", F.col("batch").alias("grp")))


@query("closest_ancestor", with_inputs("SELECT child AS id, parent AS node FROM taxonomy", "taxonomy"))
def closest_ancestor(spark, d):
    up = G.closure(T.taxonomy(spark, d))
    depths = up.where("anc = 'ROOT'").select("id", "depth")
    return C.closest_ancestor(up, spark.createDataFrame([("ROOT",)], "id string").unionByName(T.taxonomy(spark, d).select(F.col("parent").alias("id")).distinct()).distinct(), depths)


@query("first_parents", with_inputs("""SELECT 'ROOT' AS id, 'ROOT' AS chain UNION ALL SELECT child, child || '>ROOT' FROM taxonomy WHERE parent = 'ROOT'
    UNION ALL SELECT child, child || '>' || parent || '>ROOT' FROM taxonomy WHERE parent <> 'ROOT'""", "taxonomy"))
def first_parents(spark, d):
    edges = T.taxonomy(spark, d).withColumn("place", F.lit(0))
    return C.first_parents(edges).select("id", F.array_join("chain", ">").alias("chain"))


_STATES = """WITH RECURSIVE dev AS (SELECT 'N' || n_nationkey AS id, 'N' || (n_nationkey - 1) AS dst FROM nation WHERE n_nationkey % 4 > 0),
    par AS (SELECT 'N' || n_nationkey AS id, 'R' || n_regionkey AS dst FROM nation UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region),
    s(start, term, inherited, developed) AS (SELECT 'N' || n_nationkey, 'N' || n_nationkey, false, false FROM nation
    UNION SELECT start, dst, inherited OR (NOT dev AND NOT developed), developed OR dev FROM s JOIN (SELECT *, true AS dev FROM dev UNION ALL SELECT *, false FROM par) e ON e.id = s.term)"""


@query("developed_from", _STATES + " SELECT start, term, bool_and(inherited) AS inherited FROM s WHERE developed GROUP BY 1, 2")
def developed_from(spark, d):
    n = T.table(spark, d, "nation")
    named = lambda c: F.concat(F.lit("N"), c)
    develops = n.where("n_nationkey % 4 > 0").select(named(F.col("n_nationkey")).alias("id"), named(F.col("n_nationkey") - 1).alias("to"))
    parents = T.taxonomy(spark, d).select(F.col("child").alias("id"), F.col("parent").alias("to"))
    return C.origins(n.select(named(F.col("n_nationkey")).alias("id")), develops, parents)


@query("level_means", with_inputs("""SELECT grp, round(avg(mu) FILTER (feature % 5 = 0), 9) AS mean, round(sum(mu), 6) AS total, round((SELECT avg(mu) FROM profile), 9) AS epsilon FROM profile GROUP BY 1""", "profile"))
def level_means(spark, d):
    sums = T.counts(spark, d).join(T.cells(spark, d), "obs").groupBy("grp", "feature").agg(F.sum("value").alias("value"))
    mu = sums.select("grp", "feature", (F.col("value") / F.greatest(F.sum("value").over(Window.partitionBy("grp")), F.lit(1))).alias("value"))
    level = T.table(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("feature"))
    out = C.level_rows(mu, level)
    return out.select("grp", F.round("mean", 9).alias("mean"), F.round("total", 6).alias("total"), F.round("epsilon", 9).alias("epsilon"))


@query("membership_means", with_inputs("""+ n AS (SELECT grp, count(*) AS n FROM cells GROUP BY 1), k AS (SELECT DISTINCT batch AS class FROM cells),
    m AS (SELECT n.grp, k.class, coalesce(w, 0) * 1.0 / n AS mean FROM n CROSS JOIN k LEFT JOIN (SELECT grp, batch AS class, sum(obs % 3) AS w FROM cells GROUP BY 1, 2) s ON s.grp = n.grp AND s.class = k.class)
    SELECT grp, class, round(mean, 6) AS mean, round(CASE WHEN stddev_pop(mean) OVER (PARTITION BY class) > 0 THEN (mean - avg(mean) OVER (PARTITION BY class)) / stddev_pop(mean) OVER (PARTITION BY class) ELSE 0 END, 6) AS z FROM m""", "cells"))
def membership_means(spark, d):
    cells = T.cells(spark, d)
    out = C.membership_means(cells.select("obs", F.col("batch").alias("class"), (F.col("obs") % 3).cast("double").alias("weight")), cells.select("obs", "grp"))
    return out.select("grp", "class", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"))


@query("decoder_expectation", with_inputs("""SELECT grp, p_partkey % 11 AS feature, round(1e4 * sum(p_size * t.theta), 4) AS value
    FROM (SELECT grp, batch AS topic, sum(obs % 5) AS theta FROM cells GROUP BY 1, 2) t JOIN part b ON length(t.topic) = p_size % 13 GROUP BY 1, 2""", "cells"))
def decoder_expectation(spark, d):
    cells = T.cells(spark, d)
    latent = cells.select("obs", F.length("batch").alias("topic"), (F.col("obs") % 5).alias("theta"))
    beta = T.table(spark, d, "part").select((F.col("p_size") % 13).alias("topic"), (F.col("p_partkey") % 11).alias("feature"), F.col("p_size").alias("beta"))
    out = C.decoder_expectation(beta, latent, cells.select("obs", "grp"))
    return out.select("grp", "feature", F.round("value", 4).alias("value"))


@query("evenly_spaced", with_inputs("""+ p AS (SELECT obs, grp, row_number() OVER (PARTITION BY grp ORDER BY obs) - 1 AS at, count(*) OVER (PARTITION BY grp) AS n FROM cells),
    g AS (SELECT grp, n, unnest(range(least(n, 10))) AS i FROM (SELECT DISTINCT grp, n FROM p)) SELECT obs, p.grp FROM p JOIN g ON g.grp = p.grp AND p.at = g.i * g.n // least(g.n, 10)""", "cells"))
def evenly_spaced(spark, d):
    return C.spaced(T.cells(spark, d).select("obs", "grp"), most=10)


@query("markers_up", with_inputs("""SELECT s.grp, p.class, any_value(k.n) AS markers, count(DISTINCT feature) AS measured, count(DISTINCT CASE WHEN value >= 20 THEN feature END) AS up
    FROM sums s JOIN panel p USING (feature) JOIN (SELECT class, count(DISTINCT feature) AS n FROM panel GROUP BY 1) k USING (class) GROUP BY 1, 2""", "sums", "panel"))
def markers_up(spark, d):
    sums = T.counts(spark, d).join(T.cells(spark, d), "obs").groupBy("grp", "feature").agg(F.sum("value").alias("value"))
    return C.markers_up(T.panel(spark, d), sums.select("grp", "feature", F.log2(F.col("value").cast("double") / 10).alias("log2fc")))


@query("largest_gap", """WITH g AS (SELECT s_nationkey AS tree, s_acctbal::DOUBLE AS height, lag(s_acctbal::DOUBLE) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS b FROM supplier),
    k AS (SELECT tree, (height + b) / 2 AS cut, row_number() OVER (PARTITION BY tree ORDER BY height - b DESC, height) AS r FROM g WHERE b IS NOT NULL)
    SELECT t.tree, round(cut, 4) AS cut FROM (SELECT DISTINCT tree FROM g) t LEFT JOIN (SELECT * FROM k WHERE r = 1) k USING (tree)""")
def largest_gap(spark, d):
    merges = T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("tree"), F.col("s_acctbal").cast("double").alias("height"))
    return C.largest_gap(merges).withColumn("cut", F.round("cut", 4))


_RANKS = """+ r AS (SELECT grp, class, 'score' AS method, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, class) AS rank FROM sums JOIN panel USING (feature) GROUP BY 1, 2
    UNION ALL SELECT grp, class, 'sum', row_number() OVER (PARTITION BY grp ORDER BY sum(value) DESC, class) FROM sums JOIN panel USING (feature) GROUP BY 1, 2)"""


def _ranking(spark, d):
    sums = T.counts(spark, d).join(T.cells(spark, d), "obs").groupBy("grp", "feature").agg(F.sum("value").alias("value"))
    per = sums.join(T.panel(spark, d), "feature").groupBy("grp", "class").agg(F.count(F.lit(1)).alias("score"), F.sum("value").alias("sum"))
    by = Window.partitionBy("grp")
    one = lambda m: per.select("grp", "class", F.lit(m).alias("method"), F.row_number().over(by.orderBy(F.desc(m), "class")).alias("rank"))
    return one("score").unionByName(one("sum"))


@query("label_choices", with_inputs(_RANKS + """, c AS (SELECT grp, class, count(*) FILTER (rank = 1) AS firsts, min(rank) AS best, min(rank) FILTER (method = 'score') AS s FROM r GROUP BY 1, 2 HAVING min(rank) <= 3)
    SELECT grp, class, firsts, best, row_number() OVER (PARTITION BY grp ORDER BY firsts DESC, s NULLS LAST, best, class) AS place FROM c""", "sums", "panel"))
def label_choices(spark, d):
    return C.label_choices(_ranking(spark, d))


@query("candidate_listing", with_inputs(_RANKS + " SELECT DISTINCT grp, class FROM r WHERE method = 'sum' AND rank <= 10 OR rank = 1", "sums", "panel"))
def candidate_listing(spark, d):
    return C.candidate_listing(_ranking(spark, d), "sum", limit=10)


@query("cluster_order", with_inputs("""+ n AS (SELECT grp, label, count(*) AS n FROM cells LEFT JOIN calls USING (obs) GROUP BY 1, 2),
    g AS (SELECT grp, label FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY label IS NULL, n DESC, label) = 1),
    o AS (SELECT p_type AS label, max(p_size) AS position FROM part WHERE p_type < 'S' GROUP BY 1)
    SELECT grp, label, row_number() OVER (ORDER BY position NULLS LAST, label NULLS LAST, grp) AS place FROM g LEFT JOIN o USING (label)""", "cells", "calls"))
def cluster_order(spark, d):
    order = T.table(spark, d, "part").where("p_type < 'S'").groupBy(F.col("p_type").alias("class")).agg(F.max("p_size").alias("position"))
    return C.cluster_order(L.group_digest(T.cells(spark, d), T.calls(spark, d)), order)


@query("once_each", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def once_each(spark, d):
    return C.once_each(T.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_CLASS = "array_to_string(list_filter(regexp_split_to_array({}, '[\\s,_]+'), lambda w: w <> ''), '_')"


@query("marker_edits", f"""SELECT DISTINCT p_partkey::VARCHAR AS feature, {_CLASS.format('p_type')} AS class FROM part WHERE p_size <> 1
    UNION SELECT p_partkey::VARCHAR, 'new_class' FROM part WHERE p_size <= 3""")
def marker_edits(spark, d):
    part = T.table(spark, d, "part")
    feature = F.col("p_partkey").cast("string")
    add = part.where("p_size <= 3").select(F.col("p_partkey").alias("line_no"), F.lit("markers_add").alias("action"), F.lit("new class").alias("label"), F.array(F.concat(F.lit(" "), feature)).alias("features"))
    drop = part.where("p_size = 1").select((F.col("p_partkey") + 10_000_000).alias("line_no"), F.lit("markers_drop").alias("action"), F.col("p_type").alias("label"), F.array(feature).alias("features"))
    return C.edit_markers(part.select(feature.alias("feature"), F.col("p_type").alias("class")), add.unionByName(drop))


@query("moved_markers", "SELECT p_type AS class, p_partkey AS feature FROM part WHERE p_size > 5 OR p_type = (SELECT min(p_type) FROM part)")
def moved_markers(spark, d):
    part = T.table(spark, d, "part")
    label = part.agg(F.min("p_type")).first()[0]
    return C.take_added(part.select(F.col("p_type").alias("class"), F.col("p_partkey").alias("feature")), part.where("p_size <= 5").select(F.col("p_partkey").alias("feature")), label)


@query("region_links", """WITH w AS (SELECT user_id AS obs, event_type AS region, count(*) AS weight FROM events GROUP BY 1, 2), n AS (SELECT region, sum(weight) AS n FROM w GROUP BY 1)
    SELECT x.region AS a, y.region AS b, round(sum(x.weight * y.weight) / sqrt(any_value(na.n) * any_value(nb.n)), 6) AS link
    FROM w x JOIN w y ON x.obs = y.obs AND x.region < y.region JOIN n na ON na.region = x.region JOIN n nb ON nb.region = y.region GROUP BY 1, 2""")
def region_links(spark, d):
    w = T.table(spark, d, "events").groupBy(F.col("user_id").alias("obs"), F.col("event_type").alias("region")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return C.region_links(w).withColumn("link", F.round("link", 6))


@query("mean_vectors", with_inputs("SELECT grp, dim::INTEGER AS dim, round(avg(x), 6) AS x FROM (SELECT grp, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM vectors) GROUP BY 1, 2", "vectors"))
def mean_vectors(spark, d):
    means = C.mean_vectors(T.vectors(spark, d), "grp")
    return means.select("grp", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("centred_units", with_inputs("""+ e AS (SELECT obs, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM vectors), c AS (SELECT dim, avg(x) AS m FROM e GROUP BY 1), m AS (SELECT obs, dim, x - m AS x FROM e JOIN c USING (dim))
    SELECT obs, dim::INTEGER AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY obs)), 6) AS x FROM m""", "vectors"))
def centred_units(spark, d):
    return C.centred_unit(T.vectors(spark, d), "obs").select("obs", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("level_choice", with_inputs("""SELECT label, round(count(*) FILTER (batch IN ('BUILDING', 'MACHINERY', 'FURNITURE')) * 1.0 / count(*), 6) AS share FROM calls JOIN cells USING (obs) GROUP BY 1
    HAVING count(*) FILTER (batch IN ('BUILDING', 'MACHINERY', 'FURNITURE')) * 1.0 / count(*) > 0.5""", "calls", "cells"))
def level_choice(spark, d):
    roots = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("FURNITURE",)], "label string")
    out = C.level_choice(T.calls(spark, d), T.cells(spark, d).select("obs", F.col("batch").alias("label")), roots)
    return out.withColumn("share", F.round("share", 6))


def _leaf_mass(spark, d):
    c = T.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("grp"), F.concat(F.lit("N"), "c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("grp", "id", (F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).alias("mass"))


_MASS = """WITH leaf AS (SELECT c_mktsegment AS grp, 'N' || c_nationkey AS id, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS mass FROM customer GROUP BY 1, 2),
    up AS (SELECT 'N' || n_nationkey AS id, 'N' || n_nationkey AS anc FROM nation UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'N' || n_nationkey, 'ROOT' FROM nation),
    mass AS (SELECT grp, anc AS id, sum(mass) AS mass FROM leaf JOIN up USING (id) GROUP BY 1, 2)"""


@query("node_mass", _MASS + " SELECT grp, id, round(mass, 6) AS mass FROM mass")
def node_mass(spark, d):
    return C.node_mass(G.closure(T.taxonomy(spark, d)), _leaf_mass(spark, d)).withColumn("mass", F.round("mass", 6))


@query("taxonomy_walk", _MASS + """, r AS (SELECT grp, id, mass, lead(mass) OVER w AS next, row_number() OVER w AS n FROM mass WHERE id LIKE 'R%' AND id <> 'ROOT' AND mass >= 0.05 WINDOW w AS (PARTITION BY grp ORDER BY mass DESC, id)),
    s1 AS (SELECT m.grp, m.mass AS root, r.id, r.mass, r.mass - r.next <= 1e-9 AS tied FROM mass m LEFT JOIN r ON r.grp = m.grp AND r.n = 1 WHERE m.id = 'ROOT'),
    l AS (SELECT s1.grp, m.id, m.mass, lead(m.mass) OVER w AS next, row_number() OVER w AS n FROM s1 JOIN nation ON s1.id = 'R' || n_regionkey JOIN mass m ON m.grp = s1.grp AND m.id = 'N' || n_nationkey WHERE m.mass >= 0.05 WINDOW w AS (PARTITION BY s1.grp ORDER BY m.mass DESC, m.id))
    SELECT s1.grp, CASE WHEN s1.id IS NULL OR coalesce(s1.tied, false) THEN 'ROOT' WHEN l.id IS NULL OR coalesce(l.mass - l.next <= 1e-9, false) THEN s1.id ELSE l.id END AS id,
        round(CASE WHEN s1.id IS NULL OR coalesce(s1.tied, false) THEN s1.root WHEN l.id IS NULL OR coalesce(l.mass - l.next <= 1e-9, false) THEN s1.mass ELSE l.mass END, 6) AS mass,
        coalesce(s1.tied, false) OR coalesce(l.mass - l.next <= 1e-9, false) AS abstained FROM s1 LEFT JOIN l ON l.grp = s1.grp AND l.n = 1""")
def taxonomy_walk(spark, d):
    mass = C.node_mass(G.closure(T.taxonomy(spark, d)), _leaf_mass(spark, d))
    roots = spark.createDataFrame([("ROOT",)], "id string")
    return C.walk(T.taxonomy(spark, d), roots, mass, least=0.05).withColumn("mass", F.round("mass", 6))


def _labels(spark, d):
    k, n = F.col("n_nationkey"), T.table(spark, d, "nation")
    label = (
        F.when(k % 4 == 0, F.lower("n_name")).when(k % 4 == 1, F.concat(F.lit("Nations, "), k)).when(k % 4 == 2, F.concat(k, F.lit(" nation")))
        .when(k % 8 == 3, F.concat("n_name", F.lit("_extra"))).otherwise(F.concat("n_name", F.lit(" other")))
    )
    labels = n.select(label.alias("label")).unionByName(spark.createDataFrame([("The First",)], "label string"))
    names = n.select(F.concat(F.lit("N"), k).alias("id"), F.col("n_name").alias("name"), F.lit(True).alias("own"))
    return M.match_labels(labels, names, spark.createDataFrame([("The_First", "N0")], "key string, id string"), ["extra"])


_MATCHED = """WITH m AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) WHEN n_nationkey % 4 = 1 THEN 'Nations, ' || n_nationkey WHEN n_nationkey % 4 = 2 THEN n_nationkey || ' nation'
    WHEN n_nationkey % 8 = 3 THEN n_name || '_extra' ELSE n_name || ' other' END AS label, CASE WHEN n_nationkey % 8 < 7 THEN 'N' || n_nationkey END AS id,
    CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE ['name', 'singular', 'order', 'unqualified'][n_nationkey % 4 + 1] END AS how FROM nation UNION ALL SELECT 'The First', 'N0', 'alias')"""


@query("label_matching", _MATCHED + " SELECT label, id, how FROM m")
def label_matching(spark, d):
    return _labels(spark, d)


@query("placement_counts", _MATCHED + " SELECT coalesce(how, 'unmatched') AS how, count(*) AS labels FROM m GROUP BY 1")
def placement_counts(spark, d):
    return M.placement_counts(_labels(spark, d))


@query("prior_edges", with_inputs("SELECT parent AS a, child AS b FROM taxonomy", "taxonomy"))
def prior_edges(spark, d):
    told = T.taxonomy(spark, d).select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit("precedes").alias("relation"), F.lit(1).alias("layer"), F.lit(0).alias("line"))
    short = T.taxonomy(spark, d).select(F.lit("ROOT").alias("a"), F.col("child").alias("b"), F.lit("precedes").alias("relation"), F.lit(0).alias("layer"), F.lit(0).alias("line"))
    return PR.build_prior(told.unionByName(short))["edges"]


@query("prepared_vectors", with_inputs("""+ e AS (SELECT obs, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM vectors), c AS (SELECT dim, avg(exp(x)) AS m, stddev_pop(exp(x)) AS s FROM e GROUP BY 1)
    SELECT obs, dim::INTEGER AS dim, round(CASE WHEN s > 0 THEN (exp(x) - m) / s ELSE 0 END, 5) AS x FROM e JOIN c USING (dim)""", "vectors"))
def prepared_vectors(spark, d):
    return M.prepared(T.vectors(spark, d), "exp_z").select("obs", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 5))


@query("whitened_vectors", None)
def whitened_vectors(spark, d):
    v = T.vectors(spark, d)
    return M.whitened(v, G.balanced_centre(v), G.within_covariance(v))


@query("kind_words", """WITH p AS (SELECT n_nationkey % 3 AS r, count(*) AS n FROM nation GROUP BY 1) SELECT CASE r WHEN 0 THEN 'big' WHEN 1 THEN 'small' ELSE 'odd' END AS word, n AS pairs, CASE r WHEN 2 THEN 0 ELSE n END AS kinds, CASE r WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS share FROM p""")
def kind_words(spark, d):
    n, k = T.table(spark, d, "nation"), F.col("n_nationkey")
    word = F.when(k % 3 == 0, "Big ").when(k % 3 == 1, "small ").otherwise("odd ")
    plain = n.select(F.concat(F.lit("N"), k).alias("id"), F.col("n_name").alias("name"))
    longer = n.select(F.concat(F.lit("M"), k).alias("id"), F.concat(word, "n_name").alias("name"))
    below = n.where(k % 3 < 2).select(F.concat(F.lit("M"), k).alias("id"), F.concat(F.lit("N"), k).alias("anc"))
    return M.kind_words(plain.unionByName(longer), below)
