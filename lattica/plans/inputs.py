"""Queries that write the driver's tables in the engine's file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import labels as L
from lattica.plans import curation as U
from lattica.plans.curation import _SHARES
from lattica.sources import readers as R
from lattica.sources import sinks as S
from lattica.sources import tables as T
from lattica.sources.shared import scratch
from lattica.sources.tables import with_inputs
from lattica.streaming import chain, fold

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _key(column: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({column}, '[\\s,_]+'), lambda w: w <> ''), '_')"


def _text(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


@query("panel_file", f"SELECT DISTINCT p_partkey::VARCHAR AS feature, {_key('p_type')} AS class FROM part")
def panel_file(spark, d):
    path = scratch(spark, "panel")
    rows = T.table(spark, d, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_type").alias("value"))
    rows.unionByName(_text(spark, "# features and classes", "% more", "", "\tno feature", "no class\t")).write.text(path)
    return R.read_panel(spark, path).distinct()


@query("label_file", with_inputs("SELECT obs::VARCHAR AS key, label FROM calls", "calls"))
def label_file(spark, d):
    paths = S.write_labels(T.calls(spark, d).withColumn("probability", F.lit(1.0)), scratch(spark, "labels"))
    return R.read_labels(spark, paths["membership.tsv"]).select("key", "label")


@query("label_table", with_inputs("SELECT obs::VARCHAR AS key, label, 0.5::DOUBLE AS probability FROM calls", "calls"))
def label_table(spark, d):
    paths = S.write_labels(T.calls(spark, d).withColumn("probability", F.lit(0.5)), scratch(spark, "labels"))
    return R.read_labels(spark, paths["argmax.parquet"])


@query("group_table", "SELECT c_custkey AS obs, CASE WHEN c_acctbal >= 0 AND c_custkey % 10 <> 0 THEN c_nationkey::INTEGER END AS grp FROM customer")
def group_table(spark, d):
    c = T.table(spark, d, "customer")
    cluster = F.when(F.col("c_acctbal") < 0, F.lit(-1.0)).otherwise(F.col("c_nationkey").cast("double"))
    entropy = F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.lit(0.1))
    return R.read_groups(c.select("c_custkey", entropy.alias("entropy"), cluster.alias("cluster")), "c_custkey")


@query("set_file", "SELECT p_brand AS term, p_partkey::VARCHAR AS feature FROM part")
def set_file(spark, d):
    path = scratch(spark, "sets")
    # A term's members go on several lines, so that no line grows with the table.
    chunks = T.terms(spark, d).groupBy("term", (F.col("feature") / 256).cast("long").alias("chunk")).agg(F.collect_list(F.col("feature").cast("string")).alias("m"))
    chunks.select(F.concat_ws("\t", "term", F.lit("brand"), F.array_join("m", "\t")).alias("value")).write.text(path)
    return R.read_sets(spark, path).select("term", "feature")


@query("annotation_file", "SELECT DISTINCT p_partkey::VARCHAR AS feature, p_brand AS term, 'IDA' AS evidence FROM part WHERE p_size % 3 = 1")
def annotation_file(spark, d):
    path = scratch(spark, "annotations")
    qualifier = F.when(F.col("p_size") % 3 == 0, "NOT|involved_in").otherwise("involved_in")
    code = F.when(F.col("p_size") % 3 == 2, "IEA").otherwise("IDA")
    cells = [F.lit("db"), F.lit("id"), F.col("p_partkey").cast("string"), qualifier, F.col("p_brand"), F.lit("ref"), code]
    T.table(spark, d, "part").select(F.concat_ws("\t", *cells).alias("value")).unionByName(_text(spark, "!gaf-version: 2.2")).write.text(path)
    return R.read_annotations(spark, path, evidence=("IDA", "IMP"))


@query("taxonomy_file", with_inputs("""SELECT child AS id, 'name of ' || child AS name, parent, 'alias ' || child AS synonym FROM taxonomy
    UNION ALL SELECT 'ROOT', 'name of ROOT', NULL, 'alias ROOT'""", "taxonomy"))
def taxonomy_file(spark, d):
    path = scratch(spark, "taxonomy")
    ids = T.taxonomy(spark, d).select(F.col("child").alias("id"), "parent").unionByName(spark.createDataFrame([("ROOT", None)], "id string, parent string"))
    parent = F.when(F.col("parent").isNotNull(), F.concat(F.lit("is_a: "), "parent", F.lit(" ! its parent\n"))).otherwise("")
    synonyms = F.concat(F.lit('synonym: "alias '), "id", F.lit('" EXACT []\nsynonym: "kin of '), "id", F.lit('" BROAD []\n'))
    stanza = F.concat(F.lit("[Term]\nid: "), "id", F.lit("\nname: name of "), "id", F.lit("\n"), synonyms, parent)
    gone = _text(spark, "format-version: 1.2\ndata-version: 7\n", "[Term]\nid: X1\nname: gone\nis_obsolete: true\n", "[Typedef]\nid: part_of\nname: part of\n")
    ids.select(stanza.alias("value")).unionByName(gone).write.text(path)
    return R.read_taxonomy(spark, path).select("id", "name", F.explode_outer("parents").alias("parent"), F.col("synonyms")[0].alias("synonym"))


@query("statement_file", with_inputs("SELECT a, b, 'precedes' AS relation, 'votes ' || votes AS note FROM precedence", "precedence"))
def statement_file(spark, d):
    path = scratch(spark, "statements")
    rows = T.precedence(spark, d).select(F.concat_ws("\t", "a", "b", F.lit("Precedes"), F.lit("votes"), F.col("votes").cast("string")).alias("value"))
    rows.unionByName(_text(spark, "# stated by events", "from\tto\trelation\tnote")).write.text(path)
    return R.read_statements(spark, path).select("a", "b", "relation", "note")


@query("alias_layers", f"""SELECT {_key('p_type')} AS key, CASE WHEN p_type < 'L' THEN 'NEW:' ELSE 'OLD:' END || min(p_size) AS id FROM part GROUP BY p_type""")
def alias_layers(spark, d):
    types = T.table(spark, d, "part").groupBy("p_type").agg(F.min("p_size").alias("n"))
    paths = [scratch(spark, "alias"), scratch(spark, "alias")]
    types.select(F.concat(F.col("p_type"), F.lit("\tOLD:"), F.col("n").cast("string")).alias("value")).unionByName(_text(spark, "no id\tnone", "alone")).write.text(paths[0])
    types.where("p_type < 'L'").select(F.concat(F.lower(F.lit("")), F.col("p_type"), F.lit("\tNEW:"), F.col("n").cast("string")).alias("value")).write.text(paths[1])
    return R.read_aliases(spark, paths)


@query("decision_file", "SELECT 'label' AS action, 'K' || n_nationkey AS grp, n_name AS label, 'r1' AS round FROM nation")
def decision_file(spark, d):
    path = scratch(spark, "decisions")
    rows = T.table(spark, d, "nation").select(F.to_json(F.struct(F.lit("label").alias("action"), F.array(F.concat(F.lit("K"), "n_nationkey")).alias("groups"), F.col("n_name").alias("label"), F.lit("r1").alias("round"), F.lit("user").alias("decided_by"))).alias("value"))
    rows.unionByName(_text(spark, "Here are the decisions:", "```json", "```")).write.text(path)
    return R.read_decisions(spark, path).select("action", F.concat(F.lit("K"), F.col("groups")[0].cast("string")).alias("grp"), "label", "round")


@query("evidence_file", with_inputs(_SHARES + " SELECT grp, label AS class, round(share::FLOAT::DOUBLE, 6) AS share, true AS unscored FROM shares", "cells", "calls"))
def evidence_file(spark, d):
    path = scratch(spark, "evidence")
    S.write_evidence(L.call_shares(T.cells(spark, d), T.calls(spark, d)).withColumnRenamed("label", "class"), path)
    cluster = L.group_id("cluster").alias("grp")
    return spark.read.parquet(path).select(cluster, F.col("celltype").alias("class"), F.round(F.col("share").cast("double"), 6).alias("share"), F.isnan("nes").alias("unscored"))


@query("group_tables", "SELECT c_nationkey AS grp, c_mktsegment AS class, count(*)::DOUBLE AS value FROM customer GROUP BY 1, 2")
def group_tables(spark, d):
    counts = T.cells(spark, d).groupBy("grp", F.col("batch").alias("class")).agg(F.count(F.lit(1)).alias("value"))
    classes = sorted(r[0] for r in counts.select("class").distinct().collect())  # classes of the model
    path = S.write_group_tables({"size": counts}, classes, scratch(spark, "tables"))[0]
    return spark.read.parquet(path).unpivot(["grp"], classes, "class", "value").where("not isnan(value)")


@query("group_descriptions", with_inputs(_SHARES + """, n AS (SELECT grp, label, count(*) AS n FROM cells LEFT JOIN calls USING (obs) GROUP BY 1, 2),
    digest AS (SELECT grp, sum(n) OVER (PARTITION BY grp) AS size, label FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY label IS NULL, n DESC, label) = 1),
    top AS (SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY round(share, 9) DESC, label) AS r FROM shares)
    SELECT grp, '- **' || grp || '** (' || size || '): ' || coalesce(label, 'unassigned') || '; ' || coalesce((SELECT string_agg(t.label, ', ' ORDER BY t.r) FROM top t WHERE t.grp = digest.grp AND t.r <= 3), '') AS markdown FROM digest""", "cells", "calls"))
def group_descriptions(spark, d):
    shares = L.call_shares(T.cells(spark, d), T.calls(spark, d))
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("share", 9)), "label"))
    ranking = shares.select("grp", rank.alias("rank"), F.col("label").alias("class"), F.col("share").alias("effect"))
    return S.describe(L.group_digest(T.cells(spark, d), T.calls(spark, d)), ranking).select("grp", "markdown")


@query("round_chain", with_inputs(f"""+{U._DECISIONS}, {U._INTO.replace("31 +", "(SELECT max(grp) FROM cells) + 1 +")}, next AS (SELECT obs, coalesce(i.into_id, c.grp) AS grp, coalesce(n.label, i.label) AS label
    FROM cells c LEFT JOIN (SELECT unnest(groups) AS grp, into_id, label FROM m) i ON i.grp = c.grp LEFT JOIN (SELECT groups[1] AS grp, label FROM dec WHERE action = 'label') n ON n.grp = c.grp)
    SELECT obs, grp::INTEGER AS grp, CASE WHEN grp = (SELECT max(into_id) FROM m) THEN 'renamed' ELSE label END AS label, 2 AS round FROM next""", "cells"))
def round_chain(spark, d):
    """Decisions as files, applied to a chain: a round by them, then one that renames the last merged group."""
    path, files = scratch(spark, "chain"), scratch(spark, "decisions")
    chain.start(spark, path, U._labelled(spark, d), T.panel(spark, d).select(F.col("feature").cast("string").alias("feature"), "class"))
    told = F.struct("action", F.col("groups").alias("cluster"), "label", "rationale", F.lit("user").alias("decided_by"), F.lit("r0").alias("round"))
    U._decisions(spark, d).coalesce(1).sortWithinPartitions("line").select(F.to_json(told).alias("value")).write.text(files)
    chain.relabel(spark, path, R.read_decisions(spark, files).orderBy("line_no"), base=0)
    last = chain.load(spark, path, chain.latest(spark, path))["cells"].agg(F.max("grp").alias("grp"))
    renamed = last.select(F.lit("chain").alias("file"), F.lit(1).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("label").alias("action"), F.col("grp").alias("cluster"), F.lit("renamed").alias("label"), F.lit("named").alias("rationale"), F.lit("agent").alias("decided_by"), F.lit("r1").alias("round"))).alias("line"))
    now = chain.relabel(spark, path, R.parse_decisions(renamed), must_name=True)
    return chain.load(spark, path, now)["cells"].withColumn("round", F.lit(now.number))


_ENTRIES = "SELECT user_id::INTEGER AS grp, dayofyear(ts)::INTEGER AS round, event_id AS line, CASE WHEN value > 20 THEN event_type END AS label FROM events"


@query("group_fold", f"""WITH e AS ({_ENTRIES}) SELECT grp, round, line, last_value(label IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label,
    last_value(label IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entries
    FROM e WINDOW w AS (PARTITION BY grp ORDER BY round, line)""")
def group_fold(spark, d):
    """Users as groups, days as rounds, events as entries: each with the label it leaves."""
    e = T.table(spark, d, "events")
    label = F.when(F.col("value") > 20, F.col("event_type"))
    return fold.folded(e.select(F.col("user_id").cast("int").alias("grp"), F.dayofyear("ts").alias("round"), F.col("event_id").cast("long").alias("line"), label.alias("label")))
