"""Text sources: panels, labels, groups, sets, taxonomies, aliases, statements, decisions, patterns.

All go through Spark's readers, so paths may lie anywhere Spark reaches and gzip is understood.
Curated files whose line numbers matter (panels, statements, decisions) are read whole, a row a
file; files that grow with the observations are read by lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.labels import group_id, label_key

#: Names of header cells.
TYPE_HEADERS, FEATURE_HEADERS = ("celltype", "cell_type", "type", "label"), ("gene", "symbol")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, line) of curated files, each read whole."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    split = text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return split.select("file", (F.col("n") + 1).alias("line_no"), "line")


def _cells(line: str) -> Column:
    """Cells of a line: tabs win, else commas outside double quotes (doubled quotes stand for one)."""
    raw = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    quoted = F.transform(raw, lambda c: F.when(F.trim(c).rlike('^".*"$'), F.replace(F.regexp_extract(F.trim(c), '^"(.*)"$', 1), F.lit('""'), F.lit('"'))).otherwise(F.trim(c)))
    return F.when(F.contains(line, F.lit("\t")), F.transform(F.split(line, "\t"), lambda c: F.trim(c))).otherwise(quoted)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(feature, class) rows of a class-feature panel.

    Lines that start with # or % and blank ones are comments.  A first row that names the class
    column before the feature column swaps the columns; a first row that starts with a feature
    header is left out.  Classes become label keys; rows without one, or without a feature, go.
    """
    rows = lines(spark, path).where("trim(line) != '' and not trim(line) rlike '^[#%]'").withColumn("c", _cells(F.col("line"))).where(F.size("c") >= 2)
    rows = rows.select("file", "line_no", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))
    first = rows.groupBy("file").agg(F.min_by(F.struct("x", "y", "line_no"), "line_no").alias("h"))
    swaps = F.lower("h.x").isin(*TYPE_HEADERS) & F.lower("h.y").isin(*FEATURE_HEADERS)
    heads = swaps | F.lower("h.x").isin(*FEATURE_HEADERS)
    told = rows.join(F.broadcast(first.select("file", swaps.alias("swaps"), F.when(heads, F.col("h.line_no")).alias("head"))), "file")  # a row a file
    body = told.where("head is null or line_no != head")
    pairs = body.select(F.when(F.col("swaps"), F.col("y")).otherwise(F.col("x")).alias("feature"), label_key(F.when(F.col("swaps"), F.col("x")).otherwise(F.col("y"))).alias("class"))
    return pairs.where("feature != '' and class != ''")


def read_labels(spark: SparkSession, path: str, short_rows: list[int] | None = None) -> DataFrame:
    """(key, label, probability) of observations: Parquet by column names, or delimited text.

    Text has the observation first and its label second; # lines, a header (a file's first row, if
    it names ``cell`` first) and rows without a label column are left out, the last counted into
    ``short_rows``.  A header's ``probability`` column is read by its name.
    """
    if path.rstrip("/").endswith((".parquet", ".pq")):
        table = spark.read.parquet(path)
        p = F.col("probability").cast("double") if "probability" in table.columns else F.lit(None).cast("double")
        return table.select(F.col("cell").cast("string").alias("key"), F.col("cell_type").cast("string").alias("label"), p.alias("probability")).where("key != '' and label != ''")
    told = "trim(value) != '' and not value like '#%'"
    every = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").where(told)
    rows = every.where("block = 0")  # a file's first row lies in its first block
    first = rows.groupBy("file").agg(F.min_by(F.struct("at", _cells(F.col("value")).alias("c")), "at").alias("h"))
    names = F.transform("h.c", lambda c: F.lower(c))
    heads = first.where(F.lower(F.col("h.c")[0]) == "cell").select("file", F.col("h.at").alias("head"), F.array_position(names, "probability").alias("place"))
    body = every.join(F.broadcast(heads), "file", "left").where("head is null or at != head").withColumn("c", _cells(F.col("value")))  # a row a file
    body = body.where(F.col("c")[0] != "")
    if short_rows is not None:
        short_rows.append(body.where(F.size("c") < 2).count())
    p = F.when(F.col("place") > 0, F.get("c", F.col("place").cast("int") - 1)).try_cast("double")
    return body.where(F.size("c") >= 2).select(F.col("c")[0].alias("key"), F.col("c")[1].alias("label"), p.alias("probability"))


def read_groups(groups: DataFrame, key: str) -> DataFrame:
    """(obs, grp): column ``cluster``, else the first beside ``key``; negative, NaN and missing values, and rows whose ``entropy`` isn't finite, have no group.  A table without any group is an error."""
    column = "cluster" if "cluster" in groups.columns else next(c for c in groups.columns if c != key)
    value = F.col(column).cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (value >= 0)
    if "entropy" in groups.columns:
        entropy = F.col("entropy").cast("double")
        good &= entropy.isNotNull() & ~F.isnan(entropy) & (F.abs(entropy) < float("inf"))
    out = groups.select(F.col(key).alias("obs"), F.when(good, value.cast("int")).alias("grp"))
    if out.where("grp is not null").isEmpty():
        raise ValueError("no observation has a group")
    return out


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(term, description, feature) rows of set files: term, description and members by tabs."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c")).where("size(c) > 2")
    members = F.explode(F.array_distinct(F.filter(F.transform(F.expr("slice(c, 3, size(c))"), lambda x: F.trim(x)), lambda x: x != ""))).alias("feature")
    return cells.select(F.trim(F.col("c")[0]).alias("term"), F.col("c")[1].alias("description"), members)


def read_annotations(spark: SparkSession, path: str, evidence: tuple[str, ...] | None = None) -> DataFrame:
    """(feature, term, evidence) of annotation files: ! lines and negated rows are left out; ``evidence`` keeps those codes only."""
    cells = spark.read.text(path).where("not value like '!%'").select(F.split("value", "\t").alias("c")).where("size(c) >= 7")
    rows = cells.where("not array_contains(split(c[3], '[|]'), 'NOT')").select(F.col("c")[2].alias("feature"), F.col("c")[4].alias("term"), F.col("c")[6].alias("evidence"))
    return (rows.where(F.col("evidence").isin(*evidence)) if evidence else rows).distinct()


def read_taxonomy(spark: SparkSession, path: str, scopes: tuple[str, ...] = ("EXACT",)) -> DataFrame:
    """A row per living term: id, name, synonyms (of ``scopes``), parents, origins, subsets; parents in file order.

    Stanzas are the records of the reader, so a large file is read in parallel.
    """
    stanza = spark.read.text(path, lineSep="\n[").select(F.regexp_replace("value", r"(?m)^[ \t]+|[ \t\r]+$", "").alias("s")).where(F.col("s").rlike(r"^\[?Term\]"))
    one = lambda tag: F.regexp_extract("s", rf"(?m)^{tag}:[ \t]*(.*)$", 1)
    every = lambda pattern, group=1: F.regexp_extract_all("s", F.lit(rf"(?m)^{pattern}"), F.lit(group))
    synonym = r'synonym:[ \t]*"((?:[^"\\]|\\.)*)"[ \t]*(\S*)'  # quotes inside are escaped
    pairs = F.arrays_zip(every(synonym, 1).alias("text"), every(synonym, 2).alias("scope"))
    kept = F.transform(F.filter(pairs, lambda x: x["scope"].isin(*scopes)), lambda x: F.regexp_replace(x["text"], r"\\(.)", "$1"))
    return stanza.select(
        F.trim(one("id")).alias("id"), F.trim(one("name")).alias("name"), kept.alias("synonyms"), every(r"is_a:[ \t]*(\S+)").alias("parents"),
        every(r"relationship:[ \t]*(?:RO:0002202|develops_from)[ \t]+(\S+)").alias("origins"), every(r"subset:[ \t]*(\S+)").alias("subsets"),
        F.col("s").rlike(r"(?m)^is_obsolete:[ \t]*true$").alias("obsolete"),
    ).where("id != '' and not obsolete").drop("obsolete")


def taxonomy_release(spark: SparkSession, path: str) -> str | None:
    """The data version in the head of a taxonomy file."""
    found = spark.read.text(path).where("value like 'data-version:%'").limit(1).collect()
    return found[0][0].split(":", 1)[1].strip() if found else None


def read_aliases(spark: SparkSession, paths: list[str], skipped: list[int] | None = None) -> DataFrame:
    """(label key, id): of one key the last row of the last file counts; rows without an ``X:id`` are skipped and counted."""
    stacked = None
    for layer, path in enumerate(paths):
        cells = lines(spark, path).where("trim(line) != '' and not line like '#%'").withColumn("c", F.split("line", "\t"))
        one = cells.select(F.lit(layer).alias("layer"), "line_no", label_key(F.col("c")[0]).alias("key"), F.trim(F.get("c", F.lit(1))).alias("id"))
        stacked = one if stacked is None else stacked.unionByName(one)
    good = F.coalesce(F.col("id").rlike(r"^[A-Za-z_]+:\S+$"), F.lit(False)) & (F.col("key") != "")
    if skipped is not None:
        skipped.append(stacked.where(~good).count())
    return stacked.where(good).groupBy("key").agg(F.max_by("id", F.struct("layer", "line_no")).alias("id"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, relation, note, line_no) of precedence files, or of a written prior whose first line starts ``# kind``.

    Of a prior the ``statement`` rows are read and the ``edge`` rows passed over.  Any other row, a
    relation that is neither ``precedes`` nor ``unrelated`` and a class before itself are errors
    that name the line.
    """
    all_lines = lines(spark, path)
    kinds = all_lines.where("line_no = 1").select("file", F.ltrim("line").startswith("# kind").alias("kinds"))
    rows = all_lines.where("trim(line) != '' and not trim(line) like '#%'").join(F.broadcast(kinds), "file")  # a row a file
    cells = F.transform(F.split(F.rtrim("line"), "\t"), lambda c: F.trim(c))
    rows = rows.withColumn("c", cells).withColumn("kind", F.when(F.col("kinds"), F.col("c")[0]).otherwise("statement"))
    rows = rows.withColumn("c", F.when(F.col("kinds") & (F.col("kind") == "statement"), F.expr("slice(c, 2, size(c))")).otherwise(F.col("c")))
    heads = F.coalesce((F.lower(F.get("c", F.lit(0))) == "from") & (F.lower(F.get("c", F.lit(1))) == "to"), F.lit(False))
    passed = (F.col("kind") == "edge") | heads  # told again in the fault: filters may run in any order
    relation = F.lower(F.get("c", F.lit(2)))
    fault = (
        F.when(passed, F.lit(None)).when(F.col("kind") != "statement", "expected an edge or statement row").when(F.size("c") < 3, "expected from, to and relation")
        .when(~relation.isin("precedes", "unrelated"), "relation must be precedes or unrelated").when(F.col("c")[0] == F.col("c")[1], "a class cannot precede itself")
    )
    checked = rows.withColumn("fault", fault).withColumn("stop", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(": ", F.concat_ws(":", "file", "line_no"), "fault"))))
    return checked.where(~passed & F.col("stop").isNull()).select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"), relation.alias("relation"), F.expr("array_join(slice(c, 4, greatest(size(c) - 3, 0)), ' ')").alias("note"), "line_no")


DECISION = (
    "action string, label string, features array<string>, into string, round string, rationale string, "
    "decided_by string, timestamp string, evidence array<string>, alternatives array<string>"
)
# Who may have decided.
DECIDED_BY = ("user", "agent_proposed_user_accepted", "user_override", "agent")


def _group_ids(whole: Column) -> tuple[Column, Column]:
    """(ids as text, ids) of ``cluster``, ``clusters`` or ``groups``: a number, a string or a list of them; none is an empty list."""
    raw = F.coalesce(*[F.to_json(F.try_variant_get(whole, f"$.{name}", "variant")) for name in ("cluster", "clusters", "groups")], F.lit("[]"))
    listed = F.when(F.trim(raw) == "null", F.lit("[]")).when(F.startswith(raw, F.lit("[")), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    texts = F.from_json(listed, "array<string>")
    return texts, F.transform(texts, group_id)


def parse_decisions(rows: DataFrame) -> DataFrame:
    """Decisions of (file, line_no, line): only lines that start with a brace count, others are prose.

    ``groups`` are integers, told as ``cluster``, ``clusters`` or ``groups``.  A line that isn't JSON,
    holds an unreadable group id or doesn't say who decided is an error that names it.
    """
    brace = F.ltrim("line").startswith("{")
    parsed = rows.where(brace).withColumn("whole", F.try_parse_json("line")).withColumn("d", F.from_json("line", DECISION))
    texts, ids = _group_ids(F.col("whole"))
    parsed = parsed.withColumn("texts", texts).withColumn("groups", ids)
    bad = F.filter("texts", lambda t: group_id(t).isNull())
    fault = (
        F.when(~brace, F.lit(None)).when(F.col("whole").isNull(), "not JSON").when(F.col("texts").isNull(), "not a group id")
        .when(F.size(bad) > 0, F.concat(F.lit("not a group id: "), F.coalesce(F.element_at(bad, 1), F.lit("null"))))
        .when(~F.coalesce(F.col("d.decided_by").isin(*DECIDED_BY), F.lit(False)), F.concat(F.lit("decided_by must be one of "), F.lit(", ".join(DECIDED_BY))))
    )
    checked = parsed.withColumn("fault", fault).withColumn("stop", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(":", F.coalesce("file", F.lit("decisions")), "line_no", F.concat(F.lit(" "), F.col("fault"))))))
    return checked.where("stop is null").select("line_no", "groups", "d.*")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of JSON lines, see :func:`parse_decisions`."""
    return parse_decisions(lines(spark, path))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern): trimmed lines that are neither blank nor # comments, each once."""
    return spark.read.text(path).select(F.trim("value").alias("pattern")).where("pattern != '' and not pattern like '#%'").distinct()


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """(label, part, place) of mixed labels: a name and its parts by tabs; a repeated name counts once, with its last line."""
    cells = lines(spark, path).where("trim(line) != '' and not line like '#%'").withColumn("c", F.transform(F.split("line", "\t"), lambda x: F.trim(x))).where("size(c) >= 3")
    last = cells.groupBy(F.col("c")[0].alias("label")).agg(F.max_by("c", F.struct("file", "line_no")).alias("c"))
    return last.select("label", F.posexplode(F.expr("filter(slice(c, 2, size(c)), x -> x != '')")).alias("place", "part")).select("label", "part", "place")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of answers ``join``, ``alone`` or ``none`` by label; the last line of a key counts, others than these are an error."""
    cells = lines(spark, path).where("trim(line) != '' and not line like '#%'").withColumn("c", F.split("line", "\t"))
    answer = F.lower(F.trim(F.get("c", F.lit(1))))
    known = F.when(answer.isin("join", "alone", "none"), answer).otherwise(F.raise_error(F.concat_ws(":", "file", "line_no", F.lit(" an answer is join, alone or none"))))
    return cells.groupBy(label_key(F.col("c")[0]).alias("key")).agg(F.max_by(known, F.struct("file", "line_no")).alias("answer"))
