"""Corpus, vocabulary, JSON and event-window queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import text as X
from lattica.plans.expression import r6
from lattica.sources import tables as T
from lattica.sources.shared import held
from lattica.streaming import windows as S

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_TOK = r"""tok AS (SELECT doc_id AS doc, unnest(list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}]+(?:[''’._][\p{L}\p{N}]+)*)', 1), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[\p{N}._]+$'))) AS word FROM documents)"""
_DF = _TOK + ", freq AS (SELECT word, count(DISTINCT doc) AS df FROM tok GROUP BY 1)"


def _docs(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def _df(spark, d):
    return X.document_frequency(_docs(spark, d))


def _n(spark, d):
    return T.table(spark, d, "documents").count()


@query("document_frequency", f"WITH {_DF} SELECT word, df FROM freq")
def document_frequency(spark, d):
    return _df(spark, d)


@query("vocab_cuts", f"""WITH {_DF.replace("tok AS (", "tok AS MATERIALIZED (").replace("freq AS (", "freq AS MATERIALIZED (")},
    h AS (SELECT df, count(*) AS n FROM freq GROUP BY 1), o AS (SELECT df, sum(n) OVER (ORDER BY df) AS upto, sum(n) OVER () AS v FROM h),
    c AS (SELECT min(df) FILTER (upto > least(floor(0.05 * v), v - 1)) AS low, min(df) FILTER (upto > least(floor(0.995 * v), v - 1)) AS high, (SELECT count(*) FROM documents) AS docs FROM o)
    SELECT word, df, CASE WHEN df <= low OR df < 2 THEN 'rare' WHEN df >= high OR df > 0.5 * docs THEN 'common' ELSE 'kept' END AS verdict FROM freq CROSS JOIN c""")
def vocab_cuts(spark, d):
    return X.vocabulary(_df(spark, d), _n(spark, d), 0.05, 0.995, 2, 0.5)


@query("df_histogram", f"WITH {_DF} SELECT least(floor(log10(df) / (log10((SELECT count(*) FROM documents)::DOUBLE) / 24) + 1e-9), 23)::INTEGER AS bin, count(*) AS words FROM freq GROUP BY 1")
def df_histogram(spark, d):
    return X.df_histogram(_df(spark, d), _n(spark, d))


_TFIDF = _DF + """, tf AS (SELECT doc, word, count(*) AS tf FROM tok GROUP BY 1, 2), w AS (SELECT doc, word, (1 + ln(tf)) * ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) AS weight FROM tf JOIN freq USING (word)),
    top AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 9) DESC, word) AS rank, word, weight FROM w WHERE weight > 0 QUALIFY rank <= 5)"""


def _top(spark, d):
    return X.tfidf_top(_docs(spark, d), _df(spark, d), _n(spark, d), 5)


@query("tfidf_top_words", f"WITH {_TFIDF} SELECT doc, rank, word, round(weight, 6) AS weight FROM top")
def tfidf_top_words(spark, d):
    return r6(_top(spark, d), "weight")


@query("keyword_scores", f"""WITH {_TFIDF}, s AS (SELECT source AS grp, word, sum(weight) AS score FROM top JOIN documents ON doc_id = doc GROUP BY 1, 2)
    SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, word) AS rank, word, round(score, 6) AS score FROM s QUALIFY rank <= 8""")
def keyword_scores(spark, d):
    members = T.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("grp"))
    return r6(X.keyword_scores(members, _top(spark, d)), "score")


@query("anti_join_own_words", f"""WITH {_TFIDF}, s AS (SELECT source, word, sum(weight) AS score FROM top JOIN documents ON doc_id = doc GROUP BY 1, 2),
    e AS (SELECT source, word FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, word) <= 8)
    SELECT doc_id AS doc, e.word FROM documents JOIN e USING (source) WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.doc = doc_id AND tok.word = e.word)""")
def anti_join_own_words(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("grp"))
    shown = held(X.keyword_scores(docs, _top(spark, d)).select("grp", "word"))
    # Only words that are shown are kept of the texts, before any shuffle (the table's size is known, as it is held).
    own = _docs(spark, d).select("doc", F.explode(X.tokens("text")).alias("word")).join(shown.select("word"), "word", "left_semi").distinct()
    return docs.join(shown, "grp").select("doc", "word").join(own, ["doc", "word"], "left_anti")


@query("corpus_merge", """WITH c AS (SELECT lang AS type, doc_id % 100 AS feature, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS name, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS text, doc_id % 4 AS source_order, doc_id AS row FROM documents)
    SELECT type, feature, arg_min(name, row(source_order, row)) FILTER (trim(coalesce(name, '')) <> '') AS name, arg_min(text, row(source_order, row)) FILTER (trim(coalesce(text, '')) <> '') AS text FROM c GROUP BY 1, 2""")
def corpus_merge(spark, d):
    i = F.col("doc_id")
    docs = T.table(spark, d, "documents").select(
        F.col("lang").alias("type"), (i % 100).alias("feature"), F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("name"),
        F.when(i % 5 != 0, F.col("text")).alias("text"), (i % 4).alias("source_order"), i.alias("row"),
    )
    return X.corpus_merge(docs)


@query("interval_overlap_join", """WITH a AS (SELECT user_id, event_id AS id, floor(value * 10)::BIGINT AS s, floor(value * 10)::BIGINT + 40 AS e FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
    b AS (SELECT user_id, event_id AS id, floor(value * 10)::BIGINT AS s, floor(value * 10)::BIGINT + 25 AS e FROM events WHERE event_type = (SELECT max(event_type) FROM events))
    SELECT a.id, b.id AS o_id FROM a JOIN b USING (user_id) WHERE a.e > b.s AND a.s < b.e""")
def interval_overlap_join(spark, d):
    e = T.table(spark, d, "events")
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    start = F.floor(F.col("value") * 10).cast("long")
    span = lambda kind, n: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), start.alias("start"), (start + n).alias("end"))
    return X.overlaps(span(low, 40), span(high, 25), "user_id").select("id", "o_id")


@query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    parsed = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return T.table(spark, d, "events").select("event_id", parsed.alias("k"))


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, d):
    return S.tumbling(T.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS finish, user_id, count(*) AS n FROM s GROUP BY user_id, s.s""")
def event_sessions(spark, d):
    return S.sessions(T.table(spark, d, "events"))


@query("conversation_turns", """SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after, first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_turn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def conversation_turns(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return T.table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.min("turn").over(Window.partitionBy("conv_id")).alias("first_turn"))
