"""Corpus, vocabulary and word-graph operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.sources.shared import held

#: Letters and digits with inner apostrophes, stops and underscores.
WORD = r"[\p{L}\p{N}]+(?:['’._][\p{L}\p{N}]+)*"


def tokens(text: str | Column, least: int = 2) -> Column:
    """Lower-case words of ``least`` characters or more that aren't numbers, as an array."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)
    return F.filter(found, lambda w: (F.char_length(w) >= least) & ~w.rlike(r"^[\p{N}._]+$"))


def corpus_merge(docs: DataFrame) -> DataFrame:
    """One row for each (type, feature): the first non-empty name and text in source order."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct("source_order", "row")))
    return docs.groupBy("type", "feature").agg(first("name").alias("name"), first("text").alias("text"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(word, df): each word once for each document."""
    words = docs.select("doc", F.explode(F.array_distinct(tokens("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(df: DataFrame, n_docs: int, lower: float, upper: float, least_df: int, most_share: float) -> DataFrame:
    """Verdicts by order statistics of the df list: kept, rare or common; rare wins.

    The two cuts come from counts of words by df, so the long list is never sorted whole.
    """
    by_df = df.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.orderBy("df"))  # a row for each distinct df
    steps = by_df.select("df", below.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("v"))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(q) * F.col("v")), F.col("v") - 1), F.col("df")))
    cuts = steps.agg(at(lower).alias("low"), at(upper).alias("high"))
    verdict = F.when((F.col("df") <= F.col("low")) | (F.col("df") < least_df), "rare").when((F.col("df") >= F.col("high")) | (F.col("df") > most_share * n_docs), "common").otherwise("kept")
    return df.crossJoin(cuts).select("word", "df", verdict.alias("verdict"))  # cuts are one row


def df_histogram(df: DataFrame, n_docs: int, bins: int = 24) -> DataFrame:
    width = F.log10(F.lit(float(max(n_docs, 2)))) / bins
    return df.groupBy(F.least(F.floor(F.log10("df") / width + F.lit(1e-9)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("words"))


#: The most frequent words, whose df goes to every task.
COMMON = 200_000


def tfidf_top(docs: DataFrame, df: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(doc, rank, word, weight): (1 + ln count) * ln((1 + N) / (1 + df)), the k largest.

    Texts are dealt by document once and their words counted and ranked where they lie.  The df of the
    ``COMMON`` most frequent words is broadcast; where there are more words, the others' weights have
    bounds, and only words that may be among the k largest meet their df by a shuffle.
    """
    df = held(df)
    common = held(df.orderBy(F.desc("df"), "word").limit(COMMON))
    cut, n_common = common.agg(F.min("df"), F.count(F.lit(1))).first()
    weight = lambda d: (1 + F.log("tf")) * F.log(F.lit(1.0 + n_docs) / (1 + d))
    counts = docs.repartition("doc").select("doc", F.explode(tokens("text")).alias("word")).groupBy("doc", "word").agg(F.count(F.lit(1)).alias("tf"))
    if n_common < COMMON:
        found = counts.join(F.broadcast(common), "word")
    else:
        bounds = counts.join(F.broadcast(common), "word", "left").withColumn("low", F.round(weight(F.coalesce("df", F.lit(cut))), 9))
        at = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("low")))
        kth = F.max(F.when(F.col("at") == k, F.col("low"))).over(Window.partitionBy("doc"))
        near = bounds.withColumn("at", at).withColumn("kth", kth).where(F.col("kth").isNull() | (F.round(weight(F.coalesce("df", F.lit(1))), 9) >= F.col("kth")))
        found = near.select("doc", "word", "tf").join(df, "word")
    by = Window.partitionBy("doc").orderBy(F.desc(F.round("weight", 9)), "word")
    scored = found.withColumn("weight", weight(F.col("df"))).where("weight > 0")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("doc", "rank", "word", "weight")


def keyword_scores(members: DataFrame, weights: DataFrame, k: int = 8) -> DataFrame:
    """(grp, rank, word, score): summed weights of a group's documents' words; ties by word."""
    scored = members.join(weights, "doc").groupBy("grp", "word").agg(F.sum("weight").alias("score"))
    by = Window.partitionBy("grp").orderBy(F.desc(F.round("score", 9)), "word")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("grp", "rank", "word", "score")


def overlaps(spans: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of a key that overlap: start before the other's end and end after its start."""
    o = others.select(key, F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("id").alias("o_id"))
    return spans.join(o, key).where((F.col("end") > F.col("o_start")) & (F.col("start") < F.col("o_end")))


def strip_braces(text: str | Column) -> Column:
    """Braced remarks taken out, nested to any depth, and white space collapsed; a brace without its partner stays."""
    c = F.col(text) if isinstance(text, str) else text
    pieces = F.regexp_extract_all(c, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    # Open remarks are a stack of what was read in them; a closing brace drops the top one.
    below = lambda s: F.slice(s, F.lit(1), F.size(s) - 1)
    add = lambda s, x: F.array_append(below(s), F.concat(F.element_at(s, -1), x))
    step = lambda s, x: F.when(x == "{", F.array_append(s, F.lit(""))).when((x == "}") & (F.size(s) > 1), below(s)).otherwise(add(s, x))
    kept = F.array_join(F.aggregate(pieces, F.array(F.lit("")), step), "{")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))
