"""Document fingerprints by I-Match with randomised lexicons.

The lexicon is every term whose inverse document frequency ln(N / df) lies in a band,
counted over all documents.  A term above the band comes back where copies alone put it
there: documents that share one of eight keys of six minima each (near copies do) with a
thousandth of all documents or more weigh as one, and the term's weight is held against the
band's upper end again.  So a large group of near copies keeps its own terms.  A document keeps its lexicon terms, distinct and sorted, and
hashes them within several random subsets of the lexicon.  The subsets are thinned until a
document of its size has about one term in each (at two neighbouring rates, so that documents
of like size share one); equal hashes of a subset mean equal terms there, and the likeness of
two fingerprints is the share of equal hashes among subsets in which either has a term.

The band bounds the lexicon: each of its terms is in N * LEAST_SHARE documents or more, so it
has at most (mean distinct terms a document) / LEAST_SHARE terms, however many documents
there are.  It is broadcast while it has ``BROADCAST_TERMS`` terms or fewer; beyond that,
terms meet the lexicon in a shuffled join, to the same result.

Defined cases: a null text is as an empty one; a document without a lexicon term has a hash
of its whole text as its fingerprint, like only to an equal one; texts of any length are used
whole; repeated rows have equal fingerprints; other columns are kept and outputs replace
columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.llm.common import Memo, durable, fresh

#: The band: terms of at least 1 and at most 50 documents in a thousand (and two at least).
LEAST_SHARE, MOST_SHARE = 0.001, 0.05
SUBSETS, HEX_DIGITS = 32, 4
BROADCAST_TERMS = 2_000_000
_PARTIAL_TERMS = 250_000
#: Keys of near copies: documents alike in 0.85 of their terms share one of eight with a chance of 0.98, in 0.3 with 0.006.
BANDS, ROWS = 8, 6

_MIX = np.uint64(0xD6E8FEB86659FD93)
#: One draw of 64 bits serves four subsets, 16 bits each.
_SEEDS = np.arange(1, SUBSETS // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ONE = 1 << 32  # a document's weight
_STRIP = b".,;:!?\"'()[]|"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def terms(text: str | None) -> set[bytes]:
    """Distinct terms: ASCII letters in lower case, outer punctuation off."""
    found = {w.strip(_STRIP) for w in set((text or "").encode().lower().split())}
    found.discard(b"")
    return found


def _as_long(term: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def copy_keys(found: set[bytes]) -> list[int]:
    """Eight keys of a document's terms; near copies share some, documents without a term have none."""
    if not found:
        return []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096, None] * _FACTORS).min(axis=0))
    keys = _mixed(_mixed(least ^ _FACTORS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))
    return keys.view(np.int64).tolist()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of terms and of keys: each task adds up before anything is shuffled."""
    counts: dict[bytes, int] = {}
    keys: dict[int, int] = {}

    def rows() -> pa.RecordBatch:
        names = [_as_long(t) for t in counts] + list(keys)
        is_key = [False] * len(counts) + [True] * len(keys)
        out = pa.RecordBatch.from_arrays([pa.array(is_key, pa.bool_()), pa.array(names, pa.int64()), pa.array([*counts.values(), *keys.values()], pa.int64())], names=["is_key", "term", "df"])
        counts.clear()
        keys.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            found = terms(text.as_py())
            for t in found:
                counts[t] = counts.get(t, 0) + 1
            for k in copy_keys(found):
                keys[k] = keys.get(k, 0) + 1
            if len(counts) + len(keys) > _PARTIAL_TERMS:
                yield rows()
    yield rows()


def _copies_weight(texts: DataFrame, groups: dict[int, int], above: list[int]) -> dict[int | None, int]:
    """What copies add to the frequency of each term of ``above``, and under None to the number of documents, in 2**-32."""
    known = texts.sparkSession.sparkContext.broadcast((groups, frozenset(above)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, wanted = known.value
        more: dict[int | None, int] = {}
        for batch in batches:
            for text in batch.column(0):
                found = terms(text.as_py())
                size = max((sizes.get(k, 1) for k in copy_keys(found)), default=1)
                if size > 1:
                    for t in [None, *wanted.intersection(map(_as_long, found))]:
                        more[t] = more.get(t, 0) + _ONE - _ONE // size
        yield pa.RecordBatch.from_arrays([pa.array(list(more), pa.int64()), pa.array(list(more.values()), pa.int64())], names=["term", "more"])

    added = texts.mapInArrow(run, "term long, more long").groupBy("term").agg(F.sum("more").alias("more"))
    return {r["term"]: r["more"] for r in added.collect()}  # terms above the band


def lexicon(documents: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """(term): hashes of the terms in the band, counted over all documents, and of those that only copies put above it."""
    n = documents.count()
    low, high = max(2, math.ceil(n * least_share)), max(2, math.floor(n * most_share))
    texts = documents.select(F.col("text").cast("string"))
    counted = texts.mapInArrow(_term_counts, "is_key boolean, term long, df long")
    frequent = durable(counted.groupBy("is_key", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= low))
    lex = frequent.where(~F.col("is_key") & (F.col("df") <= high)).select("term")
    # Both are bounded by the shares, however many documents there are.
    above = {r["term"]: r["df"] for r in frequent.where(~F.col("is_key") & (F.col("df") > high)).collect()}
    groups = {r["term"]: r["df"] for r in frequent.where("is_key").collect()} if above else {}
    if not groups:
        return lex
    more = _copies_weight(texts, groups, list(above))
    most = max(2 * _ONE, int((n * _ONE - more.get(None, 0)) * most_share))
    back = [(t,) for t, df in above.items() if df * _ONE - more.get(t, 0) <= most]
    return lex.unionByName(documents.sparkSession.createDataFrame(back, "term long")) if back else lex


def fingerprint(hashes: np.ndarray, text: str | None) -> str:
    """Of sorted distinct lexicon terms; of the text where there are none."""
    if not len(hashes):
        return "text:" + xxhash.xxh3_128_hexdigest((text or "").encode())
    h = hashes.view(np.uint64)
    level = min(14, max(1, math.ceil(math.log2(len(h) + 1))))
    drawn = _mixed(h[:, None] ^ _SEEDS).view(np.uint16)
    value = _mixed(h)
    parts = []
    for rate in (level, level + 1):
        term, subset = np.nonzero(drawn < 1 << (16 - rate))
        sums, some = np.zeros(SUBSETS, np.uint64), np.zeros(SUBSETS, bool)
        np.add.at(sums, subset, value[term])
        some[subset] = True
        short = np.maximum(_mixed(sums) >> np.uint64(64 - 4 * HEX_DIGITS), np.uint64(1))
        parts.append(f"{rate}:" + np.where(some, short, np.uint64(0)).astype(">u8").view(np.uint8).reshape(SUBSETS, 8)[:, 8 - HEX_DIGITS // 2 :].tobytes().hex())
    return ",".join(parts)


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if a.startswith("text:") or b.startswith("text:"):
        return 0.0
    left, right = (dict(p.split(":") for p in x.split(",")) for x in (a, b))
    equal = either = 0
    none = "0" * HEX_DIGITS
    for rate in left.keys() & right.keys():
        x, y = left[rate], right[rate]
        for at in range(0, len(x), HEX_DIGITS):
            s, t = x[at : at + HEX_DIGITS], y[at : at + HEX_DIGITS]
            if s != none or t != none:
                either += 1
                equal += s == t
    return equal / either if either else 0.0


def with_fingerprints(df: DataFrame, lex: DataFrame, columns: dict[str, str], likenesses: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with a fingerprint column for each text column: ``columns`` maps text to output.

    ``likenesses`` maps further outputs to two fingerprint columns each, of the outputs or of
    ``df``; they are compared in the same pass.
    """
    outputs, likenesses = list(columns.values()), likenesses or {}
    if lex.count() > BROADCAST_TERMS:
        out = _joined_fingerprints(df, lex, columns)
        return out.withColumns({o: like(*pair) for o, pair in likenesses.items()})
    known = df.sparkSession.sparkContext.broadcast(np.array([r[0] for r in lex.toLocalIterator()], np.int64))
    present = sorted({c for pair in likenesses.values() for c in pair} - set(outputs))
    fields = [f"f{i} string" for i in range(len(outputs))] + [f"l{i} double" for i in range(len(likenesses))]

    @F.pandas_udf(", ".join(fields))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        inside = set(known.value.tolist())
        own = Memo(lambda t: h if (h := _as_long(t)) in inside else None, 300_000)

        def one(text: str | None) -> str:
            found = [h for h in map(own.__getitem__, terms(text)) if h is not None]
            return fingerprint(np.unique(np.array(found, np.int64)), text)

        for given in batches:
            given = (given,) if isinstance(given, pd.Series) else given  # one column comes by itself
            made = {o: [one(t) for t in column] for o, column in zip(outputs, given)}
            all_columns = made | dict(zip(present, given[len(outputs) :]))
            result = {f"f{i}": made[o] for i, o in enumerate(outputs)}
            for i, (a, b) in enumerate(likenesses.values()):
                result[f"l{i}"] = [likeness(x, y) for x, y in zip(all_columns[a], all_columns[b])]
            yield pd.DataFrame(result)

    f = fresh(df, "_f")
    both = df.withColumn(f, run(*[F.col(c).cast("string") for c in columns], *[F.col(c) for c in present]))
    named = {o: F.col(f"{f}.f{i}") for i, o in enumerate(outputs)} | {o: F.col(f"{f}.l{i}") for i, o in enumerate(likenesses)}
    return both.withColumns(named).drop(f)


def _joined_fingerprints(df: DataFrame, lex: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The way for lexicons too large to broadcast: terms are shuffled to it."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([[_as_long(t) for t in terms(x)] for x in texts], dtype=object)

    @F.pandas_udf(T.StringType())
    def finish(found: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(np.unique(np.array([] if f is None else f, np.int64)), t) for f, t in zip(found, texts)], dtype=object)

    row, terms_of = fresh(df, "_row"), fresh(df, "_found")
    out = durable(df.withColumn(row, F.monotonically_increasing_id()))
    for text, name in columns.items():
        kept = out.select(row, F.explode(hashed(F.col(text).cast("string"))).alias("term")).join(lex, "term")
        found = kept.groupBy(row).agg(F.collect_list("term").alias(terms_of))  # one document's terms
        out = out.join(found, row, "left").withColumn(name, finish(terms_of, F.col(text).cast("string"))).drop(terms_of)
    return out.drop(row)


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype=float)


def like(a: str, b: str) -> Column:
    """The likeness of two fingerprint columns."""
    return _likeness(F.col(a), F.col(b))


def with_next_text(documents: DataFrame, out_col: str = "next_text", carried: str | None = None) -> DataFrame:
    """(doc_id, text) with the text of the next document by ascending doc_id, after the last the first.

    A ``carried`` string column comes along, and the next document's as next_ and its name.
    Documents go to ranges of their identifiers, cut at quantiles, once; the first of each
    range is also sent to the range before.  Only range bounds come to the driver.  Rows
    without an identifier come last; rows that share one follow each other by their texts.
    """
    spark = documents.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([carried] if carried else []))
    more = [carried] if carried else []
    cuts = sorted(set(rows.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []))
    cut_at = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    span = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(cut_at, lambda c: c <= F.col("doc_id"))))
    ranged = rows.withColumn("span", span)
    firsts = {r["span"]: r["first"] for r in ranged.groupBy("span").agg(F.min("doc_id").alias("first")).collect()}  # a row per range
    order = sorted(firsts)
    before = {firsts[s]: order[i - 1] for i, s in enumerate(order)}
    extra = F.create_map(*[F.lit(x) for k, s in before.items() if k is not None for x in (int(k), s)]) if set(before) - {None} else F.create_map().cast("map<bigint,int>")
    back = F.when(F.col("doc_id").isNull(), F.lit(before.get(None))).otherwise(F.element_at(extra, F.col("doc_id")))
    places = F.array_compact(F.array(F.struct(F.col("span").alias("span"), F.lit(False).alias("tail")), F.when(back.isNotNull(), F.struct(back.cast("int").alias("span"), F.lit(True).alias("tail")))))
    sent = ranged.select("doc_id", "text", *more, F.explode(places).alias("p")).select("p.span", "p.tail", "doc_id", "text", *more)
    by = Window.partitionBy("span").orderBy("tail", F.col("doc_id").asc_nulls_last(), "text")
    follows = {out_col: F.lead("text").over(by)} | {f"next_{c}": F.lead(c).over(by) for c in more}
    paired = sent.repartition(ranges, "span").withColumns(follows).where(~F.col("tail") & F.col(out_col).isNotNull())
    return paired.select("doc_id", "text", out_col, *(x for c in more for x in (c, f"next_{c}")))
