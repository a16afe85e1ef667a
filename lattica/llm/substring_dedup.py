"""Substring dedup by sliding sentence spans.

Texts are cut into sentences and the clauses within them (a passage pasted into a sentence
shares only its inner cuts).  Every run of several consecutive ones, as many as have
enough words, is hashed; runs are joined over all documents, and whatever a run covers is removed from every
document but the first that holds it, the one with the smallest identifier.  Within a
document each repeat of a run after its first place goes too.

Each document sends a run at most once; counts and first holders are pre-aggregated before
they are shuffled, and the join back is one that Spark can split where a run is held by a
large part of all rows.  No pairs of documents are ever made.

Defined cases: null texts stay null and empty texts empty; texts of any length are used
whole, and a text with fewer sentences than a run has is one run; rows that share an
identifier count as one document; rows without an identifier lose only what repeats within
them and are nobody's first holder; the text of a document that loses nothing is unchanged to
the last character; other columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import durable, fresh

#: The least sentences (or clauses) of a run, and its least words.
SPAN, LEAST_WORDS = 2, 12

#: Sentences with more words are cut on, after about every eighth word, at words that their
#: own hash picks: the same words give the same cuts wherever they stand.
LONG, PART = 24, 8

_CUT = re.compile(r"[.!?,;:][^\w\s]*\s+|\n+\s*")
_WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[str]:
    """The text in pieces that end with their separators; joined they are the text."""
    out, at = [], 0
    for end in [*(m.end() for m in _CUT.finditer(text)), len(text)]:
        piece = text[at:end]
        if piece.count(" ") > LONG:
            since = at
            for m in _WORD.finditer(text, at, end):
                if zlib.crc32(m[0].strip().encode()) % PART == 0:
                    out.append(text[since : m.end()])
                    since = m.end()
            piece = text[since:end]
        if piece:
            out.append(piece)
        at = end
    return out


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def runs(text: str, span: int = SPAN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and last sentence of each run.

    A run is the shortest of ``span`` sentences or more with ``least_words`` words or more,
    from each first sentence on and up to each last one (so that both edges of a repeated
    passage are covered).  Its hash is a polynomial in the hashes of its sentences.
    """
    cut = [s.split() for s in sentences(text)]
    n = len(cut)
    width = min(span, n)
    words = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, cut), np.int64, n), out=words[1:])
    if not n or words[n] < least_words:
        none = np.zeros(0, np.int64)
        return none, none, none
    starts, ends = np.arange(n), np.arange(1, n + 1)
    to = np.maximum(np.searchsorted(words, words[:n] + least_words, side="left"), starts + width)
    since = np.minimum(np.searchsorted(words, words[1:] - least_words, side="right") - 1, ends - width)
    first, last = np.concatenate([starts[to <= n], since[since >= 0]]), np.concatenate([to[to <= n], ends[since >= 0]])
    pairs = np.unique(first * (n + 1) + last)
    first, last = pairs // (n + 1), pairs % (n + 1)
    own = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w)) for w in cut), np.uint64, n)
    power, inverse = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(own * power[:n], out=sums[1:])
    mixed = (sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(_BASE)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64), first, last - 1


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and distinct run: its hash and its first place."""
    for batch in batches:
        ids, hashes, counts = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if i is not None and text:
                h = np.unique(runs(text)[0])
                ids.append(i)
                hashes.append(h)
                counts.append(len(h))
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes)), pa.array(np.repeat(np.array(ids, object), counts), batch.schema.field(0).type)],
                names=["run", "id"],
            )


def remove_covered(text: str, found_elsewhere: set[int]) -> str:
    """``text`` without the sentences of runs found elsewhere first, or before in the text."""
    hashes, first, last = runs(text)
    repeat = np.ones(len(hashes), bool)
    repeat[np.unique(hashes, return_index=True)[1]] = False
    if found_elsewhere:
        repeat |= np.isin(hashes, np.fromiter(found_elsewhere, np.int64))
    if not repeat.any():
        return text
    cut = sentences(text)
    covered = np.zeros(len(cut) + 1, np.int64)
    np.add.at(covered, first[repeat], 1)
    np.add.at(covered, last[repeat] + 1, -1)
    return "".join(s for s, c in zip(cut, np.cumsum(covered)) if not c)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated spans removed from ``text_col``."""
    id_type = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = durable(base.mapInArrow(_run_rows, f"run long, id {id_type}"))
    shared = held.groupBy("run").agg(F.count(F.lit(1)).alias("holders"), F.min("id").alias("first")).where("holders > 1").select("run", "first")
    later = held.join(shared, "run").where("id > first").select("id", "run")
    own, found = fresh(df, "_id"), fresh(df, "_runs")
    marks = later.groupBy("id").agg(F.collect_set("run").alias(found)).select(F.col("id").alias(own), found)  # at most a document's own runs

    @F.pandas_udf("string")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([t and remove_covered(t, set() if f is None else set(f)) for t, f in zip(texts, found)], dtype=object)

    joined = df.join(marks, F.col(f"`{id_col}`") == F.col(own), "left")
    cleaned = joined.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string"), F.col(found)))
    return cleaned.select(*[F.col(f"`{c}`") for c in df.columns])
