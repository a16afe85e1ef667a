"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training bins each statistic by its quantiles and grows depth-limited trees on histograms of
gradients in numpy, on the driver, from a bounded sample of labelled rows.  A trained model
is a handful of flat arrays; scoring walks all trees of all rows of a batch at once, one
numpy step for each level.

Defined cases: a null or empty text is scored on its statistics (all zero); rows without a
label don't train; with labels of one kind, or none, every score is the (smoothed) share of
label 1; repeated rows are scored each; other columns are kept and outputs replace columns
of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import forget

#: What a score may depend on; all of the text alone.
STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "spaces", "line_ends", "non_ascii", "letters",
    "commas_stops", "pipes", "marks", "symbols", "distinct_words", "same_as_last", "first_word",
    "longest_word", "lines", "distinct_lines", "words_a_sentence", "symbol_words", "upper_words", "distinct_bytes", "entropy",
)

#: At most so many labelled rows train, those of the least hash.
TRAINING_ROWS = 20_000

_BYTE = np.arange(256)
_IS = np.stack(
    [
        (_BYTE >= 65) & (_BYTE <= 90),
        (_BYTE >= 48) & (_BYTE <= 57),
        _BYTE == 32,
        _BYTE == 10,
        _BYTE >= 128,
        ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90)) | (_BYTE >= 128),
        np.isin(_BYTE, list(b",.;:")),
        _BYTE == ord("|"),
        np.isin(_BYTE, list(b"!?")),
        np.isin(_BYTE, list(b"#$%&*@^~<>{}[]\\/=+_")),
    ]
).astype(float)
_SYMBOL_END = re.compile(rb"[^\w\s.,;:\x80-\xff][\x20\n]")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    if not text:
        return [0.0] * len(STATISTICS)
    b = text.encode()
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n = len(b)
    upper, digits, spaces, line_ends, high, letters, stops, pipes, marks, symbols = (_IS @ counts / n).tolist()
    words = b.split()
    w = max(len(words), 1)
    lines = [x for x in b.split(b"\n") if x]
    share = counts[counts > 0] / n
    distinct = set(words)
    return [
        float(len(text)), float(len(words)), n / w, upper, digits, spaces, line_ends, high, letters, stops, pipes, marks, symbols,
        len(distinct) / w, sum(map(eq, words, words[1:])) / w, words.count(words[0]) / w if words else 0.0,
        float(max(map(len, distinct), default=0)), float(len(lines)), len(set(lines)) / max(len(lines), 1),
        w / max(b.count(b". ") + b.count(b".\n") + 1, 1), len(_SYMBOL_END.findall(b)) / w, sum(map(bytes.isupper, words)) / w,
        float(len(share)), float(-(share * np.log2(share)).sum()),
    ]


def statistics_matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


@dataclass
class BoostedTrees:
    """All trees in flat arrays: node i tests ``feature[i] <= threshold[i]``; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        raw = np.full(len(x), self.base)
        for part in range(0, len(x), 2048):
            rows = x[part : part + 2048]
            at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            row = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                at = np.where(rows[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            raw[part : part + 2048] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least_rows: int = 10, ridge: float = 1.0) -> BoostedTrees:
    """Boosts logistic loss; splits are sought on histograms of ``bins`` quantile bins."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    roots = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        width = bins + 1
        offset = np.arange(x.shape[1]) * width
        raw = np.full(len(y), base)

        def histogram(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
            flat = (binned[rows] + offset).ravel()
            return np.bincount(flat, np.repeat(weight[rows], x.shape[1]), width * x.shape[1]).reshape(-1, width)

        def grow(rows: np.ndarray, level: int) -> int:
            g, h = gradient[rows].sum(), curvature[rows].sum()
            if level < depth and len(rows) >= 2 * least_rows:
                gl, hl = (np.cumsum(histogram(rows, v), axis=1) for v in (gradient, curvature))
                nl = np.cumsum(histogram(rows, ones), axis=1)
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                gain[(nl < least_rows) | (len(rows) - nl < least_rows)] = -1
                f, b = divmod(int(gain.argmax()), width)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    at = leaf(0.0)
                    goes = binned[rows, f] <= b
                    low, high = grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
                    nodes[at] = [f, cuts[f][b], low, high, 0.0]
                    return at
            value = -rate * g / (h + ridge)
            raw[rows] += value
            return leaf(value)

        ones = np.ones(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            gradient, curvature = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0))
    else:
        roots.append(leaf(0.0))
    table = np.array(nodes, float)
    return BoostedTrees(base, np.array(roots), table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], depth)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = TRAINING_ROWS, **settings) -> BoostedTrees:
    """Learns from labelled documents that aren't held out, ``most`` rows at most.

    The identifiers that train number ``most`` at most, so they are broadcast; the documents
    are read once and only the statistics of those rows come to the driver.
    """
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("double").alias("_label")).where("doc_id is not null and _label in (0, 1)")
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            yield pd.Series(list(statistics_matrix(texts)), dtype=object)

    # Of rows that share an identifier the smallest text counts: ``most`` rows at most, always the same.
    one = rows.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    pdf = one.select("doc_id", "_label", measure("text").alias("x")).toPandas()
    pdf = pdf.sort_values(["doc_id", "_label"], kind="stable")
    x = np.stack(pdf["x"].to_list()) if len(pdf) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort([*x.T, pdf["_label"].to_numpy(float), pdf["doc_id"].to_numpy()])
    return fit(x[order], pdf["_label"].to_numpy(float)[order], **settings)


def with_scores(df: DataFrame, model: BoostedTrees, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for each whole text; nothing is shuffled."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            yield pd.Series(model.probability(statistics_matrix(texts)), dtype=float)

    return df.withColumn(out_col, score(F.col(text_col).cast("string")))
