"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a doubly linked list; a heap holds the ranks of its
adjacent pairs.  The lowest-ranked pair (leftmost among equals) is merged again and again,
and the count is the number of first symbols less the number of merges: no identifier is
ever produced.

Defined cases: a null or empty text has 0 tokens; a special string such as
``<|endoftext|>`` inside a text counts as one token, as the vocabulary's own library does
by default; texts of any length are counted whole (a pre-token of n bytes costs n log n);
repeated rows are counted each; other columns are kept, and one that has the output's name
is replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Memo, vocabulary, worker_kept

DEFAULT_VOCABULARY = "byte_bpe_50k.json"

# How byte-level vocabularies split texts.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Stands for "this piece can't be counted alone"; more than any count.
_ALONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte, and the byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts tokens of whole texts under a byte-level vocabulary file (``.json``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbol = {c: b for c, b in byte_alphabet().items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merged = symbol.setdefault(left + right, len(symbol))
            self.rank.setdefault(symbol[left] << 20 | symbol[right], rank)
            self.made.append(merged)
        self.split = regex.compile(PRE_TOKENS)
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.token = Memo(self.merge_count, 200_000)  # pre-tokens that aren't words after a space
        self.spaced = Memo(self._count_spaced, 1_000_000)  # pieces after one space; under 200 MB

    def merge_count(self, token: str) -> int:
        """Tokens of one pre-token."""
        symbols = list(token.encode("utf-8", "surrogatepass"))
        n = len(symbols)
        if n < 2:
            return n
        rank, made, push, pop = self.rank.get, self.made, heapq.heappush, heapq.heappop
        # standing[i]: the rank of the pair that begins at i, -1 where there is none (any more)
        standing = [rank(left << 20 | right, -1) for left, right in zip(symbols, symbols[1:])]
        heap = [r << 32 | i for i, r in enumerate(standing) if r >= 0]
        heapq.heapify(heap)
        standing.append(-1)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        count = n
        while heap:
            entry = pop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if standing[i] != r:
                continue  # one of the two has been merged meanwhile
            count -= 1
            merged = symbols[i] = made[r]
            j = after[i]
            k = after[i] = after[j]
            standing[j] = -1
            if k < n:
                before[k] = i
                r = standing[i] = rank(merged << 20 | symbols[k], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                standing[i] = -1
            h = before[i]
            if h >= 0:
                r = standing[h] = rank(symbols[h] << 20 | merged, -1)
                if r >= 0:
                    push(heap, r << 32 | h)
        return count

    def _count_split(self, text: str) -> int:
        return sum(map(self.token.__getitem__, self.split.findall(text)))

    def _count_spaced(self, piece: str) -> int:
        if piece.isalpha():
            return self.merge_count(" " + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return _ALONE  # its white space belongs to a longer run
        return sum(self.spaced[t[1:]] if t[0] == " " and t[1:].isalpha() else self.token[t] for t in self.split.findall(" " + piece))

    def _count_plain(self, text: str) -> int:
        """No pre-token crosses from a non-space into a space, so pieces between single spaces count alone."""
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            total = self._count_split(head) + sum(map(self.spaced.__getitem__, rest))
            if total < _ALONE:
                return total
        elif not text:
            return 0
        return self._count_split(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._count_plain, parts))
        return self._count_plain(text)


def counter(path: str) -> TokenCounter:
    """One counter for each worker process and vocabulary; its caches serve all later tasks."""
    return worker_kept(TokenCounter, path)


def with_token_counts(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", vocab: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the token count of ``text_col``; a narrow operation without a shuffle."""
    path = vocabulary(vocab)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    return df.withColumn(out_col, count(F.col(text_col).cast("string")))


def count_report(documents: DataFrame, limit: int = 512, vocab: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    sized = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = with_token_counts(sized, "text", "n_tokens", vocab)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
