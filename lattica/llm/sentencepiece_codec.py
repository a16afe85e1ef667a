"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The symbols of many words lie in flat numpy arrays.  In each round every word finds its
lowest pair rank (a segmented minimum), merges its leftmost pairs of that rank, all words at
once, and words without a pair left are taken out; the rounds end when none remains.

A word is a run of word-start marks and what follows up to the next mark.  No piece of the
vocabulary holds a mark after another character (checked when it is read), so no merge
crosses words and each distinct word of a batch is merged once.

Pairs that don't overlap merge in the same round only where that equals one merge at a time:
a word in which a new pair would rank as well as the round's or better merges its leftmost
pair alone.

Defined cases: a null text is as an empty one: begin and end identifiers only; characters
outside the vocabulary become byte pieces; any length is encoded whole; other columns are
kept and outputs replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fresh, in_portions, vocabulary, worker_kept

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # stands for a space
_NONE = np.iinfo(np.int64).max
#: Distinct words whose identifiers a worker keeps; about 130 MB.
CACHED_WORDS = 500_000


class PieceCodec:
    """Encodes and decodes under one SentencePiece BPE model with byte fallback.

    The model file is read with its library; splitting, merging and joining are done here.
    Models that normalise, or that lack byte fallback, are refused.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte_id = np.full(256, -1, np.int64)
        usual: dict[str, int] = {}
        self.written: list[bytes] = []  # the bytes that each identifier stands for
        self.is_byte = np.zeros(n, bool)
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value], self.is_byte[i] = i, True
                self.written.append(bytes([value]))
            elif model.is_control(i):
                self.written.append(b"")
            elif model.is_unknown(i):
                self.written.append(" ⁇ ".encode())
            else:
                usual[piece] = i
                self.written.append(piece.replace(MARK, " ").encode())
        if (self.byte_id < 0).any() or any(MARK in p.lstrip(MARK) for p in usual):
            raise ValueError("byte fallback and words that begin with marks are needed")
        if model.encode("  ﬁ  a ") != model.encode("  ﬁ  a") + [usual[MARK]]:
            raise ValueError("the model normalises its input")
        # Symbols: pieces by their identifier, then other characters that occur in pieces.
        symbol = dict(usual)
        next_symbol = n
        for piece in usual:
            for c in piece:
                if c not in symbol:
                    symbol[c] = next_symbol
                    next_symbol += 1
        self.n, self.width = n, next_symbol + 1
        self.outside = next_symbol  # any character that no piece holds: it never merges
        self.char_symbol = np.full(0x110000, self.outside, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        # Every way to cut a piece in two symbols; the rank orders by score, best first.
        scores = {i: model.get_score(i) for i in usual.values()}
        level = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, i in usual.items():
            for k in range(1, len(piece)):
                left, right = symbol.get(piece[:k]), symbol.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (level[scores[i]], i)
        keys = sorted(pairs)
        self.keys = np.array([*keys, _NONE], np.int64)
        self.ranks = np.array([*(pairs[k][0] for k in keys), 0], np.int64)
        self.made = np.array([*(pairs[k][1] for k in keys), 0], np.int64)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.block, self.block_ids = self._block_of_marks()

    def _block_of_marks(self) -> tuple[int, bytes]:
        """Length and identifier of the piece that long runs of marks repeat; 0 where they don't.

        If all pairs of runs of marks rank alike, the leftmost merges first, so a run is finished
        block by block from its left and a block depends on nothing beyond the next one.
        """
        runs = {len(p): i for i, p in enumerate(self.pieces) if p and not p.strip(MARK)}
        longest = max(runs, default=0)
        sizes = np.array(sorted(runs), np.int64)
        ids = np.array([runs[n] for n in sorted(runs)], np.int64)
        rank = self._rank(np.repeat(ids, len(ids)), np.tile(ids, len(ids)))[0]
        alike = len(set(rank[rank < _NONE].tolist())) == 1
        if longest < 2 or not alike or len(sizes) < 2:
            return 0, b""
        whole = self.merge_words([MARK * (8 * longest)])[0]
        block = np.array([runs[longest]], "<u4").tobytes()
        return (longest, block) if whole == block * 8 else (0, b"")

    def _blocks_before(self, word: str) -> int:
        """How many whole blocks of marks a word starts with that needn't be merged; two more stay with the rest."""
        if not self.block or len(word) <= 4 * self.block:
            return 0
        return max(0, (len(word) - len(word.lstrip(MARK))) // self.block - 2)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; no pair: the largest rank."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Packed identifiers of each non-empty word, all words merged in common rounds."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols = self.char_symbol[codes].astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, symbols, code points
        code = codes.astype(np.int64)
        rank, made = self._ranks_of(symbols, word)
        while len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(word)])
            live = least < _NONE
            if not live.all():  # compaction
                keep = np.repeat(live, size)
                out = ~keep
                done.append((word[out], symbols[out], code[out]))
                word, symbols, code, rank, made = (x[keep] for x in (word, symbols, code, rank, made))
                least, size = least[live], size[live]
                if not len(word):
                    break
                first = np.r_[0, np.cumsum(size)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # Of hits side by side every second one merges, counted from the leftmost.
            start = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            take = hit[place % 2 == 0]
            new, gone, new_rank, new_made = self._merged(take, symbols, word, rank, made)
            at_least = np.full(len(words) + 1, _NONE)
            np.minimum.at(at_least, word[take], np.minimum(new_rank[take], np.where(take > 0, new_rank[take - 1], _NONE)))
            # What was made also meets its neighbours as they are now, before they merge themselves.
            for side, step in ((take + 2, 2), (take - 1, -1)):
                near = (side >= 0) & (side < len(word))
                near[near] = word[side[near]] == word[take[near]]
                i = take[near]
                left, right = (made[i], symbols[i + 2]) if step > 0 else (symbols[i - 1], made[i])
                np.minimum.at(at_least, word[i], self._rank(left, right)[0])
            early = at_least[word[take]] <= rank[take]  # a new pair comes before the other merges
            if early.any():
                leftmost = np.r_[True, word[take[1:]] != word[take[:-1]]]
                take = take[~early | leftmost]
                new, gone, new_rank, new_made = self._merged(take, symbols, word, rank, made)
            stay = ~gone
            symbols, word, code, rank, made = new[stay], word[stay], code[stay], new_rank[stay], new_made[stay]
        return self._collect(done, len(words))

    def _ranks_of(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(word), _NONE), np.zeros(len(word), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self._rank(symbols[inner], symbols[inner + 1])
        return rank, made

    def _merged(self, take, symbols, word, rank, made):
        """What the arrays become where the pairs at ``take`` merge, before their right halves go."""
        new, gone = symbols.copy(), np.zeros(len(word), bool)
        new[take], gone[take + 1] = made[take], True
        new_rank, new_made = rank.copy(), made.copy()
        after = take + 2  # pairs of what was made with what follows it, then with what precedes it
        follows = after < len(word)
        follows[follows] = word[after[follows]] == word[take[follows]]
        new_rank[take] = _NONE
        i = take[follows]
        new_rank[i], new_made[i] = self._rank(new[i], new[i + 2])
        before = take - 1
        precedes = before >= 0
        precedes[precedes] = word[before[precedes]] == word[take[precedes]]
        i = take[precedes]
        h = i - 1
        behind = gone[h]  # the right half of another merge: its left half is the neighbour
        h = np.where(behind, h - 1, h)
        r, m = self._rank(new[h], new[i])
        new_rank[h], new_made[h] = r, m
        new_rank[i - 1] = np.where(behind, r, new_rank[i - 1])
        return new, gone, new_rank, new_made

    def _collect(self, done, n_words: int) -> list[bytes]:
        """Finished symbols in order of words, characters without a piece as byte pieces."""
        word = np.concatenate([d[0] for d in done])
        order = np.argsort(word, kind="stable")
        word = word[order]
        symbols = np.concatenate([d[1] for d in done])[order]
        code = np.concatenate([d[2] for d in done])[order]
        unknown = np.flatnonzero(symbols >= self.n)
        if len(unknown):
            spelt = [chr(c).encode("utf-8", "surrogatepass") for c in code[unknown].tolist()]
            times = np.ones(len(word), np.int64)
            times[unknown] = [len(b) for b in spelt]
            wide, word = np.repeat(symbols, times), np.repeat(word, times)
            at = np.repeat(np.isin(np.arange(len(symbols)), unknown), times)
            wide[at] = self.byte_id[np.frombuffer(b"".join(spelt), np.uint8)]
            symbols = wide
        packed = symbols.astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=n_words))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_packed(self, texts: Iterable[str | None], begin: bool = True, end: bool = True) -> Iterator[bytes]:
        """Identifiers of each whole text as little-endian unsigned 32-bit integers."""
        head = np.array([self.bos] * begin, "<u4").tobytes()
        tail = np.array([self.eos] * end, "<u4").tobytes()
        for portion in in_portions((t or "" for t in texts)):
            cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in portion]
            distinct = set().union(*cut)
            missing = [w for w in distinct if w not in self.known]
            if len(self.known) + len(missing) > CACHED_WORDS:
                self.known, missing = {}, list(distinct)
            if missing:
                before = [self._blocks_before(w) for w in missing]
                merged = self.merge_words([w[k * self.block :] for w, k in zip(missing, before)])
                self.known.update((w, self.block_ids * k + m) for w, k, m in zip(missing, before, merged))
            for words in cut:
                yield head + b"".join(map(self.known.__getitem__, words)) + tail

    def decode_packed(self, packed: bytes) -> str:
        """The text of packed identifiers: pieces joined, the first word's added space taken off.

        Bytes that are no UTF-8 become U+FFFD each.
        """
        ids = np.frombuffer(packed, "<u4")
        written = b"".join(map(self.written.__getitem__, ids.tolist()))
        shown = next((i for i in ids.tolist() if self.written[i]), None)
        if shown is not None and self.pieces[shown].startswith(MARK):
            written = written[1:]
        try:
            return written.decode("utf-8")
        except UnicodeDecodeError:
            return written.decode("utf-8", "surrogateescape").translate({0xDC00 + b: "�" for b in range(128, 256)})


def codec(path: str) -> PieceCodec:
    return worker_kept(PieceCodec, path)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = DEFAULT_VOCABULARY, begin: bool = True, end: bool = True) -> DataFrame:
    """``df`` with the identifiers of ``text_col``, packed as little-endian unsigned 32-bit integers (binary)."""
    path = vocabulary(model)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for texts in batches:
            yield pd.Series(list(c.encode_packed(texts, begin, end)), dtype=object)

    return df.withColumn(out_col, run(F.col(text_col).cast("string")))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the text of packed identifiers (null: the empty text)."""
    path = vocabulary(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for packed in batches:
            yield pd.Series([c.decode_packed(p or b"") for p in packed], dtype=object)

    return df.withColumn(out_col, run(F.col(ids_col)))


def round_trip(df: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", model: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with packed identifiers and the text that they decode to, in one pass of one worker."""
    path = vocabulary(model)

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in batches:
            packed = list(c.encode_packed(texts))
            yield pd.DataFrame({"ids": packed, "decoded": [c.decode_packed(p) for p in packed]})

    name = fresh(df, "_both")
    both = df.withColumn(name, run(F.col(text_col).cast("string")))
    return both.withColumns({ids_col: F.col(f"{name}.ids"), decoded_col: F.col(f"{name}.decoded")}).drop(name)


def unpack(ids_col: str) -> "F.Column":
    """Packed identifiers as array<int>, for readers that want them so."""

    @F.pandas_udf("array<int>")
    def run(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p or b"", "<u4").astype("int32") for p in packed])

    return run(F.col(ids_col))
