"""Cross-tokenizer alignment of texts by distinct segments.

A text, with a space before it, is cut before every run of white space that begins with a space.
:func:`splits_at_spaces` reads both vocabularies to verify that neither has an entry with a space
after something that isn't white space, so that no merge crosses a cut; where one has, the whole
text is one segment.  Each distinct segment of the corpus is encoded by both tokenizers and aligned
once; texts are put together from their segments again.

How it runs: texts go by in blocks of about ``BLOCK_CHARS`` characters.  A block keeps its distinct
segments (its dictionary) and each text as numbers into it.  Dictionaries alone are dealt by segment
and sorted, so that equal segments of all blocks meet, are encoded and aligned once, and go back to
their blocks in packed arrays.  A segment comes once a block, so no key is hot, however frequent the
word.  How many documents hold a pair of linked identifiers is counted block by block, then summed,
and the sums of a block's pairs join it again for the documents' columns.

Defined cases: texts that are null, empty, or whose tokens' bytes differ from the text (U+2581, which
one library can't tell from a space) have no tokens: zeros, and no part in any count.  Repeated rows
are documents of their own, and null identifiers stay null.  A text without spaces is one segment; a
text longer than a block is a block alone.  An empty table gives no rows.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Memo, discard, durable, forget, scratch_path, vocabulary, worker_kept
from lattica.llm.token_counts import byte_alphabet

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts in a block.
BLOCK_CHARS = 10_000_000

_AFTER_SOLID = re.compile(r"\S ")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: A space and what follows up to the next space that no white space precedes.
_SEGMENT = re.compile(r" (?:[^ ]|(?<=\s) )*")
_BLANKS = re.compile(r"\s ")

BLOCKS = "kind string, block long, docs array<long>, sizes binary, codes binary, local int, segment string"
#: Texts that are one row of a block.
ROW_TEXTS, ROW_CHARS = 512, 1_000_000
#: Segments of one block, packed (see :func:`_pack`): their numbers in it, their numbers of links, where links end tokens, and the tokens.
PACKED = "block long, local binary, n_links binary, ends binary, a binary, b binary"
#: Marks of a link that is the last of its token on either side.
ENDS_A, ENDS_B = 1, 2
#: Segments that are packed together.
PACK_ROWS, PACK_CHARS = 50_000, 2_000_000


class Pair:
    """Both tokenizers, the bytes of their entries, and whether texts may be cut at spaces."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=b)
        byte = byte_alphabet()
        n = self.a.get_vocab_size()
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in map(self.a.id_to_token, range(n))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.cuts = splits_at_spaces(a, self.bytes_a) and splits_at_spaces(b, self.bytes_b)


def splits_at_spaces(path: str, entries: list[bytes]) -> bool:
    """Can texts be cut before a space that follows something other than white space?

    No entry may hold such a place, and no step before the merges may look across it: a byte-level
    vocabulary must be the one that cuts texts into words itself and changes nothing in them.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
    return not any(_AFTER_SOLID.search(x.decode("utf-8", "replace")) for x in entries)


def segments(text: str, cuts: bool = True) -> list[str]:
    """The segments of ``text`` after a space; each begins with a space, and joined they are space and text.

    A last space alone stays with the segment before it: no library encodes an empty text as a space.
    """
    text = f" {text}"
    if not cuts:
        return [text]
    found = _SEGMENT.findall(text) if _BLANKS.search(text) else [f" {x}" for x in text[1:].split(" ")]
    if found[-1] == " " and len(found) > 1:
        found[-2:] = [found[-2] + " "]
    return found


def _pair(a: str, b: str) -> Pair:
    return worker_kept(Pair, a, b)


def _pack(values: np.ndarray) -> bytes:
    """Small numbers, byte by byte of their four: the lowest bytes, then the next."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _in_blocks(cuts: bool, block_chars: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        local: dict[str, int] = {}
        docs: list[int | None] = []
        codes: list[np.ndarray] = []
        size = row_size = 0

        def rows(kind: str, n: int, **known) -> pa.RecordBatch:
            columns = {"kind": [kind] * n, "block": [block] * n} | known
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in kinds.items()], list(kinds))

        def texts() -> pa.RecordBatch:
            made = rows("texts", 1, docs=[docs], sizes=[_pack(np.array(list(map(len, codes))))], codes=[_pack(np.concatenate(codes))])
            docs.clear(), codes.clear()
            return made

        def words() -> Iterator[pa.RecordBatch]:
            keys = list(local)
            for at in range(0, len(keys), 20_000):
                some = keys[at : at + 20_000]
                yield rows("words", len(some), local=range(at, at + len(some)), segment=some)
            local.clear()

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py() or ""
                if docs and (len(docs) >= ROW_TEXTS or row_size + len(text) > ROW_CHARS or size + len(text) > block_chars):
                    yield texts()
                    row_size = 0
                if size and size + len(text) > block_chars:
                    yield from words()
                    block, size = block + 1, 0
                found = segments(text, cuts) if text else []
                for s in found:
                    if s not in local:
                        local[s] = len(local)
                docs.append(doc)
                codes.append(np.fromiter(map(local.__getitem__, found), np.uint32, len(found)))
                size, row_size = size + len(text) + 1, row_size + len(text)
        if docs:
            yield texts()
        yield from words()

    kinds = {"kind": pa.string(), "block": pa.int64(), "docs": pa.list_(pa.int64()), "sizes": pa.binary(), "codes": pa.binary(), "local": pa.int32(), "segment": pa.string()}
    return deal


class Aligned:
    """Distinct segments, each aligned: tokens of both sides, and links in order.

    A link is an overlap of a token of each side, known by the tokens that it is the last link of; a
    group ends where both end.  Where the bytes of a side's tokens aren't the segment's, it has no
    token and no link.  ``begins`` say where each segment's begin.
    """

    def __init__(self, pair: Pair, found: list[str]):
        ids_a = [e.ids for e in pair.a.encode_batch(found, add_special_tokens=False)]
        ids_b = pair.b.encode([s[1:] for s in found], num_threads=1)
        whole = [s.encode() for s in found]
        for i, (s, a, b) in enumerate(zip(whole, ids_a, ids_b)):
            if b"".join([pair.bytes_a[x] for x in a]) != s or b"".join([pair.bytes_b[x] for x in b]) != s:
                ids_a[i] = ids_b[i] = []
                whole[i] = b""
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        # All segments lie on one line of bytes.  Between two neighbouring ends of tokens of either
        # side lies one overlap of one token of each.
        ends_a, ends_b = np.cumsum(pair.length_a[self.a]), np.cumsum(pair.length_b[self.b])
        at = np.union1d(ends_a, ends_b)
        self.ends = (ENDS_A * np.isin(at, ends_a, assume_unique=True) + ENDS_B * np.isin(at, ends_b, assume_unique=True)).astype(np.uint8)
        line = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
        self.n_links = np.bincount(np.searchsorted(line, at), minlength=len(found))
        counts = self.n_links, np.fromiter(map(len, ids_a), np.int64), np.fromiter(map(len, ids_b), np.int64)
        self.begins, self.begins_a, self.begins_b = (np.r_[0, np.cumsum(n)] for n in counts)


def _gather(begins: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the runs ``which`` (run i from begins[i] to begins[i + 1]), one run after the other."""
    width = begins[which + 1] - begins[which]
    return np.repeat(begins[which] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum()) if len(which) else np.zeros(0, np.int64)


def _aligned(a: str, b: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_kept(Pair, a, b)
        rows: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            rows.clear()
            coded = table["segment"].combine_chunks().dictionary_encode()
            found, which = Aligned(pair, coded.dictionary.to_pylist()), coded.indices.to_numpy()
            block, local = table["block"].to_numpy(), table["local"].to_numpy()
            order = np.argsort(block, kind="stable")
            block, local, which = block[order], local[order], which[order]
            begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
            packed = []
            for i, j in zip(begins, [*begins[1:], len(block)]):
                some = which[i:j]
                ends = zstandard.compress(found.ends[_gather(found.begins, some)].tobytes(), 1)
                tokens = [_pack(ids[_gather(begins_of, some)]) for ids, begins_of in ((found.a, found.begins_a), (found.b, found.begins_b))]
                packed.append((int(block[i]), _pack(local[i:j]), _pack(found.n_links[some]), ends, *tokens))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packed), kinds)], names)

        size = chars = 0
        for batch in batches:
            if batch.num_rows:
                rows.append(batch)
                size, chars = size + batch.num_rows, chars + batch["segment"].nbytes
            if size >= PACK_ROWS or chars >= PACK_CHARS:
                yield out()
                size = chars = 0
        if rows:
            yield out()

    names = ["block", "local", "n_links", "ends", "a", "b"]
    kinds = [pa.int64()] + [pa.binary()] * 5
    return align


#: Identifiers as text, each made once.
_TEXTS = Memo(str)


class Block:
    """A block's texts as numbers of its segments, and the segments' alignments by number."""

    def __init__(self, texts: pa.Table, packs: pa.Table):
        forget()  # the tokenizers of the stage before
        whole = lambda table, c: np.concatenate([np.zeros(0, np.uint32), *map(_unpack, table[c].to_pylist())]).astype(np.int64)
        self.docs = pa.chunked_array(texts["docs"].chunks, pa.list_(pa.int64())).combine_chunks().flatten()
        self.codes, self.begins = whole(texts, "codes"), np.r_[0, np.cumsum(whole(texts, "sizes"))]
        n_links = whole(packs, "n_links")
        ends = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zstandard.decompress(x), np.uint8) for x in packs["ends"].to_pylist())])
        order = np.argsort(whole(packs, "local"))
        begins = np.r_[0, np.cumsum(n_links)]
        self.n_links = n_links[order]
        self.link_begins = np.r_[0, np.cumsum(self.n_links)]
        at = _gather(begins, order)
        sides = []
        for side, mark in (("a", ENDS_A), ("b", ENDS_B)):
            last = (ends & mark) > 0
            token = np.r_[0, np.cumsum(last)]  # tokens that have ended before each link
            sides.append((whole(packs, side)[token[at]] if len(at) else np.zeros(0, np.int64), last[at]))
        (self.a, self.ends_a), (self.b, self.ends_b) = sides

    def pairs(self) -> np.ndarray:
        """Each link's pair as one number."""
        return self.a << 32 | self.b

    def per_segment(self, per_link: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(per_link)][self.link_begins])

    def groups(self) -> list[str]:
        """The text of each segment's groups."""
        both = np.flatnonzero(self.ends_a & self.ends_b)
        tokens = [(list(map(_TEXTS.__getitem__, ids[last].tolist())), np.r_[0, np.cumsum(last)[both]].tolist()) for ids, last in ((self.a, self.ends_a), (self.b, self.ends_b))]
        (text_a, at_a), (text_b, at_b) = tokens
        found = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
        bounds = np.searchsorted(both, self.link_begins).tolist()
        return [found[i] if j - i == 1 else ";".join(found[i:j]) for i, j in zip(bounds, bounds[1:])]

    def fits(self) -> np.ndarray:
        """Has each text tokens, all of whose segments fit?"""
        bad = np.r_[0, np.cumsum(self.n_links[self.codes] == 0)]
        return (bad[self.begins[1:]] == bad[self.begins[:-1]]) & (self.begins[1:] > self.begins[:-1])

    def summed(self, per_segment: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(per_segment[self.codes])]
        return total[self.begins[1:]] - total[self.begins[:-1]]


def _count_pairs(key, texts: pa.Table, packs: pa.Table) -> pa.Table:
    """How many of the block's documents hold each pair linked."""
    block = Block(texts, packs)
    distinct, number = np.unique(block.pairs(), return_inverse=True)
    held = np.zeros(len(distinct), np.int64)
    for i in np.flatnonzero(block.fits()).tolist():
        own = np.unique(block.codes[block.begins[i] : block.begins[i + 1]])
        held[np.unique(number[_gather(block.link_begins, own)])] += 1
    used = np.flatnonzero(held)
    return pa.table({"block": pa.array([key[0].as_py()] * len(used), pa.int64()), "pair": pa.array(distinct[used], pa.int64()), "n": pa.array(held[used], pa.int64())})


def _composed(keep_groups: bool):
    def compose(key, texts: pa.Table, both: pa.Table) -> pa.Table:
        known = both.filter(both["pair"].is_valid()).select(["pair", "n", "best"]).sort_by("pair")
        block = Block(texts, both.filter(both["local"].is_valid()))
        pairs, n, best = (known[c].to_numpy() for c in ("pair", "n", "best"))
        own = block.pairs()
        at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
        counted = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)  # others are in texts that don't fit
        of = lambda x: np.where(counted, x[at], 0) if len(pairs) else np.zeros(len(own), np.int64)
        good, groups = block.fits(), block.groups()
        per_link = {"n_a": block.ends_a, "n_b": block.ends_b, "n_groups": block.ends_a & block.ends_b, "n_links": np.ones(len(own), np.int64), "n_best": of(best.astype(np.int64)), "count_sum": of(n)}
        columns = {c: pa.array(np.where(good, block.summed(block.per_segment(x)), 0), pa.int64()) for c, x in per_link.items()}
        begins = block.begins.tolist()
        joined = (";".join([groups[c] for c in block.codes[i:j].tolist()]) if fit else "" for i, j, fit in zip(begins, begins[1:], good.tolist()))
        if keep_groups:
            columns["groups"] = pa.array(list(joined), pa.string())
        else:
            columns["groups_sha256"] = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in joined], pa.string())
        return pa.table({"doc_id": block.docs} | columns)

    return compose


def _written(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def align(docs: DataFrame, a: str = BYTES, b: str = PIECES, keep_groups: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document of ``docs`` (doc_id, text) the alignment of its tokens under vocabularies ``a`` and ``b``.

    ``groups`` lists the identifiers between places where tokens of both end (``a1,a2|b1;a3|b2``), or
    ``groups_sha256`` is its digest (nothing without tokens); ``n_links`` counts overlapping tokens, ``count_sum`` sums over them how many
    documents hold their pair linked, and ``n_best`` counts those whose pair no other of the same
    ``a`` identifier exceeds.
    """
    path_a, path_b = vocabulary(a), vocabulary(b)
    cuts = Pair(path_a, path_b).cuts
    spark = docs.sparkSession
    last = "groups" if keep_groups else "groups_sha256"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {last} string"
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = scratch_path(spark, "blocks")
    asked.mapInArrow(_in_blocks(cuts, block_chars), BLOCKS).write.partitionBy("kind").parquet(dealt)
    part = lambda kind, schema: spark.read.schema(schema).parquet(f"{dealt}/kind={kind}")
    if not _written(spark, f"{dealt}/kind=texts"):
        return spark.createDataFrame([], schema)
    texts = part("texts", "block long, docs array<long>, sizes binary, codes binary").withColumnRenamed("block", "of").groupBy("of")
    if _written(spark, f"{dealt}/kind=words"):
        entries = part("words", "block long, local int, segment string")
        packs = durable(entries.repartition("segment").sortWithinPartitions("segment").mapInArrow(_aligned(path_a, path_b), PACKED))
        discard(spark, f"{dealt}/kind=words")
    else:
        packs = spark.createDataFrame([], PACKED)

    by_block = durable(texts.cogroup(packs.groupBy("block")).applyInArrow(_count_pairs, "block long, pair long, n long"))
    id_a = F.shiftright("pair", 32).alias("a")
    counts = by_block.groupBy("pair").agg(F.sum("n").alias("n"))
    best = counts.groupBy(id_a).agg(F.max("n").alias("most"))
    ranked = counts.select(id_a, "pair", "n").join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = by_block.select("block", "pair").join(ranked, "pair")
    both = packs.unionByName(known, allowMissingColumns=True)
    return texts.cogroup(both.groupBy("block")).applyInArrow(_composed(keep_groups), schema)
