"""The registered queries against SQL, the libraries and brute force; long texts; names that clash."""

import random
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import imatch, packing, secrets, sentencepiece_codec, substring_dedup
from lattica.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def test_near_duplicates_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op1_minhash"](spark, FOLDER).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op1_minhash"]).fetchall())


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    texts = texts_of(spark)
    for r in QUERIES["op7_token_counts"](spark, FOLDER).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_pieces_hold_the_librarys_identifiers(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts, seen, by_doc = texts_of(spark), set(), {}
    for r in QUERIES["op9_packing"](spark, FOLDER).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.sequence_id not in seen
        seen.add(r.sequence_id)
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_batches_are_rectangles(spark):
    pieces = packing.pack(spark.createDataFrame([(i, "word " * i) for i in range(1, 60)], "doc_id long, text string").repartition(3))
    rows = packing.batched(pieces, tokens=8).collect()
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r)
    assert len(rows) == pieces.count()
    for held in batches.values():
        assert len({r.length for r in held}) == 1 and len(held) <= max(1, 8 // held[0].length) and sorted(r.row for r in held) == list(range(len(held)))


def test_nearest_neighbours_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    found = {}
    for r in QUERIES["op10_ann"](spark, folder).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = wanted = 0
    for q, got in found.items():
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort([ids, d])[:10]].tolist())
        hits, wanted = hits + len(best & set(got)), wanted + len(best)
        assert all(abs(d[ids == v][0] - s) < 1e-9 for v, s in got.items())
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * wanted


def test_long_runs_of_blanks_are_quick_and_exact():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.PieceCodec(path)
    rng = random.Random(3)
    cases = [" " * n for n in (*range(0, 130), 1000, 3001)]
    cases += [" " * rng.randint(40, 400) + rng.choice(["a", "the", "x y", ".", "\n"]) + " " * rng.randint(0, 300) for _ in range(200)]
    for text, packed in zip(cases, codec.encode_packed(cases)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True), len(text)
    began = time.perf_counter()
    blanks = " " * 200_000 + "end"
    packed = next(codec.encode_packed([blanks]))
    assert time.perf_counter() - began < 1 and codec.decode_packed(packed) == blanks


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(200_000))
    repeat = "This passage of the text is told here once and it is told again further on. Nothing else in it matters at all to anyone. "
    key = "AKIA" + "Z9Q8W7E6R5T4Y3U2"
    df = spark.createDataFrame([(1, f"{long}. {repeat}{key} {long[::-1]}."), (2, f"Begin. {repeat}End of it.")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in substring_dedup.dedup(df).collect()}
    assert repeat.strip() in kept[1] and "told again" not in kept[2]
    spans = {r.doc_id: r.spans for r in secrets.with_spans(df).collect()}
    assert f"access:{len(long) + 2 + len(repeat)}:" in spans[1] and spans[2] == ""
    assert packing.pack(df).where("doc_id = 1").agg(F.sum("length") == F.max("doc_tokens")).first()[0]


@pytest.mark.parametrize("names", [("_id", "_runs"), ("_both", "_f"), ("_row", "_found")])
def test_clashing_columns_stay(spark, names):
    df = spark.createDataFrame([(1, "some text of a few words", "p", "q"), (2, None, None, "r")], f"doc_id long, text string, {names[0]} string, {names[1]} string")
    told = lambda out: sorted((r["doc_id"], r[names[0]], r[names[1]]) for r in out.collect())
    expected = [(1, "p", "q"), (2, None, "r")]
    assert told(substring_dedup.dedup(df)) == expected
    assert told(sentencepiece_codec.round_trip(df)) == expected
    lex = spark.createDataFrame([(1,)], "term long")
    assert told(imatch.with_fingerprints(df, lex, {"text": "print"})) == expected
    assert told(imatch._joined_fingerprints(df, lex, {"text": "print"})) == expected


def brute_units(text):
    """Sentences and clauses, long ones cut at words that their hash picks; character by character."""
    import re

    out, since, at = [], 0, 0
    while at < len(text):
        m = re.compile(r"[.!?,;:][^\w\s]*\s+|\n+\s*").match(text, at)
        at = m.end() if m else at + 1
        if m or at == len(text):
            out.append(text[since:at])
            since = at
    units = []
    for piece in out:
        if piece.count(" ") <= 24:
            units.append(piece)
            continue
        unit = ""
        for word in re.findall(r"^\s+(?=\S)|\S+\s*", piece) if piece.strip() else [piece]:
            unit += word
            if word.strip() and zlib.crc32(word.strip().encode()) % 8 == 0:
                units.append(unit)
                unit = ""
        units += [unit] if unit else []
    return units


def brute_runs(units):
    """(first, last, words) of the runs of two units or more with twelve words or more that no shorter one from an edge replaces."""
    words = [u.split() for u in units]
    n, found = len(units), set()
    for i in range(n):
        for j in range(i + min(2, n) - 1, n):
            if sum(map(len, words[i : j + 1])) >= 12:
                found.add((i, j))
                break
    for j in range(n):
        for i in range(j - min(2, n) + 1, -1, -1):
            if sum(map(len, words[i : j + 1])) >= 12:
                found.add((i, j))
                break
    return [(i, j, tuple(map(tuple, words[i : j + 1]))) for i, j in sorted(found)]


def test_substring_query_equals_an_independent_brute_force(spark):
    texts = texts_of(spark)
    units = {d: brute_units(t) for d, t in texts.items()}
    runs = {d: brute_runs(u) for d, u in units.items()}
    first = {}
    for d in sorted(runs):
        for *_, words in runs[d]:
            first.setdefault(words, d)
    want = {}
    for d, found in runs.items():
        seen, covered = set(), set()
        for i, j, words in found:
            if first[words] < d or words in seen:
                covered |= set(range(i, j + 1))
            seen.add(words)
        want[d] = "".join(u for k, u in enumerate(units[d]) if k not in covered)
    got = {r.doc_id: r.text or "" for r in QUERIES["op5_substring_dedup"](spark, FOLDER).collect()}
    assert sum(want[d] != t for d, t in texts.items()) > 10 and got == want
