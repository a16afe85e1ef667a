"""Centroid clustering, chat formatting and tokenizer alignment against full scans, SQL and brute force."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattica.llm import alignment, chat, yinyang
from lattica.llm.queries import ORACLE_SQL, QUERIES
from lattica.llm.token_counts import byte_alphabet

FOLDER = "/root/testdata/sf0.001"


# Centroid clustering


def lloyd(rows, clusters, rounds, dimension, scale=64, seed=1):
    """(vec_id, cluster, distance) and centroids by full scans in Python integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in hashed[:clusters]]
    square = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    nearest = lambda v: min((square(v, w), n) for n, w in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                c[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), c


def clustered(spark, rows, **parameters):
    found, c = yinyang.cluster(spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3), **parameters)
    return sorted((tuple(r) for r in found.collect()), key=str), c.tolist()


def test_clusters_equal_full_scans(spark):
    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(m, 0.3, (60, 6)) for m in rng.normal(0, 2, (7, 6))])
    rows = [(int(i), v.tolist()) for i, v in enumerate(blobs)]
    ties = [(1000 + i, [float(x) for x in v]) for i, v in enumerate(rng.integers(0, 2, (80, 6)) / 4)]  # few distinct vectors
    odd = [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [None] + [1.0] * 5), (2004, [float("nan")] * 6), (2005, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (7, [0.1] * 6), (7, [0.1] * 6), (2006, [1e6] * 6), (2007, [-1e6] * 6)]
    for some, clusters in ((rows + ties + odd, 16), (ties, 16), (rows[:3], 16), (rows, 1), (ties + ties, 9)):
        for rounds in (0, 3):
            want = lloyd(some, clusters, rounds, 6)
            got = clustered(spark, some, clusters=clusters, rounds=rounds, dimension=6)
            assert got[0] == want[0] and got[1] == want[1]


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 3, (500, 8)) for m in rng.normal(0, 60, (16, 8))]).astype(np.int64)
    c = x[:: len(x) // 16][:16].copy()
    group = yinyang.grouped(c)
    cluster, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), group.max() + 1))
    drift, work = np.zeros(16), []
    for _ in range(4):
        cluster, upper, lower, n = yinyang.advance(x, c, group, drift, cluster, upper, lower)
        assert (cluster == yinyang.squares(x, c).argmin(axis=1)).all()
        work.append(n)
        means = np.array([x[cluster == i].mean(axis=0) if (cluster == i).any() else c[i] for i in range(16)]).astype(np.int64)
        drift, c = np.sqrt(((means - c) ** 2).sum(axis=1)), means
    assert work[0] >= len(x) * 16 and work[-1] < len(x) * 8


def test_clustering_query_equals_sql_and_an_empty_table_is_empty(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    ours = QUERIES["op11_yinyang"](spark, FOLDER)
    theirs = con.sql(ORACLE_SQL["op11_yinyang"])
    assert sorted(map(tuple, ours.select(*theirs.columns).collect())) == sorted(theirs.fetchall())
    nothing = spark.createDataFrame([(1, None)], "vec_id long, vector array<double>")
    assert yinyang.with_inertia(*yinyang.cluster(nothing)).collect() == []


# Chat formatting

HARD = st.lists(st.sampled_from(["\\", "#", "##", "### ", "</turn>", "<", "/turn>", ":\n", ":", "\n", "a", "é", "### user:\n", "𝒳"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_any_turns_read_back(turns):
    pieces = [chat.render(role, text) for role, text in turns]
    parsed = chat.parse("".join(p for p, _, _ in pieces))
    assert [t[:2] for t in parsed] == turns
    for (p, start, end), (_, text) in zip(pieces, turns):
        assert chat.ESCAPED.sub(r"\1", p[start:end]) == text


def test_only_conflicting_content_is_escaped():
    assert chat.render("user", "# a <b> </b> ## é")[0] == "### user:\n# a <b> </b> ## é</turn>\n"
    assert chat.render("user", "####")[0] == "### user:\n\\#\\###</turn>\n"
    assert chat.parse("### user:\n### user:\nx</turn>\n") is None and chat.parse("x") is None and chat.parse("") == []
    long = "word </turn> " * 200_000
    assert chat.parse(chat.render("assistant", long)[0])[0][1] == long


def test_conversations_of_many_turns_and_odd_values(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} </turn>") for i in range(50)]
    rows += [(2, None, None, None), (2, 0, "assistant", None), (None, 1, "tool: x\n", "a\\"), (3, 5, "user", "b"), (3, 5, "user", "b"), (3, 5, "assistant", "a"), (4, 0, "assistant", "x" * 500_000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, loss int").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.formatted(df.where("false"))).collect() == []


def test_long_conversations_take_several_rows(spark):
    rows = [(1, i, "assistant", "y" * 300_000) for i in range(9)]
    written = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    parts = sorted((r.portion, r.last, len(r.loss)) for r in written.collect())
    assert [p for p, _, _ in parts] == list(range(3)) and [x for _, x, _ in parts] == [False, False, True] and sum(n for _, _, n in parts) == 9
    (r,) = chat.read_back(written).collect()
    assert (r.n_turns, r.loss_chars) == (9, 2_700_000)


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    theirs = con.sql(ORACLE_SQL["op12_chat"])
    assert sorted(map(tuple, QUERIES["op12_chat"](spark, FOLDER).select(*theirs.columns).collect())) == sorted(theirs.fetchall())


# Tokenizer alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(docs, libraries):
    """The contract's columns from whole texts, token by token."""
    a, b = libraries
    byte = byte_alphabet()

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def piece(i):
        p = b.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    found, held = [], collections.Counter()
    for doc, text in docs:
        found.append([doc, None])
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_x, bytes_y = [bytes(byte[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
        if not b"".join(bytes_x) == b"".join(bytes_y) == (" " + text).encode():
            continue
        sx, sy = spans(bytes_x), spans(bytes_y)
        links = [(x[i], y[j]) for i, (s, e) in enumerate(sx) for j, (t, f) in enumerate(sy) if s < f and t < e]
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = [[[str(i) for i, (_, e) in zip(ids, sp) if last < e <= cut] for ids, sp in ((x, sx), (y, sy))] for last, cut in zip([0, *cuts], cuts)]
        found[-1][1] = len(x), len(y), len(cuts), links, ";".join(f"{','.join(g)}|{','.join(h)}" for g, h in groups)
        held.update(set(links))
    best = collections.Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for doc, r in found:
        if r is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_x, n_y, n_groups, links, groups = r
            out.append((doc, n_x, n_y, n_groups, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), groups))
    return sorted(out, key=str)


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a   b \n c", "a\n b\n\n  c", "x y\xa0z", "x\xa0 y \xa0 z", "tab\t x", "\x1c \x1d y", "▁", "a ▁b", "a b▁", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll  I'm", "日本語 テキスト　全角",
    "𝒳𝒴 é é", "#" * 300, "word " * 400, "nospaces" * 500, "a  b　 c", "​ zero", "1234567 89", "ÂłÂł ĠĠ", "\x00 \x07", "end\n", "\n", "\n x",
]


def test_alignments_equal_brute_force(spark, libraries):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "a  b"), (None, "the end of the word"), (None, "the end of the word")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, segment string, n_a int").repartition(3)
    want = brute_alignment(docs, libraries)
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum groups".split()
    for block in (alignment.BLOCK_CHARS, 30):
        assert sorted(map(tuple, alignment.align(df, block_chars=block).select(*columns).collect()), key=str) == want
    assert alignment.align(df.where("false")).collect() == []
    assert any(r[1] == 0 for r in want) and any(r[3] > 100 for r in want)


def test_segments_lose_no_character_and_keep_every_token(libraries):
    rng = np.random.default_rng(2)
    parts = [" ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "a", "Bc", "é", "12", ".", "'s", "日", "́", "\r\n", "…"]
    a, b = libraries
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        found = alignment.segments(text)
        assert "".join(found) == " " + text and all(s[0] == " " for s in found)
        assert sum((a.encode(s, add_special_tokens=False).ids for s in found), []) == a.encode(" " + text, add_special_tokens=False).ids
        assert sum((b.encode(s[1:]) for s in found), []) == b.encode(text)


def test_vocabularies_are_verified(tmp_path):
    path = public_tokenizers.path
    pair = alignment.Pair(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert pair.cuts
    assert not alignment.splits_at_spaces("x.model", [b" a", b"b c"])
    assert not alignment.splits_at_spaces(path("word_bpe_49k.json"), [b"a"])
    assert alignment.segments("a b", cuts=False) == [" a b"]


def test_alignment_query_equals_brute_force(spark, libraries):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in brute_short(rows, libraries)]
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, QUERIES["op13_alignment"](spark, FOLDER).select(*columns).collect()), key=str) == sorted(want, key=str)


def brute_short(rows, libraries):
    """:func:`brute_alignment`, with links of sorted spans found by bisection instead of all against all."""
    import bisect

    a, b = libraries
    byte = byte_alphabet()
    length_a = [len(t) if all(c in byte for c in t) else 0 for t in map(a.id_to_token, range(a.get_vocab_size()))]
    length_b = [1 if re.fullmatch("<0x..>", p) else len(p.replace("▁", " ").encode()) for p in map(b.id_to_piece, range(b.get_piece_size()))]
    found, held = [], collections.Counter()
    for doc, text in rows:
        if not text or "▁" in text:
            found.append((doc, None))
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ends_x, ends_y = (np.cumsum([length[i] for i in ids]).tolist() for length, ids in ((length_a, x), (length_b, y)))
        assert ends_x[-1] == ends_y[-1] == len(text.encode()) + 1
        links, at = [], 0
        for i, end in zip(x, ends_x):
            first, last = bisect.bisect_right(ends_y, at), bisect.bisect_left(ends_y, end)
            links += [(i, j) for j in y[first : last + 1]]
            at = end
        cuts = sorted(set(ends_x) & set(ends_y))
        groups, i, j = [], 0, 0
        for cut in cuts:
            m, n = bisect.bisect_right(ends_x, cut), bisect.bisect_right(ends_y, cut)
            groups.append(f"{','.join(map(str, x[i:m]))}|{','.join(map(str, y[j:n]))}")
            i, j = m, n
        found.append((doc, (len(x), len(y), len(cuts), links, ";".join(groups))))
        held.update(set(links))
    best = collections.Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for doc, r in found:
        if r is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
        else:
            n_x, n_y, n_groups, links, groups = r
            yield doc, n_x, n_y, n_groups, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), groups
