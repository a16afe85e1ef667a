"""Near duplicates, substring dedup and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from lattica.llm import imatch, minhash, substring_dedup

SCHEMA = "doc_id long, text string, node string, label string, run long"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() > share else "x" + w for w in base]


def corpus(seed=1):
    """Exact copies, near copies at many similarities, a passage that many share, short and empty texts."""
    rng = random.Random(seed)
    texts = [None, "", "   ", "one", "ONE", "one two three four", "one two three four five", "One two  three four\nfive"]
    for size in (8, 12, 40, 70, 200, 400):
        base = words(rng, size)
        texts += [" ".join(edited(rng, base, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.1)]
    passage = words(rng, 60)
    texts += [" ".join(words(rng, 20) + passage + words(rng, 100)) for _ in range(60)]
    hub = words(rng, 150)
    texts += [" ".join(edited(rng, hub, 0.012)) for _ in range(60)]
    rng.shuffle(texts)
    return texts


def word_sequences(text):
    """Five-word shingles by the contract's own pattern, without the operator's code."""
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(found) < 5:
        return frozenset([tuple(found)] if found else [])
    return frozenset(zip(*(found[k:] for k in range(5))))


def brute_components(rows):
    sets = [word_sequences(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_near_duplicates_equal_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == sorted(brute_components(rows))


def chain(rng):
    """Copies of copies: neighbours are linked, the ends have little in common."""
    base = words(rng, 120)
    for _ in range(40):
        base = edited(rng, base, 0.01)
        yield base


def cloud(rng):
    """Copies of one text around the similarity, of several lengths, some of which share edits."""
    base = words(rng, 100)
    shared = edited(rng, base, 0.03)
    for k in range(90):
        copy = edited(rng, shared if k % 3 else base, 0.02 + 0.02 * (k % 2))
        yield copy[k % 7 :] if k % 5 else copy + words(rng, k % 4)


@pytest.mark.parametrize("make, paired", [(chain, 12), (cloud, 2)])
def test_long_lists_are_divided_and_lose_no_link(spark, monkeypatch, make, paired):
    """Groups whose hubs are unlike many of their members."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "JOINED_LEVELS", 1)
    monkeypatch.setattr(minhash, "SPREAD", 7)
    rows = list(enumerate(" ".join(t) for t in make(random.Random(4))))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(rows))


def test_parts_of_a_list_keep_every_link():
    """Any two linked sets, one of which isn't linked to the hub, get a common part."""
    rng = random.Random(7)
    several = 0
    for _ in range(400):
        hub = set(rng.sample(range(2_000), rng.randint(8, 60)))
        near = [(hub - set(rng.sample(sorted(hub), rng.randint(0, len(hub) // 3)))) | set(rng.sample(range(2_000, 2_012), rng.randint(0, 10))) for _ in range(12)]
        least = min(map(len, near))
        asset = lambda x: np.array(sorted(x), np.int64)
        told = [minhash._apart(asset(hub), asset(x), least) for x in near]
        for i, a in enumerate(near):
            for j in range(i):
                b, both = near[j], len(a & near[j])
                if 100 * both >= 75 * (len(a) + len(b) - both) and (told[i][0] or told[j][0]):
                    several += 1
                    assert set(told[i][1]) & set(told[j][1]) or set(told[i][2]) & set(told[j][2])
    assert several > 50


def test_near_duplicates_without_ids_and_with_repeated_ones(spark):
    text = " ".join(words(random.Random(2), 30))
    other = " ".join(words(random.Random(3), 30))
    rows = [(None, text), (5, text), (5, other), (7, other), (None, None), (None, "alone it is")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (None, 26, 5, False) in got and (5, 26, 5, True) in got and (7, 26, 5, False) in got
    assert (None, 0, None, True) in got and (None, 1, None, True) in got


def test_shingle_hashes_tell_words_apart():
    assert len(minhash.shingles("a b c d e f")) == 2
    assert set(minhash.shingles("A B C D E")) == set(minhash.shingles("a\tb\x0bc d\ne"))
    assert set(minhash.shingles("É b c d e")) != set(minhash.shingles("é b c d e"))


def brute_dedup(rows):
    first = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda x: x[0]):
        for h in substring_dedup.runs(t or "")[0].tolist():
            first.setdefault(h, d)
    out = []
    for d, t in rows:
        found = set() if d is None or not t else {h for h in substring_dedup.runs(t)[0].tolist() if first[h] < d}
        out.append((d, t and substring_dedup.remove_covered(t, found)))
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join(words(rng, n)).capitalize() + ". "
    passage = "".join(sentence(12) for _ in range(6))
    rows = [(0, passage + sentence(9)), (1, "Pasted amid a sentence " + passage + sentence(20)), (2, passage), (3, None), (4, ""), (5, sentence(50)), (None, passage), (7, passage + passage)]
    rows += [(i, "".join(sentence(rng.randint(1, 30)) for _ in range(8))) for i in range(8, 30)]
    clean = {d: t for d, t in rows if d is not None and d > 7}
    df = spark.createDataFrame([(d, t, "a", "b", 3) for d, t in rows], SCHEMA).repartition(4)
    got = substring_dedup.dedup(df)
    assert got.columns == df.columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(brute_dedup(rows), key=key)
    out = dict(got)
    assert out[0] == rows[0][1] and out[2] == "" and out[3] is None and out[4] == ""
    assert all(out[d] == t for d, t in clean.items())
    core = passage.split(". ", 1)[1].strip()
    assert core not in out[1] and core not in out[7]


def test_sentences_join_to_the_text():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab .,\n!?;| ") for _ in range(rng.randint(0, 200)))
        assert "".join(substring_dedup.sentences(text)) == text


def test_fingerprints(spark):
    rng = random.Random(8)
    common = words(rng, 300)
    texts = [" ".join(rng.sample(common, 60)) for _ in range(120)] + ["", None, "zzz unseen", "zzz unseen"]
    df = spark.createDataFrame([(i, t, "n", "l", 1) for i, t in enumerate(texts)], SCHEMA)
    lex = imatch.lexicon(df, least_share=0.01, most_share=0.5)
    out = imatch.with_fingerprints(df, lex, {"text": "f"})
    by = {r.doc_id: r.f for r in out.collect()}
    assert by[120] == by[121] and by[122] == by[123] and by[0] != by[1]
    kept = {r.term for r in lex.collect()}
    counts = {}
    for t in texts:
        for w in imatch.terms(t):
            counts[w] = counts.get(w, 0) + 1
    assert kept == {imatch._as_long(w) for w, c in counts.items() if 2 <= c <= 62}
    joined = {r.doc_id: r.f for r in imatch._joined_fingerprints(df, lex, {"text": "f"}).collect()}
    assert joined == by
    half = " ".join(texts[0].split()[:30] + texts[1].split()[:30])
    mark = lambda t: imatch.fingerprint(np.unique(np.array([h for h in map(imatch._as_long, imatch.terms(t)) if h in kept], np.int64)), t)
    assert mark(texts[0]) == by[0] and imatch.likeness(by[0], by[0]) == 1.0
    assert imatch.likeness(by[0], mark(half)) > imatch.likeness(by[0], by[2])
    assert imatch.likeness(by[122], by[0]) == 0.0


def test_a_large_group_of_near_copies_keeps_its_terms(spark):
    rng = random.Random(12)
    stop, vocabulary = words(rng, 20), [f"w{i}" for i in range(3000)]
    base = [f"g{i}" for i in range(120)]
    texts = [" ".join(stop + rng.sample(vocabulary, 100)) for _ in range(400)]
    texts += [" ".join(stop + [w if rng.random() > 0.04 else rng.choice(vocabulary) for w in base]) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "n", "l", 1) for i, t in enumerate(texts)], SCHEMA)
    lex = imatch.lexicon(df)
    kept = {r.term for r in lex.collect()}
    assert {imatch._as_long(w.encode()) for w in base} <= kept
    assert not {imatch._as_long(w.lower().encode()) for w in stop} & kept
    by = {r.doc_id: r.f for r in imatch.with_fingerprints(df, lex, {"text": "f"}).collect()}
    pairs = [rng.sample(range(400, 600), 2) for _ in range(200)]
    assert np.mean([imatch.likeness(by[a], by[b]) for a, b in pairs]) > 0.6
    assert np.mean([imatch.likeness(by[a - 400], by[b]) for a, b in pairs]) < 0.2


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_next_text_wraps_around(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i * 7 % 50 - 10, f"t{i}") for i in range(50)]
        got = {(r.doc_id, r.text): r.next_text for r in imatch.with_next_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        order = sorted(rows)
        assert got == {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
        few = imatch.with_next_text(spark.createDataFrame([(1, "only")], "doc_id long, text string")).collect()
        assert [tuple(r) for r in few] == [(1, "only", "only")]
        odd = [(None, "n"), (2, None), (2, "b"), (1, "a")]
        got = [tuple(r) for r in imatch.with_next_text(spark.createDataFrame(odd, "doc_id long, text string")).collect()]
        assert sorted(map(str, got)) == sorted(map(str, [(1, "a", ""), (2, "", "b"), (2, "b", "n"), (None, "n", "a")]))
        assert imatch.with_next_text(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_fingerprint_query(spark):
    from lattica.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op4_imatch"](spark, folder).collect()}
    assert len(rows) == len(texts)
    for i, (d, t) in enumerate(texts):
        k, following = len(t) // 2, texts[(i + 1) % len(texts)][1]
        assert rows[d].n_chars == len(t)
        assert rows[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()
        assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
    better = sum(r.near_edited > r.near_next for r in rows.values())
    assert better > 0.85 * len(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(df).count() == 0
    assert substring_dedup.dedup(df).count() == 0
    assert imatch.with_fingerprints(df, imatch.lexicon(df), {"text": "f"}).count() == 0


def test_only_texts_that_may_be_needed_pass_the_filter(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    wanted = rows.where("doc_id % 100 = 7").select("doc_id")
    passed = minhash._possible(rows, wanted, "doc_id")
    assert passed.columns == rows.columns
    assert passed.join(wanted, "doc_id").count() == 200
    assert passed.count() < 260


def test_only_nodes_of_lists_carry_sketches_on(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(words(rng, 30)) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (200, texts[0] + " more"), (201, texts[1] + " more")], "doc_id long, text string")
    met, seen = minhash._met, []
    monkeypatch.setattr(minhash, "_met", lambda lists, nodes, *rest: seen.append(nodes.count()) or met(lists, nodes, *rest))
    assert minhash.near_duplicates(docs).where("not kept").count() == 2
    assert seen == [4]
