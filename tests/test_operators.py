"""Operators on small literals, with nulls, ties and planted truths."""


import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import labels as L
from lattica.operators import names as N
from lattica.operators import profile as P
from lattica.operators import rounds as R
from lattica.operators import text as X
from lattica.streaming import windows as S


def test_label_key_is_idempotent(spark):
    df = spark.createDataFrame([("MIDDLE  EAST",), ("a, b_c",), ("",), (None,)], "s string").select(L.label_key("s").alias("k"))
    assert [r.k for r in df.collect()] == ["MIDDLE_EAST", "a_b_c", "", None]
    assert [r.k for r in df.select(L.label_key("k").alias("k")).collect()] == ["MIDDLE_EAST", "a_b_c", "", None]


def test_group_ids(spark):
    df = spark.createDataFrame([("12",), ("K7",), ("C3",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(L.group_id("s")).collect()] == [12, 7, 3, None, None]


def test_bh_keeps_unscored_and_is_monotone(spark):
    p = [0.01, 0.04, 0.03, None, float("nan"), 0.9, 0.01]
    rows = L.bh(spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, id int, p double"), ["family"]).orderBy("id").collect()
    assert [None if r.q is None else round(r.q, 6) for r in rows] == [0.025, 0.05, 0.05, None, None, 0.9, 0.025]


def test_repeated_keys_align_by_occurrence(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("b", 30), ("b", 40)], "k string, y int")
    got = {(r.k, r.x, r.y) for r in L.align_repeats(left, right, "k", "x", "y").collect()}
    assert got == {("a", 1, 10), ("a", 2, 20), ("b", 3, 30), ("b", 3, 40)}


def test_pairs_of_a_repeated_key_are_made_by_many_tasks(spark):
    left = spark.range(40).selectExpr("CAST(id % 2 AS STRING) AS k", "id AS x")
    right = spark.range(6).selectExpr("CAST(id > 3 AS INT) AS k", "id AS y").selectExpr("CAST(k AS STRING) AS k", "y")
    rows = L.align_repeats(left, right, "k", "x", "y").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.k, r.x, r.y) for r in rows) == sorted((str(x % 2), x, y) for x in range(40) for y in range(6) if str(x % 2) == str(int(y > 3)))
    assert len({r.task for r in rows if r.k == "0"}) > 3


def test_closure_and_reduction(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)], "a int, b int")
    reduced = {tuple(r) for r in G.reduction(edges).collect()}
    assert reduced == {(1, 2), (2, 3), (3, 4)}
    again = {tuple(r) for r in G.reachability(spark.createDataFrame(list(reduced), "a int, b int")).collect()}
    assert again == {tuple(r) for r in G.reachability(edges).collect()}
    assert {r.node for r in G.cycles(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a int, b int")).collect()} == {1, 2}


def test_sums_merge_whatever_the_partitions(spark):
    counts = spark.createDataFrame([(i % 9, i % 5, float(i)) for i in range(90)], "obs int, feature int, value double")
    cells = spark.createDataFrame([(o, o % 3 if o else None, "b") for o in range(9)], "obs int, grp int, batch string")
    one, many = (sorted(map(tuple, P.group_sums(counts.repartition(n), cells).collect())) for n in (1, 8))
    assert one == many
    mapping = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "grp int, new_grp int")
    merged = P.regroup_sums(P.group_sums(counts, cells), mapping).agg(F.sum("value")).first()[0]
    assert merged == P.group_sums(counts, cells).agg(F.sum("value")).first()[0]


def test_rules_of_decisions(spark):
    rows = [
        (1, "label", [1], "A", "why", None), (2, "merge", [2], None, "why", None), (3, "label", [9], "A", "why", None), (4, "split", [2], "A", "why", None),
        (5, "keep", [1], None, "why", None), (6, "label", [3], "B", " ", None), (7, "markers_add", [], "A", "why", ["f"]), (8, "markers_add", [1], "A", "why", ["f"]),
    ]
    decisions = spark.createDataFrame(rows, "line long, action string, groups array<int>, label string, rationale string, features array<string>")
    groups = spark.createDataFrame([(i,) for i in (1, 2, 3)], "grp int")
    got = {(r.line, r.reason) for r in R.refusals(decisions, groups).collect()}
    assert {line for line, _ in got} == {2, 3, 4, 5, 6, 8}
    assert (5, "group decided twice") in got and (3, "no such group") in got


def test_last_edit_wins(spark):
    edits = spark.createDataFrame([(1, 1, "label", "A"), (2, 1, "label", "B"), (3, 1, "markers_add", "C"), (4, 2, "keep", None)], "seq int, grp int, action string, label string")
    got = [(r.action, r.label) for r in R.last_edit_wins(edits).orderBy("position").collect()]
    assert got == [("markers_add", "C"), ("label", "B"), ("keep", None)]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "event_type", "value")
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    S.tumbling(stream, late=None).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windows")) == key(S.tumbling(events))


def test_tokens_and_braces(spark):
    df = spark.createDataFrame([("It's 12 x U.S.A naïve-bit {a {b} c} end",), (None,)], "t string")
    got = df.select(X.tokens("t").alias("w"), X.strip_braces("t").alias("s")).collect()
    assert got[0].w == ["it's", "u.s.a", "naïve", "bit", "end"] and got[1].w is None
    assert got[0].s == "It's 12 x U.S.A naïve-bit end"


@pytest.mark.parametrize("block", [3, 100])
def test_blocks_give_the_same_neighbours(spark, block):
    rows = [(i, [float((i * 7) % 11), float((i * 5) % 13)]) for i in range(20)]
    df = spark.createDataFrame(rows, "obs long, vec array<double>")
    got = {(r.obs, r["rank"], r.other) for r in G.blocked_top_k(df, df, 3, "l2", block=block).collect()}
    expected = set()
    for i, x in rows:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, 12), j) for j, y in rows if j != i)[:3]
        expected |= {(i, k + 1, j) for k, (_, j) in enumerate(near)}
    assert got == expected


def test_csls_ranks_every_point(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 16))
    x[:80] = x[0] + 0.05 * rng.normal(size=(80, 16))  # a hub of more than 4 * hub_k near copies
    x[80:100] += 1.5 * x[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -np.inf)
    r = np.sort(cosine, axis=1)[:, -10:].mean(axis=1)
    expected = np.argsort(-(2 * cosine - r[:, None] - r), axis=1, kind="stable")[:, :5]
    within = np.argsort(-cosine, axis=1, kind="stable")[:, :40]
    assert any(set(e) - set(w) for e, w in zip(expected, within))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "obs long, vec array<double>")
    for block in ((), (64,)):
        got = {(a.obs, a["rank"]): a.other for a in G.csls_top_k(df, 5, 10, *block).collect()}
        assert got == {(i, n + 1): int(j) for i, row in enumerate(expected) for n, j in enumerate(row)}


def test_within_covariance_takes_every_dimension(spark):
    from lattica.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x, grp = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    for g in set(grp):
        x[grp == g] -= x[grp == g].mean(axis=0)
    expected = x.T @ x / (len(x) - len(set(grp)))
    got = {(r.i, r.j): r.cov for r in QUERIES["within_covariance"](spark, folder).collect()}
    assert len(got) == x.shape[1] * (x.shape[1] + 1) // 2
    assert all(abs(c - expected[i, j]) < 1e-5 for (i, j), c in got.items())


def test_the_least_of_a_tail_is_a_running_minimum(spark):
    """A frame that ends at the last row is read anew for each row: quadratic in a family."""
    tests = spark.range(50).selectExpr("'f' AS family", "id", "id / 50 AS p")
    plan = L.bh(tests, ["family"])._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert [r.q for r in L.bh(tests, ["family"]).orderBy("id").collect()] == pytest.approx([min(j / (j + 1) for j in range(i, 50)) for i in range(50)])


def test_timestamps_beyond_the_year_9999_and_twelve_digits(spark):
    rows = spark.createDataFrame([(0,), (-1,), (600_000 * 1_000_003,), (1_500_000 * 1_000_003,)], "s long")
    found = [r.at for r in rows.orderBy("s").select(N.utc_timestamp("s").alias("at")).collect()]
    assert found == ["1969-12-31T23:59:59Z", "1970-01-01T00:00:00Z", "20983-04-20T06:40:00Z", "49503-04-03T04:40:00Z"]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocked_neighbours_equal_full_sorts_with_copies_and_bad_vectors(spark, metric):
    """Ties at the k-th place go to the smaller key, although copies' products differ in their last digits."""
    rng = np.random.default_rng(4)
    vec = rng.normal(size=(700, 24)) * rng.lognormal(size=(700, 1))
    vec[rng.permutation(700)[:300]] = vec[5]
    vec[[17, 80]] = np.nan
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "obs long, vec array<double>")
    got = {(r.obs, r["rank"]): (r.other, r.score) for r in G.blocked_top_k(frame, frame, 6, metric, block=300).collect()}
    far = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(axis=2))
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    score = far if metric == "l2" else -(unit[:, None] * unit[None]).sum(axis=2)
    np.fill_diagonal(score, np.nan)
    want = {}
    for i, row in enumerate(np.round(score, 12)):
        for r, j in enumerate([j for j in np.lexsort((np.arange(700), row)) if np.isfinite(row[j])][:6]):
            want[i, r + 1] = j
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(abs(v[1]) - abs(score[k[0], v[0]])) < 1e-9 for k, v in got.items())


def test_the_least_of_a_row_are_found_without_sorting_it():
    rng = np.random.default_rng(5)
    rough = rng.normal(size=(40, 5000))
    scored = []
    i, j, s = G._least(rough, 8, 1e-11, lambda i, j: scored.append(len(i)) or rough[i, j])
    assert j.reshape(40, 8).tolist() == np.argsort(rough, axis=1)[:, :8].tolist() and sum(scored) < 40 * 50


def test_rare_words_are_ranked_as_if_all_df_were_known(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in rng.zipf(1.3, 40) % 400) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, ""), (61, None)], "doc long, text string")
    df = X.document_frequency(docs)
    rows = lambda: sorted(map(tuple, X.tfidf_top(docs, df, 62, 5).collect()))
    whole = rows()
    assert len(whole) == 300
    for common in (3, 30):  # so many df are broadcast
        monkeypatch.setattr(X, "COMMON", common)
        assert rows() == whole


def test_words_are_ranked_with_one_shuffle_of_the_texts(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "other words")], "doc long, text string")
    plan = X.tfidf_top(docs, X.document_frequency(docs), 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_blocks_and_single_precision_change_no_neighbour(spark, monkeypatch):
    """A row goes to fewer blocks where there are many; what single precision would change is sent whole."""
    assert [G._blocks(n, 8192) for n in (0, 8192, 8193, 60_000, 200_000, 600_000)] == [1, 1, 2, 8, 8, 19]
    rng = np.random.default_rng(5)
    vec = {i: (rng.normal(size=6).astype(np.float32).astype(float) if i % 3 else rng.normal(size=6)).tolist() for i in range(150)}
    points = spark.createDataFrame(list(vec.items()), "obs long, vec array<double>")
    sent = points.select("obs", *G._sent("vec", "near", "wide")).collect()
    assert all((r.near is None) == (r.obs % 3 == 0) and (r.near or r.wide) == vec[r.obs] for r in sent)
    run = lambda block: (
        sorted(map(tuple, G.blocked_top_k(points, points, 3, "l2", block=block).collect())),
        sorted(map(tuple, G.csls_top_k(points, 3, 4, block=block).drop("csls").collect())),
    )
    one = run(1000)
    monkeypatch.setattr(G, "MANY", 2)
    monkeypatch.setattr(G, "ROWS", 7)
    assert G._blocks(150, 15) == 3 and run(15) == one
    far = {(a, b): math.dist(vec[a], vec[b]) for a in vec for b in vec if a != b}
    for obs in range(0, 150, 11):
        assert [r[2] for r in one[0] if r[0] == obs] == sorted((b for b in vec if b != obs), key=lambda b: (round(far[obs, b], 12), b))[:3]
