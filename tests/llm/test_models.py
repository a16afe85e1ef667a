"""Quality classifier, WARC archives, nearest neighbours and the pipeline."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import ann, quality, warc


def test_trees_learn_an_interaction_and_match_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    p = model.probability(x)
    assert ((p[2000:] >= 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p[:50], [walk(r) for r in x[:50]])


def test_quality_query_on_held_out_labels(spark):
    from lattica.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op2_quality"](spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_quality_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "text", "s"), (4, "a b", "s"), (4, "a b", "s")], "doc_id long, text string, score string")
    for labels in ([], [(4, 1), (1, None), (None, 0), (4, 1)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = quality.with_scores(docs, model).collect()
        assert len(rows) == 5 and all(0 < r.score < 1 for r in rows)


def pages(spark):
    long = "<p>ünï</p>" * 9000
    rows = [(3, "http://a/ b\n", "x" * 150), (1, "http://a", "x" * 150), (2, None, "x" * 150), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", long), (9, "u", long + "!"), (10, "u", long), (None, "u", "x" * 150), (11, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 20), (12, "u", "a" * 100), (12, "u", "a" * 100)]
    return rows, spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, payload_bytes int")


def test_archives_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "warc")
    warc.write_archives(df.repartition(3), path, segment_bytes=1000, records_a_file=7)
    records = warc.read_records(spark, path)
    assert records.where("type = 'continuation'").count() > 100
    whole = warc.reassembled(records).collect()
    assert len(whole) == len(rows) and all(r.complete or r.type == "revisit" for r in whole)
    got = sorted((str(r.page_id), bytes(r.payload)) for r in whole if r.type == "response")
    expected = [r for r in rows if r[0] not in (2, 3, 10, None)]
    assert got == sorted((str(p), (h or "").encode()) for p, _, h in expected)
    report = {r.page_id: r for r in warc.page_report(warc.reassembled(records)).collect()}
    assert report[3].refers_to == report[2].refers_to == report[None].refers_to == 1 and report[10].refers_to == 8
    assert report[3].payload_bytes == 150 and report[3].payload_digest == report[1].payload_digest
    assert report[5].record_type == "response" and report[12].record_type == "response"


def test_broken_records_are_told(spark, tmp_path):
    _, df = pages(spark)
    path = str(tmp_path / "warc")
    warc.write_archives(df.where("page_id = 8"), path, segment_bytes=1000)
    records = warc.read_records(spark, path)
    for broken in (records.where("coalesce(segment_number, '1') != '5'"), records.where("segment_total_length is null"), records.withColumn("segment_total_length", F.when(F.col("segment_total_length").isNotNull(), "7"))):
        rows = warc.reassembled(broken).collect()
        assert len(rows) == 1 and not rows[0].complete and rows[0].payload is None
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"zz\r\n") is None


def test_no_pages(spark, tmp_path):
    _, df = pages(spark)
    path = str(tmp_path / "none")
    warc.write_archives(df.limit(0), path)
    assert warc.reassembled(warc.read_records(spark, path)).count() == 0


def brute_nearest(ids, x, query, k):
    own = x[ids == query][0]
    d = np.sqrt(((x - own) ** 2).sum(axis=1))
    d[ids == query] = np.inf
    best = np.lexsort([ids, d])[:k]
    return [(int(ids[i]), float(d[i])) for i in best if np.isfinite(d[i])]


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + 4 * rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, vector array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k=10, sample=1500, block_rows=64, block_queries=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        exact = dict(brute_nearest(ids, x, q, 2999))
        assert all(exact[v] == s for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in brute_nearest(ids, x, q, 10)})
    assert hits >= 0.9 * 300


def test_nearest_neighbours_odd_vectors(spark):
    same = [1.0, 2.0]
    rows = [(0, same), (100, [1.0, 2.5]), (200, None), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (700, [1.0, 2.0, 3.0]), (None, same), (800, [])]
    rows += [(i, same) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k=10, block_rows=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100}
    assert sorted(got[0]) == [(i, i, 0.0) for i in range(1, 11)]
    assert sorted(got[100]) == [(i + 1, i, 0.5) for i in range(10)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id in (0, 100)"), F.col("vec_id") % 100 == 0).count() == 2


def test_copies_push_no_neighbour_out(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += rows  # every row twice
    rows += [(7, [float(c) for c in x[0] + 0.001 * m]) for m in range(1, 30)]  # one identifier fills the nearest places of query 0
    rows += [(9, rows[9][1])] * 40
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    ids, all_x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for block_rows in (16_384, 8):
        got = {}
        for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, block_rows=block_rows).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {0, 20, 40}
        for q, found in got.items():
            d = {}
            for i, v in zip(ids, np.sqrt(((all_x - x[q]) ** 2).sum(axis=1))):
                if i != q:
                    d[int(i)] = min(d.get(int(i), np.inf), float(v))
            best = sorted((v, i) for i, v in d.items())[:10]
            assert sorted(found) == [(n + 1, i, pytest.approx(v)) for n, (v, i) in enumerate(best)]


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8))
    found = ann.nearest(x, x, 6)[:, 1:]
    part = ann.balanced_parts(x, found, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.05 * 100)
    cut = (part[found] != part[:, None]).mean()
    assert cut < (rng.permutation(part)[found] != part[:, None]).mean()


@pytest.fixture(scope="module")
def staged(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from lattica.llm.common import durable

    folder = "/root/testdata/sf0.001"
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(durable(stage(spark, docs[-1], folder)))
    return folder, docs


def test_pipeline_stages_against_brute_force(spark, staged):
    from tests.llm.test_codecs import brute_spans
    from tests.llm.test_duplicates import brute_components, brute_dedup

    folder, docs = staged
    texts = [{r.doc_id: r.text for r in d.collect()} for d in docs[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all((d in texts[1]) == bool(q) for d, q in labels.items() if d in texts[0] and zlib.crc32(str(d).encode()) % 3 != 1)
    assert set(texts[2]) == {d for d, _, c in brute_components(sorted(texts[1].items())) if c == d}
    assert texts[3] == dict(brute_dedup(sorted(texts[2].items())))
    assert set(texts[4]) == set(texts[3])
    for d, t in texts[4].items():
        assert t == texts[3][d] if not brute_spans(texts[3][d]) and "[secret]" not in t else not brute_spans(t)
    assert all(d.columns == docs[0].columns for d in docs[:-1])
    packed = docs[-1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in packed} == set(texts[4]) and all(r.n == r.m for r in packed)


def test_pipeline_hands_workers_small_batches(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(40).selectExpr("id as doc_id", "repeat('word ', 200000) as text", "'en' as lang", "'s' as source", "1000000L as n_chars").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    try:
        pieces = dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        assert docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] <= 10_000_000  # 40 MB in one before
        assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).where("n != 200001").isEmpty()
    finally:
        spark.conf.set(key, before)
