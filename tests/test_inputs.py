"""Readers, names, selection and edits on small fixtures: headers, quoting, errors with line numbers, ties."""

import gzip

import pytest
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import labels as L
from lattica.operators import names as N
from lattica.operators import profile as P
from lattica.operators import selection as C
from lattica.operators import text as X
from lattica.sources import readers as R
from lattica.sources import sinks as S


def put(tmp_path, name, text):
    path = tmp_path / name
    (gzip.open if name.endswith(".gz") else open)(path, "wt").write(text)
    return str(path)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_panel_headers_quotes_comments_and_gzip(spark, tmp_path):
    expected = [("CD3E", "T_cell"), ("CD3E,x", "B_cell")]
    texts = {
        "a.tsv": "# note\ncell_type\tgene\nT cell\tCD3E\nB cell\tCD3E,x\n\t\n",
        "b.csv": 'gene,cell type\nCD3E,"T, cell"\n"CD3E,x",B cell\nlone\n',
        "c.tsv.gz": "CD3E\tT cell\r\nCD3E,x\tB cell\r\n%x\n",
    }
    for name, text in texts.items():
        assert tuples(R.read_panel(spark, put(tmp_path, name, text))) == expected, name
    assert R.read_panel(spark, put(tmp_path, "d.tsv", "")).count() == 0


def test_labels_count_short_rows(spark, tmp_path):
    short = []
    path = put(tmp_path, "l.tsv", "#x\ncell\tcell_type\na@1\tT\nb\n\nc\tB\tmore\n")
    assert [r[:2] for r in tuples(R.read_labels(spark, path, short))] == [("a@1", "T"), ("c", "B")] and short == [1]


def test_groups_without_any_are_an_error(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", float("nan")), ("c", None)], "cell string, k double")
    with pytest.raises(ValueError):
        R.read_groups(df, "cell")
    more = df.unionByName(spark.createDataFrame([("d", 7.0)], "cell string, k double"))
    assert tuples(R.read_groups(more, "cell"))[-1] == ("d", 7)


def test_taxonomy_keeps_scoped_synonyms_and_origins(spark, tmp_path):
    text = 'format-version: 1.2\ndata-version: v3\n\n[Term]\nid: A\nname: a cell\nsynonym: "alpha" EXACT []\nsynonym: "wide" BROAD []\nis_a: B ! b\nrelationship: develops_from C ! c\nsubset: s1\n\n[Term]\nid: B\nname: b\n\n[Term]\nid: Z\nis_obsolete: true\n\n[Typedef]\nid: part_of\n'
    path = put(tmp_path, "t.obo", text)
    got = {r.id: r for r in R.read_taxonomy(spark, path).collect()}
    assert set(got) == {"A", "B"} and got["A"].synonyms == ["alpha"] and got["A"].parents == ["B"] and got["A"].origins == ["C"] and got["A"].subsets == ["s1"]
    assert R.taxonomy_release(spark, path) == "v3"


def test_statements_read_a_written_prior_and_name_bad_lines(spark, tmp_path):
    path = put(tmp_path, "p.tsv", "# kind\tfrom\tto\nstatement\ta\tb\tprecedes\ttold so\nedge\tx\ty\tz\nstatement\tc\td\tunrelated\n")
    assert [r[:4] for r in tuples(R.read_statements(spark, path))] == [("a", "b", "precedes", "told so"), ("c", "d", "unrelated", "")]
    for bad, says in (("a\ta\tprecedes", "itself"), ("a\tb\tafter", "relation"), ("a\tb", "expected")):
        with pytest.raises(Exception, match=f":2: .*{says}"):
            R.read_statements(spark, put(tmp_path, "q.tsv", f"# x\n{bad}\n")).collect()


def test_decisions_are_lenient_but_not_with_broken_json(spark, tmp_path):
    good = put(tmp_path, "d.jsonl", 'Sure:\n```\n {"action": "label", "groups": ["K1"], "label": "T", "decided_by": "user"}\n```\n')
    assert [(r.line_no, r.action, r.groups) for r in R.read_decisions(spark, good).collect()] == [(3, "label", [1])]
    with pytest.raises(Exception, match=":2: not JSON"):
        R.read_decisions(spark, put(tmp_path, "e.jsonl", 'x\n{"action": \n')).collect()


def test_decisions_name_groups_in_every_form(spark, tmp_path):
    by = '"action": "keep", "decided_by": "agent"'
    forms = ['"cluster": 5', '"cluster": "K12"', '"cluster": [1, "C2", "3"]', '"clusters": "7"', '"clusters": []', '"groups": 0', '"label": "none named"', '"cluster": null']
    path = put(tmp_path, "f.jsonl", "\n".join(f"{{{by}, {x}}}" for x in forms))
    assert [r.groups for r in R.read_decisions(spark, path).orderBy("line_no").collect()] == [[5], [12], [1, 2, 3], [7], [], [0], [], []]
    for bad in ('"cluster": "x"', '"cluster": [1, null]', '"cluster": {"a": 1}', '"cluster": 1.5', '"cluster": [[1]]', '"cluster": true', '"cluster": -1'):
        with pytest.raises(Exception, match=":1: not a group id"):
            R.read_decisions(spark, put(tmp_path, "g.jsonl", f"{{{by}, {bad}}}")).collect()
    for by in ("", '"decided_by": "me", ', '"decided_by": null, '):
        with pytest.raises(Exception, match=":1: decided_by"):
            R.read_decisions(spark, put(tmp_path, "h.jsonl", f'{{{by}"action": "keep", "cluster": 1}}')).collect()


def test_label_files_keep_probabilities_and_only_heads_are_heads(spark, tmp_path):
    from lattica.sources import sinks

    path = put(tmp_path, "l.tsv", "# made\ncell\tlabel\tnote\tProbability\nc1\tT\tx\t0.5\ncell\tB\ty\t0.25\nc2\tT\n")
    assert tuples(R.read_labels(spark, path)) == [("c1", "T", 0.5), ("c2", "T", None), ("cell", "B", 0.25)]
    bare = put(tmp_path, "m.tsv", "c1\tT\ncell\tB\n")
    assert tuples(R.read_labels(spark, bare)) == [("c1", "T", None), ("cell", "B", None)]
    labels = spark.createDataFrame([("c1", "T", 0.75)], "obs string, label string, probability double")
    assert tuples(R.read_labels(spark, sinks.write_labels(labels, str(tmp_path / "out"))["argmax.parquet"])) == [("c1", "T", 0.75)]


def test_synonyms_with_escaped_quotes(spark, tmp_path):
    path = put(tmp_path, "q.obo", '[Term]\nid: X:1\nname: n\nsynonym: "b \\"q\\" c" EXACT []\nsynonym: "plain" EXACT []\nsynonym: "far" BROAD []\n')
    assert R.read_taxonomy(spark, path).first().synonyms == ['b "q" c', "plain"]


def test_hidden_keeps_repeated_rows_under_any_pattern(spark):
    rows = spark.createDataFrame([("ab", 1), ("ab", 1), ("xy", 2), (None, 3)], "feature string, n int")
    for patterns in (["ab"], ["a*"], ["ab", "a*", "ab"]):
        assert tuples(N.hidden(rows, spark.createDataFrame([(p,) for p in patterns], "pattern string"))) == [("ab", 1), ("ab", 1)]
    assert tuples(N.hidden(rows, spark.createDataFrame([], "pattern string"))) == []


def test_aliases_last_row_of_last_file_wins(spark, tmp_path):
    skipped = []
    paths = [put(tmp_path, "1.tsv", "T cell\tX:1\nT cell\tX:2\nbad\tnone\nshort\n"), put(tmp_path, "2.tsv", "B\tX:9\n")]
    assert tuples(R.read_aliases(spark, paths, skipped)) == [("B", "X:9"), ("T_cell", "X:2")] and skipped == [2]


def test_normal_names_and_signs(spark):
    cases = {
        "T Cells": "t cell", "CD4+ T-cell": "cd4-positive t-cell", "CD4 positive, T_cell": "cd4-positive t cell", "IgM- B": "igm-negative b", "CD4+CD8- x": "cd4-positive cd8-negative x",
        "naive-like": "naive-like", "cells": "cell", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.n for r in df.select("s", N.normalise("s").alias("n")).collect()}
    assert got == cases
    bags = {r.s: (r.b, r.u) for r in df.select("s", N.word_bag(N.normalise("s")).alias("b"), N.unqualified(N.normalise("s"), ["t-cell"]).alias("u")).collect()}
    assert bags["CD4+ T-cell"] == ("cd4-positive cell t", "cd4-positive") and bags["naive-like"] == ("like naive", None)


def test_feature_tiers_prefer_exact_names(spark):
    rows = spark.createDataFrame([("ENSG01_CD3E",), ("cd3e",), ("Actb-1",), ("XIST",)], "feature string")
    panel = spark.createDataFrame([("cd3e", "T"), ("CD3E", "T"), ("ACTB", "x"), ("none", "x")], "feature string, class string")
    assert {r.feature: r.row for r in N.match_features(panel, rows).collect()} == {"cd3e": "cd3e", "CD3E": "ENSG01_CD3E", "ACTB": "Actb-1", "none": None}


def test_origins_and_precedences(spark):
    develops = spark.createDataFrame([("c", "b"), ("p", "q")], "id string, to string")
    parents = spark.createDataFrame([("c", "p"), ("b", "m"), ("m", "c")], "id string, to string")  # a ring of steps ends
    starts = spark.createDataFrame([("C", "c"), ("Q", "q"), ("M", "m")], "label string, id string")
    found = tuples(C.precedences(starts, develops, parents))
    assert ("M", "C", "taxonomy") in found and ("Q", "C", "taxonomy") in found and all(a != b for a, b, _ in found)
    assert ("Q", "M", "inherited") in found


def test_marker_edits_in_order_and_refused(spark):
    panel = spark.createDataFrame([("a", "T cell"), ("b", "B")], "feature string, class string")
    schema = "line_no int, action string, label string, features array<string>"
    edits = spark.createDataFrame([(1, "markers_add", "T_cell", ["a", " c "]), (2, "markers_drop", "T cell", ["c"]), (3, "markers_add", "T cell", ["c"]), (4, "markers_drop", "B", ["b"])], schema)
    assert tuples(C.edit_markers(panel, edits)) == [("a", "T_cell"), ("c", "T_cell")]
    with pytest.raises(ValueError, match="decision 2: z"):
        C.edit_markers(panel, spark.createDataFrame([(2, "markers_drop", "B", ["b", "z"])], schema))
    assert tuples(C.edit_markers(panel, spark.createDataFrame([], schema))) == [("a", "T_cell"), ("b", "B")]


def test_walk_abstains_on_ties(spark):
    edges = spark.createDataFrame([("x", "R"), ("y", "R"), ("x1", "x")], "child string, parent string")
    mass = spark.createDataFrame([(1, "R", 1.0), (1, "x", 0.5), (1, "y", 0.5), (2, "R", 1.0), (2, "x", 0.9), (2, "y", 0.1), (2, "x1", 0.9)], "grp int, id string, mass double")
    assert tuples(C.walk(edges, spark.createDataFrame([("R",)], "id string"), mass)) == [(1, "R", 1.0, True), (2, "x1", 0.9, False)]


def test_layout_choices_and_bins(spark):
    merges = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.9), (2, 0.5)], "tree int, height double")
    assert tuples(C.largest_gap(merges)) == [(1, pytest.approx(0.55)), (2, None)]
    facts = spark.createDataFrame([(1, 0.2, 0.1), (2, -0.9, 0.3), (3, 0.1, 0.8)], "component int, rho double, eta2 double")
    assert C.suggested_pair(facts) == (2, 3) and C.suggested_pair(facts.limit(0)) is None
    layout = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 2.0, 0.0, 1.0, 2.0), (1, 9.0, 9.0, 0.0, 2.0)], "grp int, x double, y double, weight double, chord double")
    assert tuples(C.anchor_median(layout)) == [(1, 1.0, 0.0)]
    centre = spark.createDataFrame([(1, 0.0, 0.0, 0.5)], "grp int, x double, y double, radius double")
    assert C.ring(layout, centre).first().radius == pytest.approx(0.5 * (166 / 3) ** 0.5 / (9 / 3) ** 0.5)


def test_signatures_descriptions_and_manifests(spark, tmp_path):
    tests = spark.createDataFrame([(1, "a", 2.0, 0.1, 0.2), (1, "b", 2.0, 0.1, 0.2), (1, "c", -1.0, 0.9, 0.9)], "grp int, term string, z double, p double, q double")
    assert [r.term for r in S.signature(tests, top=1).collect()] == ["a"]
    S.write_signature(tests, str(tmp_path / "sig"))
    assert sorted(r[0].split("\t")[2] for r in spark.read.text(str(tmp_path / "sig")).collect()) == ["a", "b"]
    S.save_manifest(spark, {"rounds": [1], "name": "x"}, str(tmp_path / "m"))
    assert S.load_manifest(spark, str(tmp_path / "m")) == {"rounds": [1], "name": "x"}
    with pytest.raises(Exception, match="(?i)already exists"):
        S.save_manifest(spark, {}, str(tmp_path / "m"))
    S.save_manifest(spark, {"name": "y"}, str(tmp_path / "m"), replace=True)
    assert S.load_manifest(spark, str(tmp_path / "m")) == {"name": "y"}
    edges = spark.createDataFrame([("near", "a", "b", 0.5), ("is_a", "a", "c", 1.0)], "kind string, a string, b string, weight double")
    assert len(S.write_edges(edges, str(tmp_path / "e"))) == 2
    S.write_vocabulary(spark.createDataFrame([("w", 3)], "word string, df long"), str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).first()[0] == "w\t3"


def test_null_groups_repeated_labels_braces_and_deep_chains(spark):
    counts = spark.createDataFrame([(1, 7, 2.0), (2, 7, 3.0)], "obs int, feature int, value double")
    cells = spark.createDataFrame([(1, None, "x"), (2, 5, "x")], "obs int, grp int, batch string")
    assert tuples(P.feature_sums(counts, cells)) == [("batch", "x", 7, 5.0), ("group", "5", 7, 3.0)]
    names = spark.createDataFrame([("a@1",), ("b@1",)], "name string")
    keys = spark.createDataFrame([("a@1", "T", 2), ("a@1", "U", 1), ("b", "V", 1), ("b", "W", 2)], "key string, label string, line int")
    assert tuples(L.fallback_labels(names, keys, "line")) == [("a@1", "U"), ("b@1", "V")]
    with pytest.raises(ValueError):
        L.left_labels(cells, spark.createDataFrame([(9, "T")], "obs int, label string"))
    braces = spark.createDataFrame([("a {b{c{d{e{f}}}}} x",), ("u } v {w",), ("",)], "t string")
    assert [r[0] for r in braces.select(X.strip_braces("t")).collect()] == ["a x", "u } v {w", ""]
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(80)], "child string, parent string")
    assert G.closure(chain).agg(F.max("depth")).first()[0] == 80
    line = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(0, 9)], "a int, b int")
    assert sorted(r.path for r in G.lineages(line).collect()) == [[0, 1, 2, 3, 4, 5], [0, 9]]
    assert tuples(C.first_parents(chain.withColumn("place", F.lit(0))).select("id", F.size("chain")))[0] == ("0", 81)


def test_cycles_are_refused(spark):
    ring = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("x", "a", 0)], "child string, parent string, place int")
    with pytest.raises(ValueError, match="cycle"):
        C.first_parents(ring)
    mass = spark.createDataFrame([(1, i, 0.9) for i in "abc"], "grp int, id string, mass double")
    with pytest.raises(ValueError, match="cycle"):
        C.walk(ring.select("child", "parent"), spark.createDataFrame([("a",)], "id string"), mass)


def test_evidence_has_the_formats_columns(spark, tmp_path):
    rows = spark.createDataFrame([(3, "T", 0.5, None), (4, "B", 0.25, 1.5)], "grp int, class string, share double, pip double")
    S.write_evidence(rows, str(tmp_path / "e"))
    got = spark.read.parquet(str(tmp_path / "e"))
    assert got.columns == ["cluster", "celltype", "share", "nes", "p", "q", "pip", "fold", "explained", "score", "units"]
    told = {r.cluster: r for r in got.collect()}
    assert set(told) == {"K3", "K4"} and told["K3"].share == 0.5 and told["K3"].pip != told["K3"].pip and told["K4"].pip == 1.5 and told["K4"].nes != told["K4"].nes
