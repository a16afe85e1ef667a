"""Matching cascade, priors, hosts, linkage, rules, species, geometry on small fixtures."""

import numpy as np
import pytest

from lattica.operators import graph as G
from lattica.operators import matching as M
from lattica.operators import priors as PR
from lattica.sources import readers as R


def test_ambiguous_names_stay_unmatched_and_own_names_win(spark):
    names = spark.createDataFrame([("X", "b cell", True), ("Y", "lymph", True), ("Y", "b cell", False), ("Z", "lymphs", False), ("W", "twin", False), ("V", "twin", False)], "id string, name string, own boolean")
    labels = spark.createDataFrame([("B_cell",), ("cell b",), ("twin",), ("nothing",), ("lymph",)], "label string")
    none = spark.createDataFrame([], "key string, id string")
    got = {r.label: (r.id, r.how) for r in M.match_labels(labels, names, none).collect()}
    assert got["B_cell"] == ("X", "name") and got["twin"] == (None, "ambiguous") and got["nothing"] == (None, None) and got["lymph"] == ("Y", "name")
    assert got["cell b"] == (None, "ambiguous")
    assert M.methods_text(M.placement_counts(M.match_labels(labels, names, none))) == "Of 5 labels 2 by name, 2 ambiguous, 1 unmatched."


def test_priors_refuse_cycles_and_clashes(spark):
    schema = "a string, b string, relation string, layer int, line int"
    make = lambda *rows: PR.build_prior(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema))
    prior = make(("a", "b", "precedes", 0), ("b", "c", "precedes", 0), ("a", "c", "precedes", 0), ("c", "d", "unrelated", 0))
    assert sorted(map(tuple, prior["edges"].collect())) == [("a", "b"), ("b", "c")] and [r[0] for r in prior["roots"].collect()] == ["a"]
    assert PR.refuse_statement(prior, "c", "a", "precedes") == "it would close a cycle"
    assert PR.refuse_statement(prior, "a", "c", "precedes") == "already said" and PR.refuse_statement(prior, "a", "c", "unrelated") == "the pair is ordered"
    assert PR.refuse_statement(prior, "d", "c", "unrelated") == "already said" and PR.refuse_statement(prior, "a", "d", "precedes") is None
    with pytest.raises(ValueError, match="cycle through a, b"):
        make(("a", "b", "precedes", 0), ("b", "c", "precedes", 0), ("c", "a", "precedes", 0))
    with pytest.raises(ValueError, match="unrelated but are ordered"):
        make(("a", "b", "precedes", 0), ("b", "c", "precedes", 0), ("a", "c", "unrelated", 0))


def test_hosts_never_join_two_placed_classes(spark):
    edges = spark.createDataFrame([("p", "x", 0.9), ("x", "q", 0.8), ("q", "y", 0.7), ("z", "w", 0.5)], "a string, b string, ratio double")
    host, inferred = PR.hosts(edges, {"p", "q"}, {"p": 0.1, "x": 0.5, "q": 0.2, "y": 0.1})
    assert host == {"p": "p", "x": "p", "q": "q", "y": "q", "z": None, "w": None} and inferred == [("p", "x"), ("y", "q")]


def test_linkage_cuts_at_the_largest_gap(spark):
    sim = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.8), ("a", "c", 0.1)], "a string, b string, similarity double")
    assert PR.split_by_linkage(sim, ["a", "b", "c", "d"]) == [("a", "b"), ("c", "d")]
    assert PR.split_by_linkage(sim.limit(0), ["a"]) == [["a"]]
    rng = np.random.default_rng(1)
    points = rng.normal(size=(12, 3))
    d = np.linalg.norm(points[:, None] - points, axis=2)
    sets = [{i} for i in range(12)]  # plain average linkage
    heights = []
    while len(sets) > 1:
        best = min(((np.mean([d[i, j] for i in x for j in y]), k, m) for k, x in enumerate(sets) for m, y in enumerate(sets) if k < m))
        heights.append(best[0])
        sets[best[1]] |= sets.pop(best[2])
    assert [h for h, _ in PR.average_linkage([str(i) for i in range(12)], d)] == pytest.approx(heights)


def test_rules_species_and_small_files(spark, tmp_path):
    assert M.merge_rules('{"a": {"b": 1, "_doc": "x"}, "c": [1]}', '{"a": {"b": null, "d": 2}, "c": [2]}') == {"a": {"d": 2}, "c": [2]}
    with pytest.raises(ValueError):
        M.merge_rules("[1]")
    told = lambda *f: M.species(spark.createDataFrame([(x,) for x in f], "feature string"))
    assert told("CD3E", "ACTB", "Actb") == "human" and told("ENSMUSG01", "CD3E") == "mouse" and told("Actb", "ACTB") is None
    path = tmp_path / "m.tsv"
    path.write_text("# mixed\nT mix\tT\tB\nT mix\tT\tNK\nshort\tx\n")
    assert sorted(map(tuple, R.read_mixed(spark, str(path)).collect())) == [("T mix", "NK", 1), ("T mix", "T", 0)]
    path.write_text("T cell\tJoin\nT cell\talone\n")
    assert [tuple(r) for r in R.read_answers(spark, str(path)).collect()] == [("T_cell", "alone")]
    path.write_text("T cell\tperhaps\n")
    with pytest.raises(Exception, match=":1: an answer"):
        R.read_answers(spark, str(path)).collect()


def test_whitening_and_geometry(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ np.array([[2.0, 0.5, 0], [0, 1.0, 0.3], [0, 0, 0.2]])
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "obs int, grp int, vec array<double>")
    white = M.whitened(df, G.balanced_centre(df), G.within_covariance(df))
    again = G.within_covariance(white.join(df.select("obs", "grp"), "obs")).collect()
    assert all(abs(r["cov"] - (r["i"] == r["j"])) < 1e-9 for r in again) and len(again) == 6
    unit = [np.linalg.norm(r.vec) for r in M.prepared(df, "l2").collect()]
    assert np.allclose(unit, 1)
    with pytest.raises(ValueError):
        M.prepared(df, "other")
