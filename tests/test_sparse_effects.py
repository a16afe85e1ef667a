"""Sampled class effects: planted classes, chains that disagree, credible sets, and inputs with zeros."""

import numpy as np
import pytest

from lattica.operators import sparse_effects as S


def problem(seed=5, n=400, classes=8, effect=2.0):
    """Log folds in which class 0 is up; class 7 shares a third of its features and has no others up."""
    rng = np.random.default_rng(seed)
    held = [[] for _ in range(n)]
    for c in range(classes - 1):
        for f in rng.choice(n, 30, replace=False):
            held[f].append(f"c{c}")
    own = [f for f in range(n) if "c0" in held[f]]
    for f in [*own[:10], *[f for f in range(n) if f not in own][:20]]:
        held[f].append(f"c{classes - 1}")
    y = np.array([effect * ("c0" in h) for h in held]) + rng.normal(0, 0.5, n)
    return y, held


def test_the_planted_class_comes_out_and_its_sharer_does_not():
    y, held = problem()
    panel = S.Incidence(held)
    like = S.Likelihood(y, np.full(len(y), 0.3))
    got = S.run_chain(like, panel, 100, 300, np.random.default_rng(0))
    assert panel.classes[0] == "c0" and got["pip"][0] > 0.9 and got["pip"][1:].max() < 0.2 and abs(got["theta"][0] - 2) < 0.3
    share = S.explained(like, panel, got["theta"])
    assert share[0] > 0.9 and share.sum() <= 1 + 1e-9
    assert S.explained(like, panel, np.zeros(len(panel.classes))).sum() == 0


def test_etas_gains_and_correlations_equal_loops():
    _, held = problem(seed=1, n=60)
    panel = S.Incidence(held)
    theta = np.random.default_rng(1).random(len(panel.classes))
    assert np.allclose(panel.etas(theta), [sum(theta[panel.classes.index(c)] for c in h) for h in held])
    indicator = np.array([[c in h for h in held] for c in panel.classes], float)
    assert np.allclose(panel.correlation(), np.abs(np.corrcoef(indicator)), atol=1e-9)


def test_slices_leave_the_posterior_alone():
    """Under a prior N(0, 1) and a likelihood N(z; 1, 1/3) draws have mean 3/4 and variance 1/4."""
    rng = np.random.default_rng(2)
    gain = lambda z: -1.5 * (z - 1) ** 2
    z, seen = 0.0, []
    for _ in range(20_000):
        z = S.slice_on_ellipse(rng, z, gain, gain(z))
        seen.append(z)
    assert abs(np.mean(seen) - 0.75) < 0.02 and abs(np.var(seen) - 0.25) < 0.02


def test_a_chain_that_went_elsewhere_is_named():
    rng = np.random.default_rng(3)
    mean, var = rng.normal(0, 0.02, (8, 5)), np.full((8, 5), 0.05)
    assert S.diagnosis(mean, var, 500) == (pytest.approx(1.0, abs=0.02), None)
    mean[4:6, 2] += 1.5  # both halves of chain 2
    rhat, bad = S.diagnosis(mean, var, 500)
    assert rhat > S.WARN and bad == 2
    assert np.isinf(S.split_rhat(np.array([[0.0], [1.0]]), np.zeros((2, 1)), 10)) and S.split_rhat(np.zeros((2, 1)), np.zeros((2, 1)), 10) == 1.0


def test_credible_sets_hold_like_classes_and_ties_go_by_what_is_explained():
    alike = np.eye(4)
    alike[0, 1] = alike[1, 0] = 0.8
    assert S.credible(np.array([0.5, 0.4, 0.0, 0.0, 0.1]), alike) == [0, 1]
    assert S.credible(np.array([0.5, 0.0, 0.4, 0.0, 0.1]), alike) is None  # unlike classes
    assert S.credible(np.array([0.4, 0.0, 0.0, 0.0, 0.6]), alike) is None  # mostly none
    assert S.credible(np.array([0.9, 0.02, 0.01, 0.0, 0.07]), alike) == [0]
    pip, share = np.array([0.99, 0.985, 0.97, 1.0]), np.array([0.1, 0.5, 0.9, 1.0])
    assert S.called(pip, share, [[0, 1], [2]]) == 1 and S.called(pip, share, []) is None


def test_effects_are_matched_whatever_their_numbers():
    rng = np.random.default_rng(4)
    reference = rng.dirichlet(np.full(6, 0.2), 5)
    turned = reference[[3, 1, 0, 4, 2]]
    assert np.allclose(S.matched(reference, turned), reference)


def test_chains_over_tables_of_features_go_as_over_the_features(spark):
    """Rows follow the sets of classes, not the features, and give the same draws; sets of few features stay alone."""
    rng = np.random.default_rng(7)
    n = 4000
    held = [[f"c{f % 5}", f"d{f % 3}"] for f in range(n)] + [["c0"], ["d2"], ["d2"]]
    y, v = np.array([1.5 * ("c1" in h) for h in held]) + rng.normal(0, 0.5, n + 3), rng.uniform(0.02, 0.4, n + 3)
    markers = spark.createDataFrame([(1, f, float(y[f]), float(v[f]), 0.05, held[f]) for f in range(n + 3)], "grp int, feature long, x double, v double, s2 double, classes array<string>")
    rows, edges, groups = S.condensed(markers)
    found = rows.toPandas()
    assert groups == 1 and len(found) <= 15 + 3 and found["n"].sum() == n + 3 and found["pieces"].isna().sum() == 3
    like, panel = S._grid(found, edges)
    whole, every = S.Likelihood(y, v + 0.05), S.Incidence(held)
    theta = rng.random(len(panel.classes)) * [0, 0, 1, 1, 3, 30, 0, 400]
    assert like(panel.etas(theta)).sum() == pytest.approx(whole(every.etas(theta)).sum(), rel=1e-11)
    assert np.allclose(panel.correlation(), every.correlation(), atol=1e-12) and np.allclose(S.explained(like, panel, theta), S.explained(whole, every, theta))
    a, b = (S.run_chain(*on, 20, 40, np.random.default_rng(0)) for on in ((like, panel), (whole, every)))
    assert all(np.allclose(a[k], b[k], atol=1e-8) for k in a)


def counts(spark, seed=6, groups=9, n=300):
    """Counts in which group g is up in class g's features; the last group has none, the one before counts without classes."""
    rng = np.random.default_rng(seed)
    rate = rng.gamma(2, 8, n)
    panel = [(f, f"t{c}") for c in range(6) for f in range(20 * c, 20 * c + 20)] + [(0, "t1"), (5, "few"), (6, "few"), (999, "t0"), (7, None)]
    y = rng.poisson(rate * np.ones((groups - 1, 1)))
    for g in range(6):
        y[g, 20 * g : 20 * g + 20] = rng.poisson(rate[20 * g : 20 * g + 20] * 5)
    sums = spark.createDataFrame([(g, f, float(y[g, f])) for g in range(groups - 1) for f in range(n) if y[g, f]], "grp int, feature long, value double")
    return sums, spark.createDataFrame(panel, "feature long, class string").where("class is not null"), spark.createDataFrame([(g,) for g in range(groups)], "grp int")


def test_groups_are_called_by_their_classes(spark):
    sums, panel, groups = counts(spark)
    run = lambda parts: S.class_effects(sums.repartition(parts), panel.repartition(parts), groups, chains=3, warmup=100, draws=200).collect()
    got = run(4)
    assert {r.grp for r in got} == set(range(8)) and {r["class"] for r in got} == {f"t{c}" for c in range(6)}  # "few" has too few features
    calls = {r.grp: r["class"] for r in got if r.called}
    assert calls == {g: f"t{g}" for g in range(6)}
    for r in got:
        if r.grp < 6 and r["class"] == f"t{r.grp}":
            assert r.pip > 0.9 and abs(r.fold - np.log(5)) < 0.5 and r.credible_set is not None and r.explained > 0.5
        elif r.grp < 6:
            assert r.pip < 0.5 and not r.called  # the noise of 20 features
        assert r.rhat >= 1 and (r.bad_chain is None or r.rhat > S.WARN)
    key = lambda rows: sorted((r.grp, r["class"], round(r.pip, 6), round(r.fold, 6), r.called) for r in rows)
    assert key(run(1)) == key(got)
    assert S.class_effects(sums.where("false"), panel, groups, chains=1, warmup=5, draws=10).collect() == []
