"""Models against closed forms and planted truths; no Spark needed."""

import hashlib
import math
import os

import numpy as np

from lattica.operators import models as M


def test_poisson_tail_equals_the_sum():
    for mean in (0.1, 1.0, 4.5, 30.0):
        for x in (0, 1, 3, 10, 40):
            below = sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(x))
            assert abs(M.poisson_tail_of(x, mean) - (1 - below)) < 1e-9


def test_star_tree_equals_benjamini_hochberg():
    rng = np.random.default_rng(3)
    for _ in range(50):
        p = {f"c{i}": float(x) for i, x in enumerate(rng.random(20) ** 3)}
        got = set(M.simes_bh(p, {"root": list(p)}, "root", 0.1))
        order = sorted(p.values())
        passed = max((i + 1 for i, x in enumerate(order) if x <= 0.1 * (i + 1) / len(order)), default=0)
        assert got == {c for c, x in p.items() if passed and x <= order[passed - 1]}


def test_selection_needs_selected_parents():
    children = {"root": ["a", "b"], "a": ["a1", "a2"], "b": ["b1", "b2"]}
    got = M.simes_bh({"a1": 0.0001, "a2": 0.9, "b1": 0.8, "b2": 0.9}, children, "root", 0.05)
    assert set(got) == {"a", "a1"}
    assert M.simes_bh({"a1": math.nan}, {"root": ["a1"]}, "root") == {}


def test_runs_of_ties_are_relative_to_their_first():
    items = [("a", 0.99, 1.0), ("b", 0.985, 3.0), ("c", 0.978, 9.0), ("d", math.nan, 99.0)]
    assert M.call_order(items) == ["b", "a", "c", "d"]


def test_queries_take_all_draws():
    import inspect

    from lattica.operators import enrichment
    from lattica.plans import models

    assert inspect.signature(enrichment.enrichment_test).parameters["draws"].default == 10_000
    assert inspect.signature(M.matched_test).parameters["draws"].default == 200
    assert "draws=" not in inspect.getsource(models)


def test_power_iteration_equals_the_dense_times(spark, monkeypatch):
    rng = np.random.default_rng(10)
    at = rng.random((60, 2)) * [6, 1]
    w = np.exp(-((at[:, None] - at[None]) ** 2).sum(axis=2) * 2)
    kernel = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(60) for j in range(60) if i != j and w[i, j] > 0.05], "i long, j long, w double")
    roots = spark.createDataFrame([(0,), (1,)], "obs long")
    dense = {r.obs: r.t for r in M.pseudotime(kernel, roots, components=4, used=3).collect()}
    monkeypatch.setattr(M, "DENSE_NODES", 10)
    blocks = {r.obs: r.t for r in M.pseudotime(kernel, roots, components=4, used=3).collect()}
    assert dense.keys() == blocks.keys() and max(abs(dense[i] - blocks[i]) for i in dense) < 0.02


def test_regions_run_a_hundred_rounds(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(60, 4)) * 0.6 + [1, 0.3, 0, 0], rng.normal(size=(200, 4)) * 0.6 + [1, -0.3, 0, 0]])
    grp = np.repeat([0, 1], [60, 200])
    points = spark.createDataFrame([(i, int(g), [float(c) for c in v]) for i, (g, v) in enumerate(zip(grp, x))], "obs long, grp int, vec array<double>").coalesce(1)

    def fitted(rounds):
        unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
        far = 2 - 2 * unit(x) @ unit(np.array([x[grp == g].mean(axis=0) for g in (0, 1)])).T
        weight, var = np.full(2, 0.5), np.full(2, 1 / 3)
        for last in range(rounds + 1):
            log = np.log(weight) - 1.5 * np.log(var) - far / (2 * var)
            p = np.exp(log - log.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            if last == rounds:
                return p.max(axis=1)
            weight, var = p.mean(axis=0), (p * far).sum(axis=0) / (3 * p.sum(axis=0))

    got = {r.obs: r.membership for r in M.regions(points).collect()}
    got = np.array([got[i] for i in range(len(x))])
    assert np.abs(got - fitted(100)).max() < 1e-6 < np.abs(got - fitted(15)).max()


def test_decoys_are_the_least_md5_of_each_stratum(spark):
    """Plain md5 orders; a bound that keeps too few is raised until each stratum has what it needs."""
    sets = {"a": range(0, 40, 3), "b": [1, 2, 55], "c": range(60)}
    stratum = {f: f % 2 for f in range(60)}
    members = spark.createDataFrame([(s, f) for s, fs in sets.items() for f in fs], "set string, feature long")
    strata_of = spark.createDataFrame(list(stratum.items()), "feature long, stratum int")
    want = set()
    for s, fs in sets.items():
        for d in range(5):
            for k in (0, 1):
                pool = sorted((f for f in stratum if stratum[f] == k), key=lambda f: hashlib.md5(f"7|{s}|{d}|{f}".encode()).hexdigest())
                want |= {(s, d, f) for f in pool[: sum(stratum[f] == k for f in fs)]}
    for spread in (8.0, 0.05):
        got = [tuple(r) for r in M.decoys(members, strata_of, 5, spread=spread).collect()]
        assert len(got) == len(want) and set(got) == want


def test_decoys_are_dealt_to_tasks_before_they_are_drawn(spark):
    """A small table is one partition, yet its draws are many tasks' work."""
    members = spark.createDataFrame([("a", f) for f in range(300)], "set string, feature long").coalesce(1)
    strata_of = spark.createDataFrame([(f, 0) for f in range(3000)], "feature long, stratum int").coalesce(1)
    group = "decoys-dealt"
    spark.sparkContext.setJobGroup(group, group)
    M.decoys(members, strata_of, 20)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) >= 16


def test_matched_sums_fall_as_random_sets_do_over_parts_of_strata(spark, monkeypatch):
    """Each draw has a stratum's features in number, whatever the parts; means and spreads are those of sampling without return."""
    monkeypatch.setattr(M, "LEVELS_A_TASK", 90)  # three groups: parts of 30 features
    x = {f: float((f * 37) % 101) for f in range(300)}
    strata_of = spark.createDataFrame([(f, int(f >= 200)) for f in range(300)], "feature long, stratum int")
    rows = [(int(f >= 200), f, 1.0) for f in range(300)] + [(2, f, v) for f, v in x.items()]
    level = spark.createDataFrame(rows, "grp int, feature long, x double")
    members = spark.createDataFrame([("a", f) for f in range(180, 250)] + [("b", f) for f in range(4)], "set string, feature long")
    got = M.matched_sums(level, members, strata_of, 400).toPandas()
    again = M.matched_sums(level.repartition(3), members.repartition(5), strata_of.repartition(2), 400).toPandas()
    sums = {k: g.sort_values("draw")["s"].to_numpy() for k, g in got.groupby(["grp", "set"])}
    assert all(np.allclose(g.sort_values("draw")["s"], sums[k]) for k, g in again.groupby(["grp", "set"]))
    assert (sums[0, "a"] == 20).all() and (sums[1, "a"] == 50).all() and (sums[0, "b"] == 4).all()
    pools = [np.array([x[f] for f in range(200)]), np.array([x[f] for f in range(200, 300)])]
    for name, sizes in (("a", (20, 50)), ("b", (4, 0))):
        mean = sum(n * p.mean() for n, p in zip(sizes, pools))
        deviation = np.sqrt(sum(n * p.var(ddof=1) * (1 - n / len(p)) for n, p in zip(sizes, pools)))
        assert len(set(sums[2, name])) > 100
        assert abs(sums[2, name].mean() - mean) < 4 * deviation / 20 and 0.85 < sums[2, name].std() / deviation < 1.15
    tested = {(r.grp, r.set): r for r in M.matched_test(level, members, strata_of, 400).collect()}
    assert tested[0, "a"].z is None and abs(tested[2, "b"].effect - np.mean([x[f] for f in range(4)])) < 1e-12


def test_leading_pairs_over_parts_leave_only_their_vectors(spark):
    """Pairs equal numpy's, restarts and all; tables of steps (24 of a cycle stayed, each with all blocks so far) are gone."""
    rng = np.random.default_rng(12)
    n = 900
    i, j = rng.integers(0, n, (2, 9 * n))
    m = np.zeros((n, n))
    np.add.at(m, (i, j), rng.random(9 * n))
    m = (m + m.T) / 2
    degree = np.maximum(m.sum(axis=1), 1e-9)
    m = m / np.sqrt(degree[:, None] * degree[None])
    at = [(int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m))]
    s = spark.createDataFrame(at, "i long, j long, s double")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    value, vectors = M.leading_pairs(s, 4)
    assert len(set(os.listdir(folder)) - before) == 1
    exact = np.linalg.eigvalsh(m)
    exact = exact[np.argsort(-np.abs(exact))[:4]]
    assert np.abs(value - np.sort(exact)[::-1]).max() < 1e-3
    rows = vectors.collect()
    v = np.zeros((n, 4))
    v[[r.i for r in rows]] = [r.v for r in rows]
    assert len(rows) == n and np.abs(v.T @ v - np.eye(4)).max() < 1e-8 and np.linalg.norm(m @ v - v * value, axis=0).max() < 2e-3
