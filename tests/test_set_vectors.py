"""Set vectors: planted sets lie nearer to their features than their decoys do."""

import numpy as np
import pytest

from lattica.operators import set_vectors as V


@pytest.fixture(scope="module")
def units(spark):
    """Sets around a direction of their own, and random ones."""
    rng = np.random.default_rng(0)
    vec = rng.normal(size=(400, 12))
    rows = []
    for s in range(4):
        some = range(40 * s, 40 * s + [20, 5, 90, 12][s] % 40)
        vec[list(some)] += 3 * rng.normal(size=12)
        rows += [(f"planted {s}", int(f)) for f in some]
    rows += [(f"random {s}", int(f)) for s in range(4) for f in rng.choice(np.arange(200, 400), 12, replace=False)]
    rows += [("small", 1), ("small", 2), ("small", 1), ("gone", 9999), (None, 3), ("planted 0", 0), ("planted 0", 401), ("planted 0", 402)]
    odd = [(401, None), (402, [float("nan")] * 12), (403, [])]
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)] + odd, "feature long, vec array<double>")
    return features, spark.createDataFrame(rows, "set string, feature long")


def test_planted_sets_are_nearer_than_all_decoys(spark, units):
    features, sets = units
    got = V.set_vectors(features, sets)
    rows = got.collect()
    own = {r.set: r for r in rows if r.draw is None}
    assert set(own) == {f"planted {s}" for s in range(4)} | {f"random {s}" for s in range(4)}
    assert own["planted 0"].covered == 20 and all(abs(r.bin - r.covered) <= r.covered / 4 for r in own.values())
    decoys = {}
    for r in rows:
        if r.draw is not None:
            assert r.covered == r.bin
            decoys.setdefault(r.bin, []).append(r.draw)
    assert set(decoys) == {r.bin for r in own.values()} and all(sorted(d) == list(range(99)) for d in decoys.values())
    tested = {r.set: r for r in V.against_decoys(got).collect()}
    assert all(tested[f"planted {s}"].p == 0.01 and tested[f"planted {s}"].z > 3 for s in range(4))
    assert all(tested[f"random {s}"].p > 0.01 for s in range(4))


def test_results_dont_depend_on_partitions_and_decoys_come_from_the_pool(spark, units):
    features, sets = units
    few = sets.where("set like 'planted%'")
    pool = spark.createDataFrame([(i,) for i in range(300, 400)], "feature long")
    run = lambda parts: sorted(tuple(map(str, (r.set, r.draw, r.covered, np.round(r.vec, 9).tolist()))) for r in V.set_vectors(features.repartition(parts), few.repartition(parts), pool, decoys=3, epochs=3).collect())
    assert run(1) == run(5)
    drawn = V._decoys(spark.createDataFrame([(8,), (500,)], "bin long"), pool, 4, 1).groupBy("set").count().collect()
    assert sorted(r["count"] for r in drawn) == [8] * 4 + [100] * 4  # never more than the pool holds


def test_training_turns_to_the_members(spark):
    rng = np.random.default_rng(1)
    members, others = rng.normal(size=(30, 8)) + 2 * np.eye(8)[0], rng.normal(size=(500, 8))
    u = V.train(members, others, rng)
    assert u[0] / np.linalg.norm(u) > 0.9 and (members @ u).mean() > (others @ u).mean() + 1


def test_empty_tables(spark, units):
    features, sets = units
    assert V.set_vectors(features, sets.where("false")).collect() == []
    assert V.against_decoys(V.set_vectors(features.where("false"), sets)).collect() == []
