"""Chains of rounds and the stateful fold: stale bases, two writers, restarts, streams that equal batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lattica.sources import readers
from lattica.streaming import chain as C
from lattica.streaming import fold


def decision(action, clusters, round_=None, **more):
    return {"action": action, "cluster": clusters, "rationale": "seen", "decided_by": "user"} | ({"round": round_} if round_ else {}) | more


def lines(*decisions):
    return "Some prose\n```json\n" + "\n".join(json.dumps(d) for d in decisions) + "\n```\n"


def parsed(spark, *decisions):
    rows = [("d.jsonl", i + 1, json.dumps(d)) for i, d in enumerate(decisions)]
    return readers.parse_decisions(spark.createDataFrame(rows, "file string, line_no long, line string"))


@pytest.fixture
def started(spark, tmp_path):
    cells = spark.createDataFrame([(o, o % 3 + 1, None) for o in range(6)], "obs long, grp int, label string")
    panel = spark.createDataFrame([("a", "T cell"), ("b", "B")], "feature string, class string")
    path = str(tmp_path / "chain")
    C.start(spark, path, cells, panel)
    return path


def cells(spark, path, number=None):
    of = C.latest(spark, path) if number is None else C.read_round(spark, path, number)
    return {(r.obs, r.grp, r.label) for r in C.load(spark, path, of)["cells"].collect()}


def test_rounds_keep_cells_panel_history_and_log(spark, started):
    C.relabel(spark, started, parsed(spark, decision("label", "K1", label="A"), decision("markers_add", [], label="T cell", features=["c"], evidence=[{"x": 1}, "y"])), base=0)
    C.relabel(spark, started, parsed(spark, decision("merge", [1, "C2"], "r1", label="M"), decision("markers_drop", [], label="B", features=["b"])))
    assert C.numbers(spark, started) == [0, 1, 2]
    assert cells(spark, started) == {(0, 4, "M"), (1, 4, "M"), (3, 4, "M"), (4, 4, "M"), (2, 3, None), (5, 3, None)}
    assert cells(spark, started, 1) == {(o, o % 3 + 1, "A" if o % 3 == 0 else None) for o in range(6)}
    tables = C.load(spark, started, C.latest(spark, started))
    assert {tuple(r) for r in tables["panel"].collect()} == {("a", "T_cell"), ("c", "T_cell")}
    history = {(r.grp, r.round, r.action, tuple(r.merged_from or ()), r.merged_into) for r in tables["history"].collect()}
    assert history == {(1, 1, "label", (), None), (1, 2, "merge", (), 4), (2, 2, "merge", (), 4), (4, 2, "merge", (1, 2), None)}
    assert [(r["class"], r.round, r.features) for r in tables["markers"].orderBy("round").collect()] == [("T_cell", "r1", ["c"]), ("B", "r2", ["b"])]
    assert all(r.timestamp and r.decided_by == "user" for r in tables["log"].collect())
    third = C.relabel(spark, started, parsed(spark, decision("merge", [3, 4])))  # an id that no round has used
    assert {g for _, g, _ in cells(spark, started, third.number)} == {5}


def test_stale_bases_and_broken_rules_leave_the_chain_alone(spark, started):
    C.relabel(spark, started, parsed(spark, decision("label", 1, label="A")))
    with pytest.raises(C.Stale):
        C.relabel(spark, started, parsed(spark, decision("label", 2, label="B")), base=0)
    for bad, says in (
        (decision("label", 2, "r0", label="B"), "names round r0"), (decision("label", 9, label="B"), "no such group"), (decision("label", 2), "a label"),
        (decision("markers_drop", [], label="B", features=["zz"]), "zz are no markers"), (decision("keep", 2) | {"rationale": " "}, "no rationale"),
    ):
        with pytest.raises(C.Refused, match=says):
            C.relabel(spark, started, parsed(spark, bad))
    with pytest.raises(C.Refused, match="names no round"):
        C.relabel(spark, started, parsed(spark, decision("label", 2, label="B")), must_name=True)
    assert C.numbers(spark, started) == [0, 1]


def test_of_two_writers_one_wins(spark, started):
    first = C._attempt(spark, started, {})
    second = C._attempt(spark, started, {})
    C.publish(spark, started, C.Round(1, first, 0))
    with pytest.raises(C.Stale):
        C.publish(spark, started, C.Round(1, second, 0))
    assert C.latest(spark, started).attempt == first


def test_the_file_is_created_once_even_if_both_saw_the_same_base(spark, started, monkeypatch):
    monkeypatch.setattr(C, "numbers", lambda spark, chain: [0])  # both listed before either wrote
    C.publish(spark, started, C.Round(1, "x", 0))
    with pytest.raises(C.Stale, match="another writer"):
        C.publish(spark, started, C.Round(1, "y", 0))
    assert C.read_round(spark, started, 1).attempt == "x"


def test_going_on_from_an_older_round(spark, started):
    for label in ("A", "B"):
        C.relabel(spark, started, parsed(spark, decision("label", 1, label=label)))
    assert C.supersede(spark, started, 1) == 1 and C.latest(spark, started).number == 1
    C.relabel(spark, started, parsed(spark, decision("label", 1, "r1", label="C")))
    assert {lab for _, g, lab in cells(spark, started) if g == 1} == {"C"} and C.supersede(spark, started, 2) == 0


def put(folder, name, text, at):
    path = folder / name
    path.write_text(text)
    os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))


def test_a_watched_stream_equals_the_batch_and_survives_restarts(spark, started, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "ck")
    source.mkdir()
    good = [decision("label", 1, "r0", label="A"), decision("markers_add", [], "r0", label="T cell", features=["c"])]
    put(source, "0.jsonl", lines(*good), 0)
    put(source, "1.jsonl", lines(decision("label", 2, "r0", label="B")), 1)  # r1 is the latest by then
    put(source, "2.jsonl", lines(decision("label", 2, label="B")), 2)
    put(source, "3.jsonl", '{"action": \n', 3)
    C.watch(spark, str(source), started, checkpoint).awaitTermination()
    assert C.numbers(spark, started) == [0, 1]
    put(source, "4.jsonl", lines(decision("merge", [1, 2], "r1", label="M")), 4)
    C.watch(spark, str(source), started, checkpoint).awaitTermination()  # after a restart
    assert C.numbers(spark, started) == [0, 1, 2] and C.latest(spark, started).batch == 4
    told = {r.batch: r.reason for r in C.refused(spark, started).collect()}
    assert set(told) == {1, 2, 3} and "r0" in told[1] and "names no round" in told[2] and "not JSON" in told[3]
    batch = str(tmp_path / "batch")
    first = C.load(spark, started, C.read_round(spark, started, 0))
    C.start(spark, batch, first["cells"], first["panel"])
    C.relabel(spark, batch, parsed(spark, *good))
    C.relabel(spark, batch, parsed(spark, decision("merge", [1, 2], "r1", label="M")))
    for name, of in C.load(spark, started, C.latest(spark, started)).items():
        drop = ("line_no", "timestamp")
        ours, theirs = (sorted(map(str, df.drop(*drop).collect())) for df in (of, C.load(spark, batch, C.latest(spark, batch))[name]))
        assert ours == theirs


def entries():
    """Entries of 5 groups over 12 rounds, a group of which has most."""
    out = []
    for r in range(12):
        for line, g in enumerate([1, 1, r % 5, 1, (r * 3) % 5]):
            out.append((g, r, line, "label" if (r + line) % 3 else "keep", f"L{r}.{line}" if (r + line) % 3 else None))
    return out


def test_the_fold_of_a_stream_equals_that_of_a_batch_after_a_restart(spark, tmp_path):
    schema = "grp int, round int, line long, action string, label string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", fold.PROVIDER)
    try:
        for low, high in ((0, 5), (5, 9), (9, 12)):  # a run each: the state comes back from the checkpoint
            spark.createDataFrame([e for e in entries() if low <= e[1] < high], schema).coalesce(1).write.mode("append").parquet(source)
            stream = fold.folded(spark.readStream.schema(schema).parquet(source))
            keep = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
            stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    key = lambda df: sorted(str(tuple(r)) for r in df.select("grp", "round", "line", "label", "before", "entries").collect())
    batch = fold.folded(spark.createDataFrame(entries() + [(None, 1, 1, "keep", "x")], schema).repartition(3))
    assert key(spark.read.parquet(out)) == key(batch)
    now = {r.grp: (r.label, r.entries) for r in fold.current(batch).collect()}
    for g in range(5):
        own = [e for e in entries() if e[0] == g]
        assert now[g] == ([e[4] for e in own if e[4]][-1], len(own))
