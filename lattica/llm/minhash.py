"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Words (ASCII letters in lower case) give the set of five-word shingles, each a 64-bit
   hash; the ``SKETCH`` least values of a set are its bottom-k sketch.  Documents with equal
   sets collapse into one node.
2. Inverted lists of retained values generate overlaps.  Two sets of the wanted similarity
   share at least ``LEAST_SHARED`` of the values that the sketch of their union retains
   (a share of 3/4 is expected of 64; fewer than 24 has a chance below 1e-9).  So a node
   enters the lists of its rarest values only, as many as leave out at most
   ``LEAST_SHARED`` - 1: values that a passage spreads over many documents come last and
   make no lists.  Sets too small for that use the exact bound on set overlap instead.
3. No list emits all its pairs.  Each list's most central node, its hub, meets the others
   through the union-sketch filter and the exact check, and components form.  Lists whose
   nodes then have one component are done; of the others the shortest emit their pairs (up to
   ``PAIRED`` nodes, or as long as all of these together hold no more pairs than ``PAIRED``
   for every node), and longer ones are divided by what sets their nodes apart from the hub
   (see ``_apart``: two nodes can be linked without both being linked to the hub only if they
   share a shingle outside the hub, or lack a common one of it).  The parts are lists again,
   without the hub, until none is left.  So no link between different components is missed,
   whatever the size of a group.
4. Components form by hooking to the least neighbour and pointer jumping over tables in the
   shared folder; nothing is gathered on the driver.

Defined cases: texts without words have no shingle, link with nothing and are kept; with
fewer than five words the whole sequence is the one shingle; null texts are as empty; rows
that share an identifier each have their own set, and the identifier's smallest component is
reported for each row's set; rows without an identifier lead no component (theirs is the
smallest identifier reachable, or null) and are kept if they reach none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.llm.common import Memo, durable, release, worker_kept

WORDS, SKETCH, LEAST_SHARED = 5, 64, 24
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Lists up to this length emit their pairs; longer ones are divided around a hub.
PAIRED = 12
#: Up to this level parts of different lists with one hub are joined; beyond, every part is
#: smaller than the list it comes from, so that division ends.
JOINED_LEVELS = 3
#: A hub's set is copied once for so many nodes that meet it.
SPREAD = 4_096
#: Words of 64 bits, at most, of the filter that tells texts which may be needed from all others.
FILTER_WORDS = 1 << 20

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 300_000)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(worker_kept(_word_hashes).__getitem__, words), np.uint64, n)
    width = min(WORDS, n)
    mixed = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ own[k : n - width + 1 + k]) * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint64(32)
    mixed *= _MULTIPLIERS[0]
    return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sets, sketches = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            sizes.append(len(s))
            sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(s[:SKETCH].copy())  # a view would keep the whole set
        ends = np.cumsum([0, *map(len, sketches)])
        flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
            names=["doc_id", "n_shingles", "set_id", "sketch"],
        )


def sketch(documents: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, set_id (digest of the full set), sketch."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(_sketch_batches, f"doc_id {id_type}, n_shingles long, set_id binary, sketch array<long>")


def _digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(shingles(text).tobytes())


@F.pandas_udf(T.BinaryType())
def _full_set(texts: pd.Series) -> pd.Series:
    """A text's whole shingle set, sorted, as packed 64-bit integers."""
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


@F.pandas_udf(T.BinaryType())
def _set_id(sets: pd.Series) -> pd.Series:
    return pd.Series([xxhash.xxh3_128_digest(s) for s in sets], dtype=object)


def _possible(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among ``keys``: all that are, and few others (a Bloom filter of one hash).

    The filter is broadcast, at most ``FILTER_WORDS`` rows of it whatever the input, so that a join after it
    shuffles the rows it needs and not the whole table.
    """
    code = F.xxhash64(key)
    word = F.pmod(code, F.lit(FILTER_WORDS)).alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(code, 58).cast("int"))
    words = keys.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.select("*", word).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _sets(wanted: DataFrame, base: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, one for each set; rows that share an identifier are told apart by their sets."""
    leads = wanted.where("lead is not null").select("lead").distinct()
    named = _possible(base, leads, "lead").unionByName(base.where("lead is null"))
    found = durable(named.select(_full_set("text").alias("shingles")).withColumn("set_id", _set_id("shingles")))
    sets = durable(found.dropDuplicates(["set_id"]).join(wanted.select("set_id", "node"), "set_id").select("node", "shingles"))
    release(found)
    return sets


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two full sets are similar enough."""
    out = []
    for x, y in zip(a, b):
        left, right = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
        both = _shared(left, right)
        out.append(100 * both >= PERCENT * (len(left) + len(right) - both))
    return pd.Series(out, dtype=bool)


def _shared(left: np.ndarray, right: np.ndarray) -> int:
    merged = np.sort(np.concatenate([left, right]), kind="stable")
    return int(np.count_nonzero(merged[1:] == merged[:-1]))


def _with_sides(pairs: DataFrame, sides: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with ``columns`` of both nodes, suffixed _a and _b.

    ``b`` occurs in a bounded number of pairs; ``a`` may be a hub of very many, so its row is
    copied once for every ``SPREAD`` of them.
    """
    b = sides.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    a = sides.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    copies = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(1) / {SPREAD}) as int)").alias("copies"))
    hubs = a.join(copies, "a").withColumn("salt", F.explode(F.expr("sequence(0, copies - 1)"))).drop("copies")
    salted = pairs.join(copies, "a").withColumn("salt", F.expr("cast(pmod(xxhash64(b), copies) as int)")).drop("copies")
    return salted.join(b, "b").join(hubs, ["a", "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return _with_sides(pairs, sets, ["shingles"]).where(_similar("shingles_a", "shingles_b")).select("a", "b")


def _may_link() -> F.Column:
    """Union-sketch filter on the sketches and sizes of a and b."""
    na, nb, sa, sb = "n_shingles_a", "n_shingles_b", "sketch_a", "sketch_b"
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(sa, sb), union))
    sizes = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    exact = 100 * F.size(F.array_intersect(sa, sb)) >= PERCENT * F.size(F.array_union(sa, sb))
    return F.when(F.greatest(na, nb) <= SKETCH, exact).otherwise(sizes & (shared >= LEAST_SHARED))


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) with labels made equal, to the least, over edges (a, b) between labels."""
    links = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if links.isEmpty():
        return labels
    found = None  # (label, to): where labels lead
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("label"), F.least("a", "to").alias("to"))
        step = durable(step)
        while True:  # pointer jumping: every label to its root
            ahead = step.select(F.col("label").alias("to"), F.col("to").alias("further"))
            jumped = durable(step.join(ahead, "to", "left").select("label", F.coalesce("further", "to").alias("to"), (F.coalesce("further", "to") != F.col("to")).alias("moved")))
            step = jumped.select("label", "to")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = step
        else:
            ahead = step.select(F.col("label").alias("to"), F.col("to").alias("further"))
            found = durable(found.join(ahead, "to", "left").select("label", F.coalesce("further", "to").alias("to")))
        a, b = (step.select(F.col("label").alias(x), F.col("to").alias(f"_{x}")) for x in "ab")
        links = durable(links.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct())
    return durable(labels.join(found, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _lists(nodes: DataFrame) -> DataFrame:
    """(key, node, held, weight): the inverted lists that nodes enter, of ``held`` nodes, two or more.

    ``weight`` is how common a node's retained values are: the higher, the more central.
    """
    sizes = nodes.select("node", "n_shingles", F.size("sketch").alias("retained"))
    retained = nodes.select("node", F.explode("sketch").alias("value"))
    counts = retained.groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = retained.join(counts, "value")
    large = F.col("n_shingles") > int(SKETCH * PERCENT / 100)
    enters = F.when(large, F.col("retained") - (LEAST_SHARED - 1)).otherwise(F.col("n_shingles") - F.ceil(F.col("n_shingles") * F.lit(PERCENT) / 100) + 1)
    alone = F.col("retained") - F.size("held")
    mine = (
        shared.groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("held"))  # at most a sketch
        .join(sizes, "node")
        .withColumn("most", (enters - alone).cast("int"))
        .withColumn("weight", F.aggregate("held", F.lit(0.0), lambda t, h: t + F.log(h["held"])) / F.col("retained"))
        .where("most > 0")
    )
    entered = mine.select("node", "weight", F.explode(F.slice("held", F.lit(1), F.col("most"))).alias("x")).select("node", "weight", F.col("x.value").alias("key"))
    met = entered.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return entered.join(met, "key")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the union-sketch filter."""
    return durable(_with_sides(pairs, nodes, ["n_shingles", "sketch"]).where(_may_link()).select("a", "b"))


def _joined(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after the linked ones of the pairs (a, b) are made equal."""
    pairs = durable(pairs.distinct())
    if pairs.isEmpty():
        return labels
    linked = durable(_verified(_likely(pairs, nodes), sets))
    return labels if linked.isEmpty() else components(_over_labels(linked, labels), labels)


def _hubs(lists: DataFrame) -> DataFrame:
    """Each list's most central node; ties go to the smaller node."""
    return lists.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))


def _live(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists (key, node, weight, outside) with labels and ``held``: those that may hold a link between labels."""
    rows = lists.join(labels, "node")
    state = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("_x"), F.max("label").alias("_y"), F.max("outside").alias("_o"))
    return rows.join(state.where("_x < _y and _o").select("key", "held"), "key")


def _pairable(live: DataFrame, most: int) -> int:
    """The greatest length of lists that, with all shorter ones, hold ``most`` pairs at most; PAIRED at least."""
    by_length = live.groupBy("held").agg((F.count(F.lit(1)) * (F.col("held") - 1) / 2).alias("pairs"))
    running = by_length.select("held", F.sum("pairs").over(Window.orderBy("held")).alias("pairs"))  # a row a length
    return max(PAIRED, running.where(F.col("pairs") <= most).agg(F.max("held")).first()[0] or 0)


def _apart(hub: np.ndarray, node: np.ndarray, least: int) -> tuple[bool, np.ndarray, np.ndarray]:
    """What sets a node apart from a hub: (not linked, outside shingles, lacking shingles).

    For nodes A, B and the hub P write a, b for the parts of A, B in P; c is PERCENT /
    (100 + PERCENT), so A and B are linked if they share c (|A| + |B|).  At most min(a, b) of
    that lies in P, so they share t = c (|A| + |B|) - min(a, b) shingles outside P, or t <= 0.
    In the latter case, if A isn't linked to P, that is a < c (|A| + |P|), |B| < |P| follows,
    and A and B lack at least c (|A| + |B|) + |P| - a - b > (1 - c) lack + c outside (those
    of B) common shingles of P.  Both conditions bound from below how many shingles a linked
    pair has in common, so the first ones by hash, that many less one left out, are enough
    (prefix filter).  ``least`` is the size of the smallest set that meets the hub.
    """
    c, whole = PERCENT, 100 + PERCENT  # c / whole is the share; all comparisons in integers
    inside = np.intersect1d(node, hub, assume_unique=True)
    a, n, p = len(inside), len(node), len(hub)
    apart = whole * a < c * (n + p)
    outside = np.setdiff1d(node, inside, assume_unique=True)
    lacking = np.setdiff1d(hub, inside, assume_unique=True)
    smallest = max(least, -(-PERCENT * n // 100))
    shared = max(1, -(-c * (n + smallest) // whole) - a)
    outside = outside[: max(0, len(outside) - shared + 1)]
    take = 0
    if whole * a >= c * (n + least):  # t <= 0 is possible
        if apart:
            take = len(lacking)
        elif n < p:
            take = len(lacking) - ((whole - c) * len(lacking) + c * (n - a)) // whole
    return apart, outside, lacking[:take]


_APART = T.StructType([T.StructField("outside", T.BooleanType()), T.StructField("extra", T.ArrayType(T.LongType())), T.StructField("lacking", T.ArrayType(T.LongType()))])


@F.pandas_udf(_APART)
def _apart_from_hub(hubs: pd.Series, nodes: pd.Series, least: pd.Series) -> pd.DataFrame:
    rows = [_apart(np.frombuffer(h, np.int64), np.frombuffer(n, np.int64), int(m)) for h, n, m in zip(hubs, nodes, least)]
    return pd.DataFrame({"outside": [r[0] for r in rows], "extra": [r[1] for r in rows], "lacking": [r[2] for r in rows]}, index=hubs.index)


def _divided(lists: DataFrame, nodes: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Long lists divided by what sets their nodes apart from the hub, as lists of the next level."""
    hub = lists.join(_hubs(lists), "key").where("node != hub")
    origin = F.lit(0).cast("long") if level <= JOINED_LEVELS else F.col("key")
    met = hub.select(F.col("hub").alias("a"), F.col("node").alias("b"), "weight", origin.alias("origin")).distinct()
    sized = durable(met.join(nodes.select(F.col("node").alias("b"), "n_shingles"), "b"))
    least = sized.groupBy("a", "origin").agg(F.min("n_shingles").alias("least"))
    rows = _with_sides(sized.join(least, ["a", "origin"]), sets, ["shingles"])
    told = rows.select("a", "origin", F.col("b").alias("node"), "weight", _apart_from_hub("shingles_a", "shingles_b", "least").alias("x"))
    either = F.concat(*[F.transform(f"x.{c}", lambda v, k=k: F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, c in enumerate(("extra", "lacking"))])
    shared = told.select("a", "origin", "node", "weight", F.col("x.outside").alias("outside"), F.explode(either).alias("y"))
    keyed = durable(shared.select(F.xxhash64("a", "origin", "y.kind", "y.value").alias("key"), "node", "weight", "outside"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max("outside").alias("_o")).where("held > 1 and _o")
    return keyed.join(often.select("key"), "key").distinct()


def _met(lists: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels after all links between nodes of a common list are joined."""
    first = lists.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("held"), "key"))).where("_n = 1")
    pairs = first.join(_hubs(first), "key").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    labels = _joined(pairs, nodes, sets, labels)
    lists = lists.select("key", "node", "weight", F.lit(True).alias("outside"))
    level, most = 1, PAIRED * labels.count()
    while True:
        live = durable(_live(lists, labels))
        if live.isEmpty():
            return labels
        hubs = _hubs(live).join(labels.select(F.col("node").alias("hub"), F.col("label").alias("of_hub")), "hub")
        to_hub = live.join(hubs, "key").where("label != of_hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        labels = _joined(to_hub, nodes, sets, labels)
        live = durable(_live(lists.join(live.select("key").distinct(), "key"), labels))
        pairable = _pairable(live, most)
        short = live.where(F.col("held") <= pairable)
        other = short.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("outside").alias("ob"))
        pairs = short.join(other, "key").where("node < b and label != lb and (outside or ob)").select(F.col("node").alias("a"), "b")
        labels = _joined(pairs, nodes, sets, labels)
        long = durable(_live(live.where(F.col("held") > pairable).select("key", "node", "weight", "outside"), labels))
        if long.isEmpty():
            return labels
        lists = durable(_divided(long, nodes, sets, level))
        level += 1


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows = durable(sketch(documents))
    sets = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = durable(sets.withColumn("node", F.monotonically_increasing_id()))
    brief = durable(rows.select("doc_id", "n_shingles", "set_id"))
    release(rows)
    lists = durable(_lists(nodes))
    members = durable(lists.select("node").distinct())
    labels = members.select("node", F.col("node").alias("label"))
    # Nodes in lists are the only ones whose sketches and full sets are needed from here on.
    listed = durable(nodes.join(members, "node"))
    names = durable(nodes.select("node", "set_id", "lead"))
    release(nodes)
    wanted = listed.select("node", "set_id", "lead")
    base = documents.select(F.col("doc_id").alias("lead"), F.col("text").cast("string").alias("text"))
    if not members.isEmpty():
        labels = _met(lists, listed.select("node", "n_shingles", "sketch"), _sets(wanted, base), labels)
    leaders = names.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = leaders.groupBy("label").agg(F.min("lead").alias("component_id"))
    of_set = leaders.join(least, "label").select("set_id", "component_id")
    joined = brief.join(of_set, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _over_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes with their labels: na, nb (nodes), la, lb; a and b are the labels."""
    la = labels.select(F.col("node").alias("na"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("nb"), F.col("label").alias("lb"))
    named = pairs.select(F.col("a").alias("na"), F.col("b").alias("nb"))
    return named.join(la, "na").join(lb, "nb").withColumns({"a": F.col("la"), "b": F.col("lb")})
