"""Choosing among rows: maps between groupings, closest nodes, edits, orders, digests of layouts and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.labels import label_key
from lattica.sources.shared import held


def pass_rows(vectors: DataFrame, observations: DataFrame) -> DataFrame:
    """Vectors of the pass's observations (obs, place), in its order; no common observation is an error when run."""
    joined = observations.select("obs", "place").join(vectors, "obs")
    if joined.isEmpty():
        raise ValueError("the embedding has none of the pass's observations")
    return joined


def regroup_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, held, of): the new group that holds most observations of an old one; ties go to the smaller."""
    both = old.where("grp is not null").select("obs", F.col("grp").alias("old")).join(new.where("grp is not null").select("obs", F.col("grp").alias("new")), "obs")
    n = both.groupBy("old", "new").agg(F.count(F.lit(1)).alias("held"))
    by = Window.partitionBy("old")
    ranked = n.withColumn("of", F.sum("held").over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("held"), "new")))
    return ranked.where("_r = 1").drop("_r")


def best_name(scores: DataFrame, k: int) -> DataFrame:
    """(query, term, score, rank): a term scores its nearest name; ties go to the smaller term."""
    best = scores.groupBy("query", "term").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "term")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def closest_ancestor(ancestors: DataFrame, nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """(id, node): of a term's proper ancestors in ``nodes`` (id) the deepest (depths: id, depth from the root); ties go to the smaller id."""
    inside = ancestors.where("id != anc").join(nodes.select(F.col("id").alias("anc")), "anc")
    placed = inside.join(depths.select(F.col("id").alias("anc"), F.col("depth").alias("deep")), "anc")
    by = Window.partitionBy("id").orderBy(F.desc("deep"), "anc")
    return placed.withColumn("_r", F.row_number().over(by)).where("_r = 1").select("id", F.col("anc").alias("node"))


def origins(starts: DataFrame, develops: DataFrame, parents: DataFrame) -> DataFrame:
    """(start, term, inherited): what each start develops from, is_a steps allowed anywhere.

    ``develops`` and ``parents`` are (id, to).  A term counts once a develops step was taken;
    ``inherited`` is whether an is_a step came before the first, false if any way has none.
    States (start, term, inherited, developed) are walked breadth first until none is new.
    """
    steps = develops.select("id", "to", F.lit(True).alias("develop")).unionByName(parents.select("id", "to", F.lit(False).alias("develop")))
    state = ["start", "term", "inherited", "developed"]
    first = starts.select(F.col("id").alias("start"), F.col("id").alias("term"), F.lit(False).alias("inherited"), F.lit(False).alias("developed")).distinct()
    frontier = seen = held(first)
    while True:
        moved = frontier.join(steps, F.col("term") == F.col("id")).select(
            "start", F.col("to").alias("term"), (F.col("inherited") | (~F.col("develop") & ~F.col("developed"))).alias("inherited"), (F.col("developed") | F.col("develop")).alias("developed")
        )
        frontier = held(moved.distinct().join(seen, state, "left_anti"))
        if frontier.isEmpty():
            break
        seen = held(seen.unionByName(frontier))
    return seen.where("developed").groupBy("start", "term").agg(F.min("inherited").alias("inherited"))


def precedences(starts: DataFrame, develops: DataFrame, parents: DataFrame) -> DataFrame:
    """(a, b, source): label a precedes label b, from ``origins`` between labelled terms (label, id); no label precedes itself."""
    reached = origins(starts.select("id"), develops, parents)
    b = starts.select(F.col("label").alias("b"), F.col("id").alias("start"))
    a = starts.select(F.col("label").alias("a"), F.col("id").alias("term"))
    found = reached.join(b, "start").join(a, "term").where("a != b")
    return found.select("a", "b", F.when(F.col("inherited"), "inherited").otherwise("taxonomy").alias("source"))


def first_parents(edges: DataFrame) -> DataFrame:
    """(id, chain): a term's line of first-listed parents, from itself to the top; edges are (child, parent, place), and a cycle of them is an error."""
    first = held(edges.groupBy("child").agg(F.min_by("parent", "place").alias("parent")))
    ids = first.select(F.col("child").alias("id")).unionByName(first.select(F.col("parent").alias("id"))).distinct()
    lines = held(ids.select("id", F.array("id").alias("chain")))
    # Chains double: each is continued by the whole chain of its end.
    while True:
        tails = lines.select(F.col("id").alias("_end"), F.col("chain").alias("_tail"))
        up = first.select(F.col("child").alias("_last"), F.col("parent").alias("_end"))
        longer = lines.withColumn("_last", F.element_at("chain", -1)).join(up, "_last").join(tails, "_end")
        grown = held(longer.select("id", F.concat("chain", "_tail").alias("chain")))
        if grown.isEmpty():
            return lines
        ring = grown.where(F.size(F.array_distinct("chain")) < F.size("chain")).select(F.min("id")).first()[0]
        if ring is not None:
            raise ValueError(f"the parents of {ring} lead into a cycle")
        lines = held(grown.unionByName(lines.join(grown.select("id"), "id", "left_anti")))


def level_rows(profile: DataFrame, level: DataFrame) -> DataFrame:
    """(grp, mean, total, epsilon): mean over the level's rows, total over all, and the mean of all cells of the table as epsilon."""
    marked = profile.join(level.select("feature", F.lit(True).alias("inside")), "feature", "left")
    per = marked.groupBy("grp").agg(F.avg(F.when(F.col("inside"), F.col("value"))).alias("mean"), F.sum("value").alias("total"))
    return per.crossJoin(profile.agg(F.avg("value").alias("epsilon")))  # one row


def membership_means(membership: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, class, mean, z): mean membership of a group's observations and its z-score over the groups of a class (population deviation; 0 where that is 0).

    ``membership`` is (obs, class, weight); an absent row weighs nothing.
    """
    sizes = groups.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sums = membership.join(groups.where("grp is not null"), "obs").groupBy("grp", "class").agg(F.sum("weight").alias("w"))
    all_cells = sizes.crossJoin(membership.select("class").distinct())  # groups by classes, both of the model
    mean = all_cells.join(sums, ["grp", "class"], "left").select("grp", "class", (F.coalesce("w", F.lit(0.0)) / F.col("n")).alias("mean"))
    by = Window.partitionBy("class")
    spread = F.stddev_pop("mean").over(by)
    return mean.withColumn("z", F.when(spread > 0, (F.col("mean") - F.avg("mean").over(by)) / spread).otherwise(0.0))


def theta_sums(latent: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, topic, theta): a group's summed topic weights; latent is (obs, topic, theta)."""
    return latent.join(groups.where("grp is not null"), "obs").groupBy("grp", "topic").agg(F.sum("theta").alias("theta"))


def decoder_expectation(beta: DataFrame, latent: DataFrame, groups: DataFrame, scale: float = 1e4) -> DataFrame:
    """(grp, feature, value): beta (topic, feature, beta) times the group's theta sums, by ``scale``."""
    return theta_sums(latent, groups).join(beta, "topic").groupBy("grp", "feature").agg((scale * F.sum(F.col("beta") * F.col("theta"))).alias("value"))


def spaced(groups: DataFrame, most: int = 1000) -> DataFrame:
    """Evenly spaced observations of each group, ``most`` at most, in order of obs: those at floor(i n / take)."""
    by = Window.partitionBy("grp")
    placed = groups.where("grp is not null").withColumn("n", F.count(F.lit(1)).over(by)).withColumn("at", F.row_number().over(by.orderBy("obs")) - 1)
    take = F.least(F.col("n"), F.lit(most))
    i = F.ceil(F.col("at") * take / F.col("n"))
    return placed.where((i < take) & (F.floor(i * F.col("n") / take) == F.col("at"))).select("obs", "grp")


def anchor_median(layout: DataFrame, weight: str = "weight") -> DataFrame:
    """(grp, x, y): the median place of each group's rows with a positive weight."""
    return layout.where(F.col(weight) > 0).groupBy("grp").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def ring(layout: DataFrame, centre: DataFrame) -> DataFrame:
    """(grp, radius): a region's radius in the layout, radius * RMS(layout distance) / RMS(chord); null without spread."""
    both = layout.join(centre.select("grp", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius"), "grp")
    squared = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))
    sums = both.groupBy("grp").agg(F.sqrt(F.avg(squared)).alias("_l"), F.sqrt(F.avg(F.col("chord") * F.col("chord"))).alias("_c"), F.first("radius").alias("_r"))
    return sums.select("grp", F.when(F.col("_c") > 0, F.col("_r") * F.col("_l") / F.col("_c")).alias("radius"))


def markers_up(panel: DataFrame, folds: DataFrame, least: float = 1.0) -> DataFrame:
    """(grp, class, markers, measured, up): panel features of a class, those in ``folds`` (grp, feature, log2fc), those up."""
    size = panel.groupBy("class").agg(F.countDistinct("feature").alias("markers"))
    seen = folds.join(panel, "feature").groupBy("grp", "class").agg(F.countDistinct("feature").alias("measured"), F.countDistinct(F.when(F.col("log2fc") >= least, F.col("feature"))).alias("up"))
    return seen.join(size, "class").select("grp", "class", "markers", "measured", "up")


def largest_gap(merges: DataFrame) -> DataFrame:
    """(tree, cut): half way in the largest gap between successive heights of a tree's merges; of equal gaps the lowest; null with fewer than two."""
    by = Window.partitionBy("tree").orderBy("height")
    gaps = merges.withColumn("_b", F.lag("height").over(by)).withColumn("_g", F.col("height") - F.col("_b"))
    return gaps.groupBy("tree").agg(F.max_by((F.col("height") + F.col("_b")) / 2, F.struct("_g", -F.col("height"))).alias("cut"))


def label_choices(ranking: DataFrame, top: int = 3) -> DataFrame:
    """(grp, class, firsts, best): classes in any method's ``top``, ordered by first places, the place by score, the best place, the name."""
    seen = ranking.groupBy("grp", "class").agg(F.count_if(F.col("rank") == 1).alias("firsts"), F.min("rank").alias("best"), F.min(F.when(F.col("method") == "score", F.col("rank"))).alias("by_score")).where(F.col("best") <= top)
    by = Window.partitionBy("grp").orderBy(F.desc("firsts"), F.col("by_score").asc_nulls_last(), "best", "class")
    return seen.withColumn("place", F.row_number().over(by)).select("grp", "class", "firsts", "best", "place")


def candidate_listing(ranking: DataFrame, method: str, limit: int = 10) -> DataFrame:
    """(grp, class): the first ``limit`` by one method and every method's first."""
    listed = ranking.where((F.col("method") == method) & (F.col("rank") <= limit))
    return listed.select("grp", "class").unionByName(ranking.where("rank = 1").select("grp", "class")).distinct()


def cluster_order(digest: DataFrame, order: DataFrame) -> DataFrame:
    """(grp, place) by the position of the label in ``order`` (class, position), then label, then group; unplaced labels last."""
    joined = digest.join(order.select(F.col("class").alias("label"), "position"), "label", "left")
    by = Window.orderBy(F.col("position").asc_nulls_last(), F.col("label").asc_nulls_last(), "grp")  # a row a group
    return joined.select("grp", "label", F.row_number().over(by).alias("place"))


def once_each(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_once", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_once = 1").drop("_once")


def edit_markers(panel: DataFrame, edits: DataFrame) -> DataFrame:
    """The panel (feature, class) after edits (line_no, action, label, features), in order of their lines.

    An addition of what is there changes nothing; dropping a pair that isn't there is an error that
    names the decision.  Only edits are ordered, in one window a pair; the panel meets them once.
    """
    one = edits.where("action in ('markers_add', 'markers_drop')").select("line_no", (F.col("action") == "markers_add").alias("add"), label_key("label").alias("class"), F.explode("features").alias("feature"))
    one = one.withColumn("feature", F.trim("feature")).where("feature != '' and class != ''").distinct()
    keyed = panel.select("feature", label_key("class").alias("class")).distinct()
    by = Window.partitionBy("feature", "class").orderBy("line_no", "add")
    before = one.join(keyed.withColumn("there", F.lit(True)), ["feature", "class"], "left").withColumn("had", F.coalesce(F.lag("add").over(by), F.col("there"), F.lit(False)))
    refused = before.where("not add and not had").groupBy("line_no").agg(F.array_join(F.sort_array(F.collect_set("feature")), ", ").alias("names")).orderBy("line_no").limit(1).collect()
    if refused:
        raise ValueError(f"decision {refused[0]['line_no']}: {refused[0]['names']} are no markers of the class")
    final = one.groupBy("feature", "class").agg(F.max_by("add", "line_no").alias("add"))
    kept = keyed.join(final.where("not add"), ["feature", "class"], "left_anti")
    return kept.unionByName(final.where("add").select("feature", "class")).distinct()


def take_added(edits: DataFrame, features: DataFrame, label: str) -> DataFrame:
    """Unsaved additions (class, feature) without ``features`` added to classes other than ``label``: a marker moves."""
    taken = features.select("feature").distinct().withColumn("_taken", F.lit(True))
    return edits.join(taken, "feature", "left").where(F.col("_taken").isNull() | (F.col("class") == label)).select("class", "feature")


def marker_history(edits: DataFrame, round_name: str) -> DataFrame:
    """(class, line_no, round, action, features, rationale, evidence): a class's marker edits, five pieces of evidence each."""
    rows = edits.where("action in ('markers_add', 'markers_drop')")
    features = F.filter(F.transform("features", lambda f: F.trim(f)), lambda f: f != "")
    return rows.select(label_key("label").alias("class"), "line_no", F.lit(round_name).alias("round"), "action", features.alias("features"), "rationale", F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 5).alias("evidence"))


def stale(edits: DataFrame, round_name: str) -> DataFrame:
    """Decisions that name another round than the one edited, with the reason."""
    other = edits.where(F.col("round").isNotNull() & (F.col("round") != round_name))
    return other.select("line_no", F.concat(F.lit("names round "), "round", F.lit(", not "), F.lit(round_name)).alias("reason"))


def region_links(weights: DataFrame) -> DataFrame:
    """(a, b, link): sum over observations of w_a w_b / sqrt(n_a n_b), n the summed weight; weights are (obs, region, weight), a few regions an observation."""
    n = weights.groupBy("region").agg(F.sum("weight").alias("n"))
    left = weights.select("obs", F.col("region").alias("a"), F.col("weight").alias("wa"))
    right = weights.select("obs", F.col("region").alias("b"), F.col("weight").alias("wb"))
    sums = left.join(right, "obs").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    named = sums.join(n.select(F.col("region").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("region").alias("b"), F.col("n").alias("nb")), "b")
    return named.where("na > 0 and nb > 0").select("a", "b", (F.col("s") / F.sqrt(F.col("na") * F.col("nb"))).alias("link"))


def mean_vectors(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec): the mean vector of each key, as partial sums by dimension; null vectors take no part."""
    cells = rows.where(F.col(vec).isNotNull()).select(key, F.posexplode(vec).alias("dim", "x"))
    sums = cells.groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias(vec))  # a vector's own dimensions


def centred_unit(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Vectors less the mean of all, of length one; a vector equal to the mean stays zero."""
    centre = mean_vectors(rows.withColumn("_all", F.lit(1)), "_all", vec).select(F.col(vec).alias("_centre"))
    moved = rows.where(F.col(vec).isNotNull()).crossJoin(F.broadcast(centre)).withColumn("_m", F.zip_with(vec, "_centre", lambda x, c: x - c))  # one row
    length = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda t, x: t + x * x))
    return moved.select(key, F.when(length > 0, F.transform("_m", lambda x: x / length)).otherwise(F.col("_m")).alias(vec))


def level_choice(labels: DataFrame, coarse: DataFrame, roots: DataFrame) -> DataFrame:
    """Fine labels most of whose observations (over half) have a coarse label among ``roots`` (label)."""
    both = labels.select("obs", "label").join(coarse.select("obs", F.col("label").alias("coarse")), "obs", "left")
    marked = both.join(roots.select(F.col("label").alias("coarse"), F.lit(1).alias("root")), "coarse", "left")
    share = marked.where("label is not null").groupBy("label").agg((F.count("root") / F.count(F.lit(1))).alias("share"))
    return share.where("share > 0.5")


def suggested_pair(facts: DataFrame) -> tuple[int, int] | None:
    """Of kept components (component, rho, eta2): the largest |rho| for x, of the others the largest eta2, else |rho|, for y."""
    rows = [r for r in facts.collect() if r["rho"] is not None]  # a row a component
    if len(rows) < 2:
        return None
    x = max(rows, key=lambda r: (abs(r["rho"]), -r["component"]))
    rest = [r for r in rows if r is not x]
    scored = [r for r in rest if r["eta2"] is not None and not math.isnan(r["eta2"])]
    y = max(scored, key=lambda r: (r["eta2"], -r["component"])) if scored else max(rest, key=lambda r: (abs(r["rho"]), -r["component"]))
    return x["component"], y["component"]


def node_mass(ancestors: DataFrame, leaf_mass: DataFrame) -> DataFrame:
    """(grp, id, mass): a node's mass is the summed mass of the leaves at and below it; leaf_mass is (grp, id, mass)."""
    up = ancestors.select("id", "anc").distinct()
    return leaf_mass.join(up, "id").groupBy("grp", F.col("anc").alias("id")).agg(F.sum("mass").alias("mass"))


def walk(edges: DataFrame, roots: DataFrame, mass: DataFrame, least: float = 0.5, tie: float = 1e-9) -> DataFrame:
    """(grp, id, mass, abstained): each group's deepest supported node on the way down from the roots.

    A step goes to the child with the most mass while that is ``least`` or more; where the best two
    children tie the group stays and is marked as abstained.  All groups step together; a group that
    has taken as many steps as there are edges is on a cycle, which is an error.
    """
    left = edges.count()
    at = held(mass.join(roots.select("id"), "id").withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("mass"), "id"))).where("_r = 1").select("grp", "id", "mass", F.lit(False).alias("abstained")))
    done = None
    while True:
        children = edges.select(F.col("parent").alias("id"), F.col("child")).join(at.where("not abstained").select("grp", "id"), "id")
        scored = children.join(mass.select("grp", F.col("id").alias("child"), F.col("mass").alias("m")), ["grp", "child"]).where(F.col("m") >= least)
        by = Window.partitionBy("grp").orderBy(F.desc("m"), "child")
        ranked = scored.withColumn("_r", F.row_number().over(by)).withColumn("_next", F.lead("m").over(by)).where("_r = 1")
        step = held(ranked.select("grp", "child", "m", F.coalesce(F.col("m") - F.col("_next") <= tie, F.lit(False)).alias("tied")))
        rest = at.join(step, "grp", "left")
        stays = rest.where("child is null or tied").select("grp", "id", "mass", F.coalesce("tied", F.lit(False)).alias("abstained"))
        done = held(stays if done is None else done.unionByName(stays))
        at = held(step.where("not tied").select("grp", F.col("child").alias("id"), F.col("m").alias("mass"), F.lit(False).alias("abstained")))
        if at.isEmpty():
            return done
        left -= 1
        if left < 0:
            raise ValueError("the edges hold a cycle")
