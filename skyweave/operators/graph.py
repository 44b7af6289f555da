"""Iterative graph operators as join loops.

Each round is written to the shared folder (lineage stays short, a lost executor repeats one round). Joins from edges
to node tables go through :func:`lookup_join`, so hub nodes do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import with_index
from skyweave.session import Growing, forget, materialise, materialise_counted


def both_ways(edges: DataFrame, a: str = "i", b: str = "j", *more: str) -> DataFrame:
    """``src, dst`` and further columns, each edge in both directions."""
    keep = [F.col(c) for c in more]
    there = edges.filter(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"), *keep)
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keep))


def components(edges: DataFrame, a: str = "i", b: str = "j", nodes: DataFrame | None = None, max_rounds: int = 200) -> DataFrame:
    """``node, component``: connected nodes share the smallest id of their component.

    In every round each node hooks onto its smallest neighbour, if that is smaller; the trees that arise are flattened by doubling, and
    the edges are drawn between their roots. Roots and edges get fewer by a factor from round to round. ``nodes`` (column ``node``) adds nodes
    without edges. Edges of a node with itself, or without one of their ends, are left out.
    """
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    left, rows = materialise_counted(known.filter(F.col(a) != F.col(b)).select(F.least(a, b).cast("long").alias("i"), F.greatest(a, b).cast("long").alias("j")).distinct(), "components-edges")
    first, levels = left, []
    while rows:
        if len(levels) == max_rounds:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
        ends = left.select(F.col("i").alias("node"), F.col("i").alias("up")).unionByName(left.select(F.col("j").alias("node"), F.col("i").alias("up")))
        up, n = materialise_counted(ends.groupBy("node").agg(F.min("up").alias("up")), "components-up")
        while True:
            seen = Observation()
            jumped = lookup_join(up, up.select(F.col("node").alias("up"), F.col("up").alias("further")), "up", "inner", n)
            moved = F.coalesce(F.sum((F.col("further") != F.col("up")).cast("long")), F.lit(0))
            after = materialise(jumped.observe(seen, moved.alias("moved")).select("node", F.col("further").alias("up")), "components-up")
            forget(up)
            up = after
            if not seen.get["moved"]:
                break
        levels.append(up)
        drawn = lookup_join(left, up.select(F.col("node").alias("i"), F.col("up").alias("a")), "i", "inner", rows)
        drawn = lookup_join(drawn, up.select(F.col("node").alias("j"), F.col("up").alias("b")), "j", "inner", rows).filter("a != b")
        after, rows = materialise_counted(drawn.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct(), "components-edges")
        if left is not first:
            forget(left)
        left = after
    every = first.select(F.col("i").alias("node")).unionByName(first.select(F.col("j").alias("node")))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col("node").cast("long").alias("node")).filter("node is not null"))
    label = every.distinct().withColumn("component", F.col("node"))
    for up in levels:
        label, n = materialise_counted(label, "components-labels")
        met = lookup_join(label, up.select(F.col("node").alias("component"), "up"), "component", "left", n)
        label = met.select("node", F.coalesce("up", "component").alias("component"))
    return materialise(label, "components-labels")


def component_sizes(labels: DataFrame) -> DataFrame:
    """``component, size``; order by size descending, then component, for the reference order."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def hops(edges: DataFrame, sources: DataFrame, a: str = "i", b: str = "j", max_hops: int | None = None) -> DataFrame:
    """``node, hops``: steps from the nearest of ``sources`` (column ``node``); nodes out of reach are absent.

    The search ends when no new node is met, or after ``max_hops`` steps where the caller gives a bound.
    Edges lead both ways, so a neighbour of a layer lies in it, in the one before or in the next.
    """
    e, rows = materialise_counted(both_ways(edges, a, b).distinct(), "hops-edges")
    layers = Growing(edges.sparkSession, "hops")
    start = sources.select(F.col("node").cast("long").alias("node")).filter("node is not null").distinct().withColumn("hops", F.lit(0))
    layers.append(start)
    k = 0
    while max_hops is None or k < max_hops:
        k += 1
        reached = lookup_join(e, layers.part(-1).select(F.col("node").alias("src")).withColumn("on", F.lit(1)), "src", "inner", rows).select(F.col("dst").alias("node")).distinct()
        known = layers.part(-1).unionByName(layers.part(-2)) if k > 1 else layers.part(-1)
        if not layers.append(reached.join(known.select("node"), "node", "left_anti").withColumn("hops", F.lit(k))):
            break
    return layers.read()


def hop_pairs(edges: DataFrame, sources: DataFrame, a: str = "i", b: str = "j", max_hops: int | None = None) -> DataFrame:
    """``source, node, hops``: steps from every single source to every node that it reaches; all searches run together."""
    e, rows = materialise_counted(both_ways(edges, a, b).distinct(), "hops-edges")
    layers = Growing(edges.sparkSession, "hop-pairs")
    start = sources.select(F.col("node").cast("long").alias("source")).filter("source is not null").distinct()
    layers.append(start.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")))
    k = 0
    while max_hops is None or k < max_hops:
        k += 1
        front = layers.part(-1).select("source", F.col("node").alias("src"))
        reached = front.join(e, "src").select("source", F.col("dst").alias("node")).distinct()
        known = layers.part(-1).unionByName(layers.part(-2)) if k > 1 else layers.part(-1)
        if not layers.append(reached.join(known.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(k))):
            break
    return layers.read()


def balls(edges: DataFrame, sources: DataFrame, size: int, a: str = "i", b: str = "j") -> DataFrame:
    """``source, node, layer, place``: the first ``size`` nodes around every source, layer by layer, the source included (place 0).

    Of a layer the nodes with more links into the ball so far come first, equal ones by smaller id. All balls grow together; a
    ball holds at most ``size`` rows, and a layer is cut to ``size`` rows per ball in every map partition before it is ranked.
    A node of a layer has links into the layer before it only, so just the edges of the last layer of balls that are not yet full are joined.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    e = materialise(both_ways(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b).distinct(), "balls-edges")
    start = sources.select(F.col("node").cast("long").alias("node")).filter("node is not null").distinct()
    seen = Growing(edges.sparkSession, "balls")
    seen.append(start.select(F.col("node").alias("source"), "node", F.lit(0).alias("layer"), F.lit(0).alias("place")))
    for layer in range(1, size):
        held = seen.read().groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("held")).filter(F.col("held") < size)
        front = seen.part(-1).join(held, "source", "left_semi").select("source", F.col("node").alias("src"))
        links = front.join(e, "src").groupBy("source", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("links"))
        links = links.join(seen.read().select("source", "node"), ["source", "node"], "left_anti")
        w = Window.partitionBy("source").orderBy(F.desc("links"), "node")
        ranked = links.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= size)
        ranked = ranked.join(held, "source").filter(F.col("r") <= size - F.col("held"))
        if not seen.append(ranked.select("source", "node", F.lit(layer).alias("layer"), (F.col("held") + F.col("r") - 1).alias("place"))):
            break
    return seen.read()


def max_product_paths(edges: DataFrame, sources: DataFrame, weight: str, a: str = "i", b: str = "j", min_weight: float = 0.2, max_rounds: int = 1000) -> DataFrame:
    """``node, weight, source, parent, hops``: the strongest path from any source, as a product of edge weights in (0, 1].

    Paths below ``min_weight`` are not followed. Only strict improvements replace a path; equal ones of a round
    go by fewer hops, smaller source, smaller parent. Sources have weight 1 and no parent.
    """
    e = materialise(both_ways(edges, a, b, weight).withColumnRenamed(weight, "w").groupBy("src", "dst").agg(F.max("w").alias("w")), "paths-edges")
    rows = e.count()
    start = sources.select(F.col("node").cast("long").alias("node")).filter("node is not null").distinct()
    best = materialise(start.select("node", F.lit(1.0).alias("weight"), F.col("node").alias("source"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")), "paths")
    for _ in range(max_rounds):
        front = best.filter("fresh").select(F.col("node").alias("src"), "weight", "source", "hops")
        offered = lookup_join(e, front, "src", "inner", rows).withColumn("weight", F.col("weight") * F.col("w")).filter(F.col("weight") >= min_weight)
        pick = F.max_by(F.struct("weight", "source", F.col("src").alias("parent"), (F.col("hops") + 1).alias("hops")), F.struct("weight", -F.col("hops"), -F.col("source"), -F.col("src")))
        offers = offered.groupBy(F.col("dst").alias("node")).agg(pick.alias("o"))
        both = best.drop("fresh").join(offers, "node", "full")
        wins = F.col("o").isNotNull() & (F.col("weight").isNull() | (F.col("o.weight") > F.col("weight")))
        merged = both.select("node", *[F.when(wins, F.col(f"o.{c}")).otherwise(F.col(c)).alias(c) for c in ("weight", "source", "parent", "hops")], wins.alias("fresh"))
        after = materialise(merged, "paths")
        forget(best)
        best = after
        if best.filter("fresh").isEmpty():
            return best.drop("fresh")
    raise RuntimeError(f"paths are not settled after {max_rounds} rounds")


def walk_back(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, step, node``: the nodes from the source (step 0) to each target, by following parents. Parents that form a cycle raise an error."""
    parents, longest = materialise_counted(paths.select("node", "parent"), "walk-parents")
    found = Growing(paths.sparkSession, "walk")
    found.append(targets.select(F.col("node").cast("long").alias("node")).distinct().join(paths.select("node", "hops", "parent"), "node").select(F.col("node").alias("target"), F.col("hops").alias("step"), "node", "parent"))
    for _ in range(longest + 1):
        step = found.part(-1).filter("parent is not null").select("target", (F.col("step") - 1).alias("step"), F.col("parent").alias("node"))
        step = materialise(step, "walk-step")
        if not found.append(lookup_join(step, parents, "node", "inner").select("target", "step", "node", "parent")):
            return found.read().select("target", "step", "node")
    raise RuntimeError("the parents form a cycle")


def spanning_forest(edges: DataFrame, weight: str, a: str = "i", b: str = "j") -> DataFrame:
    """``i, j, weight``: the maximum spanning forest; equal weights go by smaller i, then j.

    In every round each component takes its strongest edge to another one, which at least halves the number of components with
    edges to others, so the rounds end; the components that are then joined are relabelled.
    """
    e = materialise(edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).cast("long").alias("i"), F.greatest(a, b).cast("long").alias("j"), F.col(weight).cast("double").alias("w")).groupBy("i", "j").agg(F.max("w").alias("w")), "forest-edges")
    live, n = materialise_counted(e.select("i", "j", "w", F.col("i").alias("ci"), F.col("j").alias("cj")), "forest-live")
    tree = Growing(edges.sparkSession, "forest")
    while True:
        sides = live.select(F.col("ci").alias("c"), "i", "j", "w", "ci", "cj").unionByName(live.select(F.col("cj").alias("c"), "i", "j", "w", "ci", "cj"))
        best = sides.groupBy("c").agg(F.max_by(F.struct("i", "j", "w", "ci", "cj"), F.struct("w", -F.col("i"), -F.col("j"))).alias("e")).select("e.*").distinct()
        if not tree.append(best):
            break
        label = components(tree.part(-1).select("ci", "cj"), "ci", "cj")
        moved = lookup_join(live, label.select(F.col("node").alias("ci"), F.col("component").alias("ni")), "ci", "left", n)
        moved = lookup_join(moved, label.select(F.col("node").alias("cj"), F.col("component").alias("nj")), "cj", "left", n)
        after, n = materialise_counted(moved.select("i", "j", "w", F.coalesce("ni", "ci").alias("ci"), F.coalesce("nj", "cj").alias("cj")).filter("ci != cj"), "forest-live")
        forget(live)
        live = after
    return tree.read().select("i", "j", F.col("w").alias("weight")).distinct()


def rooted(tree: DataFrame, root: int | None) -> DataFrame:
    """``node, parent`` of all nodes but ``root`` in its tree; ``tree`` has ``src, dst``, every edge in both directions and without cycles.

    The directed edges form a tour: after u-v comes v-w, with w the neighbour of v that follows u. From the root's first edge the tour
    ends before it comes again, and every edge learns by doubling how far it is from that end. Of the two directions of an edge the one
    further from the end leads down. The rounds grow with the logarithm of the number of edges, however deep the tree is; tours of other trees have no end and are left out.
    """
    w = Window.partitionBy("src").orderBy("dst")
    after = tree.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.coalesce(F.lead("dst").over(w), F.min("dst").over(Window.partitionBy("src"))).alias("to"), F.lead("dst").over(w).isNull().alias("wraps"))
    stops = F.col("wraps") & F.col("dst").eqNullSafe(F.lit(root).cast("long"))
    # next: the edge from n1 to n2 that is ``far`` steps on, NULL at the end
    state = after.select("src", "dst", F.when(~stops, F.col("dst")).alias("n1"), F.when(~stops, F.col("to")).alias("n2"), F.lit(1).cast("long").alias("far"))
    state, ended = materialise(state, "tour"), 0
    while True:
        done = state.filter("n1 is null")
        target = state.select(F.col("src").alias("n1"), F.col("dst").alias("n2"), F.col("n1").alias("m1"), F.col("n2").alias("m2"), F.col("far").alias("more"))
        moved = state.filter("n1 is not null").join(target, ["n1", "n2"]).select("src", "dst", F.col("m1").alias("n1"), F.col("m2").alias("n2"), (F.col("far") + F.col("more")).alias("far"))
        seen = Observation()
        nxt = materialise(done.unionByName(moved).observe(seen, F.count_if(F.col("n1").isNull()).alias("ended")), "tour")
        forget(state)
        state = nxt
        if seen.get["ended"] == ended:
            break
        ended = seen.get["ended"]
    far = state.filter("n1 is null").select("src", "dst", "far")
    back = far.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("far").alias("back"))
    return far.join(back, ["src", "dst"]).filter(F.col("far") > F.col("back")).select(F.col("dst").alias("node"), F.col("src").alias("parent"))


def place_by_rank(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, NULL last."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def build_tracks(matches: DataFrame, img_a: str, feat_a: str, img_b: str, feat_b: str, min_len: int = 2) -> DataFrame:
    """``track_id, image_id, feat_id``: features linked by matches, as whole tracks.

    A track with fewer than ``min_len`` features, or with two features in one image, is dropped whole.
    ``track_id`` is a number made of its smallest image and feature (which must not be negative).
    """
    code = lambda i, f: F.shiftleft(F.col(i).cast("long"), 32) + F.col(f).cast("long")
    pairs = matches.select(code(img_a, feat_a).alias("i"), code(img_b, feat_b).alias("j")).filter("i is not null and j is not null and i != j").distinct()
    label = materialise(components(pairs), "tracks")
    rows = label.select(F.col("component").alias("track_id"), F.shiftright("node", 32).cast("int").alias("image_id"), F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("feat_id"))
    per_image = rows.groupBy("track_id", "image_id").agg(F.count(F.lit(1)).alias("n"))
    good = per_image.groupBy("track_id").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(f"n >= {min_len} and most = 1")
    return lookup_join(rows, good.select("track_id"), "track_id", "inner")


def farthest_seeds_cover(hop_sets: DataFrame) -> DataFrame:
    """``round, ball, gain``: greedy cover; ``hop_sets`` has ``ball, node``. The ball with most uncovered nodes comes first, smaller id on ties.

    A ball whose gain no ball that shares an uncovered node with it exceeds is taken at once, together with all others of the
    kind: its gain cannot change before the one-by-one choice reaches it. So a round takes many balls and the result is the same.
    """
    left = materialise(hop_sets.select("ball", "node").filter("ball is not null and node is not null").distinct(), "cover")
    taken = Growing(hop_sets.sparkSession, "cover-taken")
    while True:
        gain = materialise(left.groupBy("ball").agg(F.count(F.lit(1)).alias("gain")), "cover-gain")
        rated, rows = materialise_counted(lookup_join(left, gain, "ball", "inner"), "cover-rated")
        best = rated.groupBy("node").agg(F.max_by("ball", F.struct("gain", -F.col("ball"))).alias("best"))
        wins = lookup_join(rated, best, "node", "inner", rows).groupBy("ball").agg(F.max("gain").alias("gain"), F.min(F.col("ball") == F.col("best")).alias("first")).filter("first").select("ball", "gain")
        if not taken.append(wins):
            break
        covered = left.join(taken.part(-1).select("ball"), "ball", "left_semi").select("node").distinct()
        after = materialise(left.join(covered, "node", "left_anti"), "cover")
        forget(left)
        forget(rated)
        left = after
    order = [F.col("gain").desc(), F.col("ball")]
    return with_index(taken.read(), order, "round").select(F.col("round").cast("int").alias("round"), "ball", "gain")
