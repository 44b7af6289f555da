"""Consolidating pairwise matches into groups with alternating large-star and small-star rewrites.

An edge is a row (u, v) with u > v. One round replaces the edges by

* large star: every node x hands its larger neighbours to the smallest node m(x) next to it, itself
  included: (u, v) becomes (u, m(v));
* small star: every node u hands its smaller neighbours, and itself, to the smallest of them: (u, v)
  becomes (v, m(u)), and (u, m(u)) is added.

Connectivity is kept by both. The edges no longer change once they are stars: then every node points at the
smallest node of its component. Each half of a round is written to the shared folder, so lineage stays short and
a lost executor repeats at most half a round; edges are counted while they are written. Groups that are finished are
set apart as soon as most edges stay as they were, so the later rounds work on long chains only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skyweave.operators import keyed
from skyweave.session import forget, materialise


def _written(edges: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """The written edges, with their number and further sums taken while they are written."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in sums.items()])
    return materialise(counted, label), seen.get


def _meet(edges: DataFrame, nodes: DataFrame, key: str, heavy: int) -> DataFrame:
    """``edges`` with ``m`` of the node in column ``key`` (NULL where it has none).

    ``nodes`` is written and has ``node, m, n``, where n counts the edges that ask for the node. Those of more than
    ``heavy`` edges are, by counting, at most keyed.HEAVY_KEYS and are broadcast; the others meet in a shuffle without a large key.
    """
    small = nodes.select(F.col("node").alias(key), "m")
    hubs = nodes.filter(F.col("n") > heavy).select(F.col("node").alias(key), F.col("m").alias("hub_m"), F.lit(True).alias("hub"))
    if hubs.isEmpty():
        return edges.join(small, key, "left")
    marked = edges.join(F.broadcast(hubs), key, "left")
    light = marked.filter("hub is null").select("u", "v").join(small, key, "left")
    return light.select("u", "v", "m").unionByName(marked.filter("hub").select("u", "v", F.col("hub_m").alias("m")))


def _large_star(edges: DataFrame, heavy: int) -> DataFrame:
    """``u, v, moved``; one aggregate finds every node's smallest lower neighbour and how many edges ask for it."""
    asked = edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("low"), F.lit(1).alias("one"))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("low"), F.lit(0).alias("one")).unionByName(asked)
    nodes = nodes.groupBy("node").agg(F.min("low").alias("m"), F.sum("one").alias("n")).filter("m is not null")
    nodes = materialise(nodes, "groups-lowest")
    return _meet(edges, nodes, "v", heavy).select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))


def _small_star(edges: DataFrame, heavy: int) -> DataFrame:
    nodes = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "groups-lowest")
    joined = _meet(edges, nodes, "u", heavy)
    moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(nodes.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()


def _set_apart(edges: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """The edges of finished groups, and those of all others.

    A group is finished if its smallest node has no lower neighbour and every other node of it has one edge only.
    """
    asked = edges.select(F.col("v").alias("node"), F.lit(0).alias("lower"), F.lit(1).alias("one"))
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("one")).unionByName(asked)
    nodes = materialise(nodes.groupBy("node").agg(F.sum("lower").alias("lower"), F.sum("one").alias("n")), "groups-degrees")
    # m says that a node is a leaf; only nodes with an edge downwards can be
    leaves = nodes.filter("lower = 1 and n = 0").select("node", F.lit(1).cast("long").alias("m"), F.lit(0).alias("n"))
    judged = edges.join(leaves.select(F.col("node").alias("u"), "m"), "u", "left").filter("m is null").select("v")
    open_ = judged.unionByName(nodes.filter("lower > 0 and n > 0").select(F.col("node").alias("v"))).distinct()
    asks = nodes.select("node", "n").join(open_.select(F.col("v").alias("node"), F.lit(1).cast("long").alias("m")), "node")
    met = materialise(_meet(edges, materialise(asks, "groups-open"), "v", heavy), "groups-split")
    return met.filter("m is null").select("u", "v"), met.filter("m is not null").select("u", "v")


def connected_groups(pairs: DataFrame, a: str, b: str, *, max_rounds: int = 100) -> DataFrame:
    """One group identifier for all records that are linked directly or through others.

    Returns ``node, component`` (BIGINT): every value of ``a`` or ``b`` once, with the smallest value of
    its component. ``a`` and ``b`` are integers. A pair with a NULL side links nothing and is left out; a
    pair of a record with itself makes the record known without linking it; repeated and reversed pairs
    count once; empty input gives an empty result. More than ``max_rounds`` rounds (never seen: rounds
    grow with the logarithm of the longest chain) raise an error instead of returning unfinished groups.
    """
    sides = pairs.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).filter("x is not null and y is not null")
    ordered = materialise(sides.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "groups-pairs")
    alone = ordered.filter("u = v").select("u")
    edges, held = _written(ordered.filter("u != v"), "groups-edges")
    done = held["rows"] == 0
    finished = edges.limit(0)
    for _ in range(max_rounds if not done else 0):
        heavy = max(keyed.HEAVY_ROWS, held["rows"] // keyed.HEAVY_KEYS)
        large, seen = _written(_large_star(edges, heavy), "groups-large", moved=F.col("moved"))
        # stars: no smaller end has a smaller neighbour itself, and every larger end has one edge
        done = not seen["moved"] and edges.select("u").distinct().count() == held["rows"]
        if done:
            break
        small, held = _written(_small_star(large.select("u", "v"), heavy), "groups-small")
        forget(large)
        forget(edges)
        edges = small
        if 2 * seen["moved"] < seen["rows"]:
            # most edges stayed as they were: groups that are finished leave the rounds
            apart, rest = _set_apart(edges, heavy)
            finished = finished.unionByName(apart)
            edges, held = _written(rest, "groups-edges")
            done = held["rows"] == 0
            if done:
                break
    if not done:
        raise RuntimeError(f"groups are not settled after {max_rounds} rounds")
    edges = edges.unionByName(finished)
    linked = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    only = alone.join(edges.select("u"), "u", "left_anti").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
    return linked.unionByName(only.select(F.col("u").alias("node"), F.col("u").alias("component")))
