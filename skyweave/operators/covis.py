"""Covisibility: which images see the same points, and graph edges made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.keyed import lookup_join
from skyweave.session import materialise


#: A point of more images is cut into blocks of so many, and every pair of blocks meets on its own.
BLOCK_IMAGES = 1_000


def shared_counts(obs: DataFrame, point: str = "point_id", image: str = "image_id", block: int | None = None) -> DataFrame:
    """``i, j, shared`` for i < j: points seen by both images; a point counts once however often it is seen.

    Counts are combined before the shuffle. Missing ids see nothing. A point seen by very many images is not one
    group: its images are dealt to hashed blocks, and the pairs of blocks meet in different tasks.
    """
    block = block or BLOCK_IMAGES
    o = obs.select(F.col(point).alias("p"), F.col(image).alias("m")).filter("p is not null and m is not null").distinct()
    o = materialise(o, "covis")
    sizes = materialise(o.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").filter(F.col("n") > block), "covis-heavy")
    if sizes.isEmpty():
        a, b = o.select("p", F.col("m").alias("i")), o.select("p", F.col("m").alias("j"))
        return a.join(b, "p").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = lookup_join(o, sizes.select("p", blocks.alias("blocks")), "p", "left").select("p", "m", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    mine = mine.withColumn("own", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = mine.select("p", "m", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    a, b = met.select("p", "lo", "hi", F.col("m").alias("i"), F.col("own").alias("oi")), met.select("p", "lo", "hi", F.col("m").alias("j"), F.col("own").alias("oj"))
    # within a pair of different blocks only images of different blocks meet: the others do so in their own block
    pairs = a.join(b, ["p", "lo", "hi"]).filter("i < j and (lo = hi or oi != oj)")
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared"))


def points_per_image(obs: DataFrame, point: str = "point_id", image: str = "image_id") -> DataFrame:
    o = obs.select(F.col(point).alias("p"), F.col(image).alias("m")).filter("p is not null and m is not null").distinct()
    return o.groupBy(F.col("m").alias("image_id")).agg(F.count(F.lit(1)).alias("points"))


def normalise(shared: DataFrame, points: DataFrame, kind: str) -> DataFrame:
    """``i, j, score``: shared, overlap (of the smaller image) or jaccard; 0 where nothing could be shared."""
    if kind not in ("shared", "overlap", "jaccard"):
        raise ValueError(f"unknown score {kind!r}")
    if kind == "shared":
        return shared.select("i", "j", F.col("shared").cast("double").alias("score"))
    n = lambda side: points.select(F.col("image_id").alias(side), F.col("points").alias(f"n_{side}"))
    both = shared.join(n("i"), "i").join(n("j"), "j")
    of = F.least("n_i", "n_j") if kind == "overlap" else F.col("n_i") + F.col("n_j") - F.col("shared")
    return both.select("i", "j", F.when(of > 0, F.col("shared") / of).otherwise(0.0).alias("score"))


def directional(shared: DataFrame, points: DataFrame) -> DataFrame:
    """``src, dst, share``: the part of the source's points that the target sees, both ways."""
    both = shared.select(F.col("i").alias("src"), F.col("j").alias("dst"), "shared").unionByName(shared.select(F.col("j").alias("src"), F.col("i").alias("dst"), "shared"))
    n = points.select(F.col("image_id").alias("src"), "points")
    return both.join(n, "src").select("src", "dst", (F.col("shared") / F.greatest("points", F.lit(1))).alias("share"))


def edges_above(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.filter(F.col("score") >= threshold)
