"""Operators over per-pixel tables of a batch: masks, reprojection, depth ratios, robust regression, attention pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.pose import add, project, rotate_back
from skyweave.operators.estimators import _batched
from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import grouped_quantile
from skyweave.session import forget, materialise


def valid_pixels(pixels: DataFrame, image: str = "image", conf: str = "conf", depth: str = "depth", q: float = 0.3) -> DataFrame:
    """Pixels with a confidence of at least the image's q-quantile and a positive depth."""
    cut = grouped_quantile(pixels, image, conf, q, "__cut")
    return lookup_join(pixels, cut, image, "inner").filter((F.col(conf) >= F.col("__cut")) & (F.col(depth) > 0)).drop("__cut")


def reprojection_overlap(pixels: DataFrame, cameras: DataFrame, width: int, height: int, tolerance: float = 0.05) -> DataFrame:
    """``batch, src, dst, share``: the part of a source image's valid pixels that another image of the batch sees at about the same depth.

    ``pixels`` has ``batch, image, px, py, depth`` (valid ones only); ``cameras`` has ``batch, image, r, t, fx, fy, cx, cy``. A pixel is
    lifted at its centre, projected into the targets of its batch, and looked up at the rounded place (half to even);
    0 <= u <= width - 1 and 0 <= v <= height - 1, both closed. Batches are small by design; pixels meet targets in an equi-join on the batch.
    """
    c = cameras.select("batch", "image", "r", "t", "fx", "fy", "cx", "cy")
    own = pixels.join(c, ["batch", "image"])
    ray = F.array((F.col("px") + 0.5 - F.col("cx")) / F.col("fx") * F.col("depth"), (F.col("py") + 0.5 - F.col("cy")) / F.col("fy") * F.col("depth"), F.col("depth"))
    world = own.select("batch", F.col("image").alias("src"), rotate_back(F.col("r"), add(ray, F.col("t"), -1)).alias("x"))
    valid = world.groupBy("batch", "src").agg(F.count(F.lit(1)).alias("valid"))
    target = c.withColumnRenamed("image", "dst")
    met = world.join(target, "batch").filter("src != dst")
    met = met.select("batch", "src", "dst", project(F.col("r"), F.col("t"), F.col("x"), F.col("fx"), F.col("fy"), F.col("cx") - 0.5, F.col("cy") - 0.5).alias("p"))
    met = met.filter((F.col("p.u") >= 0) & (F.col("p.u") <= width - 1) & (F.col("p.v") >= 0) & (F.col("p.v") <= height - 1))
    met = met.select("batch", "src", "dst", F.bround("p.u").cast("int").alias("px"), F.bround("p.v").cast("int").alias("py"), F.col("p.z").alias("z"))
    there = pixels.select("batch", F.col("image").alias("dst"), "px", "py", F.col("depth").alias("d"))
    hits = met.join(there, ["batch", "dst", "px", "py"]).filter(F.abs(F.col("z") - F.col("d")) <= tolerance * F.col("d"))
    counted = hits.groupBy("batch", "src", "dst").agg(F.count(F.lit(1)).alias("hits"))
    pairs = c.select("batch", F.col("image").alias("src")).join(c.select("batch", F.col("image").alias("dst")), "batch").filter("src != dst")
    out = pairs.join(counted, ["batch", "src", "dst"], "left").join(valid, ["batch", "src"], "left")
    return out.select("batch", "src", "dst", (F.coalesce("hits", F.lit(0)) / F.greatest(F.coalesce("valid", F.lit(0)), F.lit(1))).alias("share"))


def log_depth_ratios(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image", "px", "py"), least: int = 50) -> DataFrame:
    """``image, n, median, spread``: log ratio of two depths at common pixels; images with at most ``least`` of them are dropped.

    ``spread`` is 1.4826 times the median absolute deviation.
    """
    both = a.select(*keys, F.col("depth").alias("da")).join(b.select(*keys, F.col("depth").alias("db")), list(keys)).filter("da > 0 and db > 0")
    ratio = materialise(both.select(F.col(keys[0]).alias("image"), F.log(F.col("da") / F.col("db")).alias("v")), "depth-ratios")
    enough = ratio.groupBy("image").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    middle = materialise(grouped_quantile(ratio, "image", "v", 0.5, "median"), "depth-median")
    off = lookup_join(ratio, middle, "image", "inner").select("image", F.abs(F.col("v") - F.col("median")).alias("d"))
    spread = grouped_quantile(off, "image", "d", 0.5, "mad")
    return enough.join(middle, "image").join(spread, "image").select("image", "n", "median", (1.4826 * F.col("mad")).alias("spread"))


def robust_regression(df: DataFrame, group: str, target: Column, features: Sequence[Column], rounds: int = 8, scale: float = 1.345) -> DataFrame:
    """``group, n, b0..bk, sigma``: y on the features (add a constant yourself) by reweighted least squares with Huber weights.

    Each round sends one set of sums per group; the residual scale is 1.4826 times the median absolute residual.
    """
    import numpy as np

    k = len(features)
    rows = materialise(df.select(F.col(group).alias("g"), target.cast("double").alias("y"), *[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)]).dropna(subset=["y", *[f"f{i}" for i in range(k)]]), "regression")
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    weighted = rows.withColumn("w", F.lit(1.0))
    found = None
    for step in range(rounds):
        sums = weighted.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.col("w") * F.col(f"f{i}") * F.col(f"f{j}")).alias(f"h{i}_{j}") for i, j in upper], *[F.sum(F.col("w") * F.col(f"f{i}") * F.col("y")).alias(f"m{i}") for i in range(k)])

        def solve(x: np.ndarray) -> np.ndarray:
            h = np.zeros((len(x), k, k))
            for at, (i, j) in enumerate(upper):
                h[:, i, j] = h[:, j, i] = x[:, 1 + at]
            d = np.arange(k)
            h[:, d, d] += 1e-12 * (1 + h[:, d, d])
            return np.column_stack([x[:, 0], np.linalg.solve(h, x[:, 1 + len(upper) :, None])[:, :, 0]])

        new = materialise(_batched(sums, ["g"], ["n", *[f"h{i}_{j}" for i, j in upper], *[f"m{i}" for i in range(k)]], ["n", *[f"b{i}" for i in range(k)]], solve), "regression-fit")
        if found is not None:
            forget(found)
        found = new
        residual = lookup_join(rows, found.drop("n"), "g", "inner").withColumn("e", F.abs(F.col("y") - sum((F.col(f"b{i}") * F.col(f"f{i}") for i in range(k)), F.lit(0.0))))
        residual = materialise(residual.drop(*[f"b{i}" for i in range(k)]), "regression-residuals")
        sigma = materialise(grouped_quantile(residual, "g", "e", 0.5, "mad").select("g", (1.4826 * F.col("mad")).alias("sigma")), "regression-scale")
        if step < rounds - 1:
            cut = scale * F.greatest("sigma", F.lit(1e-12))
            weighted = lookup_join(residual, sigma, "g", "inner").withColumn("w", F.when(F.col("e") > cut, cut / F.col("e")).otherwise(1.0))
    return found.join(sigma, "g").withColumnRenamed("g", group)


def pooled_attention(mass: DataFrame) -> DataFrame:
    """``batch, head, i, j, mean, top, peak``: attention between images from token masses.

    ``mass`` has ``batch, head, i, query, j, key, value``. Masses are summed over the key tokens of an image; of the
    queries the mean and the largest are taken; ``peak`` is the largest single value.
    """
    rows = mass.groupBy("batch", "head", "i", "query", "j").agg(F.sum("value").alias("s"), F.max("value").alias("p"))
    return rows.groupBy("batch", "head", "i", "j").agg(F.avg("s").alias("mean"), F.max("s").alias("top"), F.max("p").alias("peak"))


def guided_candidates(queries: DataFrame, targets: DataFrame, radius: float, k: int) -> DataFrame:
    """``pair, q, t, px_distance, rank``: the k targets nearest to a query's predicted pixel, within ``radius``.

    ``queries`` has ``pair, q, x, y`` (predicted); ``targets`` has ``pair, t, x, y``. Both are put into square buckets of the
    radius; a query meets the nine buckets around it in an equi-join. Equal distances go by smaller target.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    t = targets.select("pair", "t", F.col("x").alias("tx"), F.col("y").alias("ty"), bucket("x").alias("bx"), bucket("y").alias("by"))
    q = queries.select("pair", "q", "x", "y", near.alias("ox")).withColumn("oy", near)
    q = q.select("pair", "q", "x", "y", (bucket("x") + F.col("ox")).alias("bx"), (bucket("y") + F.col("oy")).alias("by"))
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ty"), F.lit(2.0)))
    met = q.join(t, ["pair", "bx", "by"]).withColumn("px_distance", d).filter(F.col("px_distance") <= radius)
    w = Window.partitionBy("pair", "q").orderBy("px_distance", "t")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("pair", "q", "t", "px_distance", "rank")


def ratio_test(scored: DataFrame, group: Sequence[str], target: str, distance: str, ratio: float = 0.85) -> DataFrame:
    """Of every group's candidates the nearest, if its distance is below ``ratio`` times that of the second; single candidates fail."""
    w = Window.partitionBy(*group).orderBy(F.col(distance), F.col(target))
    two = scored.withColumn("__r", F.row_number().over(w)).filter("__r <= 2")
    best = two.groupBy(*group).agg(F.min_by(target, "__r").alias(target), F.min(distance).alias(distance), F.max(F.when(F.col("__r") == 2, F.col(distance))).alias("second"))
    return best.filter(F.col(distance) < ratio * F.col("second")).drop("second")
