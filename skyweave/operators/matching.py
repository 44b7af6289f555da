"""Geometry of many cameras at once: residuals of tracks, rotation averaging, ground footprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.pose import add, angle_between_deg, centre, direction_angle_deg, multiply, project, reprojection_error, transpose
from skyweave.operators.estimators import ROTATION, _batched, mean_rotation, nearest_rotation
from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import grouped_quantile
from skyweave.session import forget, materialise, materialise_counted


def residuals(obs: DataFrame, points: DataFrame, track: str, u: str, v: str, fx: float, fy: float, cx: float, cy: float, rotation: str = "r", translation: str = "t") -> DataFrame:
    """``obs`` with ``error`` in pixels, infinite for points behind the camera; observations of tracks without a point are left out."""
    p = points.filter("x is not null and not isnan(x)").select(track, F.array("x", "y", "z").alias("__x"))
    both = lookup_join(obs, p, track, "inner")
    pixel = project(F.col(rotation), F.col(translation), F.col("__x"), F.lit(fx), F.lit(fy), F.lit(cx), F.lit(cy))
    return both.withColumn("__p", pixel).withColumn("error", reprojection_error(F.col("__p"), F.col(u), F.col(v))).drop("__p", "__x")


def filter_tracks(errors: DataFrame, track: str, max_px: float, least: int = 2) -> DataFrame:
    """Observations with an error below ``max_px`` (strictly), of tracks that keep at least ``least``."""
    good = errors.filter(F.col("error") < max_px)
    kept = good.groupBy(track).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(track)
    return lookup_join(good, kept, track, "inner")


def sound_points(obs: DataFrame, points: DataFrame, track: str, u: str, v: str, fx: float, fy: float, cx: float, cy: float, max_px: float, least_deg: float = 1.0, rotation: str = "r", translation: str = "t") -> DataFrame:
    """``points`` of tracks that lie ahead of all their cameras, with no error above ``max_px`` and two rays at least ``least_deg`` apart.

    All rays are compared with one of their track; only if the widest of these angles is between half of ``least_deg`` and
    ``least_deg``, which leaves the widest of all open, are the track's rays compared with each other.
    """
    errors = residuals(obs, points, track, u, v, fx, fy, cx, cy, rotation, translation)
    worst = errors.groupBy(track).agg(F.max("error").alias("__e")).filter((F.col("__e") <= max_px) & (F.col("__e") < float("inf")))
    placed = materialise(points.join(worst.select(track), track, "left_semi"), "placed")
    met = lookup_join(obs.select(track, F.col(rotation).alias("__r"), F.col(translation).alias("__t")), placed.select(track, F.array("x", "y", "z").alias("__x")), track, "inner")
    rays = materialise(met.select(track, add(F.col("__x"), centre(F.col("__r"), F.col("__t")), -1).alias("__ray")), "rays")
    widest = lambda pairs: pairs.groupBy(track).agg(F.max(direction_angle_deg(F.col("__ray"), F.col("__other"))).alias("__a"))
    to_one = materialise(widest(lookup_join(rays, rays.groupBy(track).agg(F.max("__ray").alias("__other")), track, "inner")), "ray-angles")
    unsure = rays.join(to_one.filter((F.col("__a") < least_deg) & (F.col("__a") > 0.499 * least_deg)), track, "left_semi")
    found = widest(unsure.join(unsure.withColumnRenamed("__ray", "__other"), track))
    return placed.join(to_one.unionByName(found).filter(F.col("__a") >= least_deg).select(track), track, "left_semi")


def average_rotations(edges: DataFrame, start: DataFrame, *, sharp_rounds: int = 5, max_rounds: int = 60, softness_deg: float = 3.0, tolerance_deg: float = 0.02, align: float = 0.7) -> DataFrame:
    """``node, r``: rotations that agree best with relative ones.

    ``edges`` has ``i, j, rij`` with R_j = R_ij R_i; ``start`` has ``node, r``. In each round every node takes the weighted
    chordal mean of what its neighbours and their relative rotations imply, and of its own value, which damps the
    round. Weights fall with the residual: as its inverse (smoothed absolute error) for ``sharp_rounds``, then after Cauchy
    (``softness_deg``). Rounds go on until no node turns by more than ``tolerance_deg``; if that takes more than ``max_rounds``, an error is
    raised. Only relative rotations are determined, so the result is turned as a whole to the start, by the chordal mean
    over the ``align`` share of nodes that agree best. A node without edges keeps its value. A node receives nine sums, whatever its degree.
    """
    there = edges.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("rij").alias("m"))
    back = edges.select(F.col("j").alias("src"), F.col("i").alias("dst"), transpose(F.col("rij")).alias("m"))
    both, rows = materialise_counted(there.unionByName(back), "rotations-edges")
    begun = materialise(start.select("node", "r"), "rotations-start")
    at = begun
    for k in range(max_rounds):
        told = lookup_join(both, at.select(F.col("node").alias("src"), F.col("r").alias("rs")), "src", "inner", rows).select("src", "dst", multiply(F.col("m"), F.col("rs")).alias("said"))
        met = lookup_join(told, at.select(F.col("node").alias("dst"), F.col("r").alias("rd")), "dst", "inner", rows)
        off = angle_between_deg(F.col("said"), F.col("rd")) / softness_deg
        weight = 1 / F.greatest(off, F.lit(1e-2)) if k < sharp_rounds else 1 / (1 + off * off)
        weighted = met.withColumn("w", weight).select(F.col("dst").alias("node"), "w", "said")
        sums = weighted.groupBy("node").agg(F.sum("w").alias("all"), *[F.sum(F.get("said", F.lit(k)) * F.col("w")).alias(f"m{k}") for k in range(9)])
        # a node's own value counts half as much as what it is told: without that, two-coloured graphs swing
        sums = sums.join(at.select("node", "r"), "node").select("node", *[(F.col(f"m{k}") + 0.5 * F.col("all") * F.get("r", F.lit(k))).alias(f"m{k}") for k in range(9)])
        new = _batched(sums, ["node"], [f"m{k}" for k in range(9)], ROTATION, lambda x: nearest_rotation(x.reshape(-1, 3, 3)).reshape(-1, 9))
        turned = new.select("node", F.array(*ROTATION).alias("r")).join(at.withColumnRenamed("r", "was"), "node").withColumn("step", angle_between_deg(F.col("r"), F.col("was")))
        after = materialise(turned.select("node", "r", "step"), "rotations")
        widest = after.agg(F.max("step")).first()[0]
        if at is not begun:
            forget(at)
        at = after
        if k >= sharp_rounds and (widest is None or widest <= tolerance_deg):
            linked = both.select(F.col("dst").alias("node")).distinct()
            alone = begun.join(linked, "node", "left_anti")
            return _aligned(at.join(linked, "node", "left_semi"), begun, align).unionByName(alone)
    raise RuntimeError(f"rotations are not settled after {max_rounds} rounds")


def _aligned(found: DataFrame, start: DataFrame, share: float) -> DataFrame:
    """``found`` turned as a whole towards ``start``: first over all nodes, then over the share of them that agree best."""
    both = materialise(found.select("node", "r").join(start.withColumnRenamed("r", "to"), "node").select("node", "r", multiply(transpose(F.col("r")), F.col("to")).alias("turn"), F.lit(1).alias("all")), "rotations-turns")
    turn = lambda rows: mean_rotation(rows, "all", "turn").select("all", F.array(*ROTATION).alias("g"))
    near = materialise(lookup_join(both, turn(both), "all", "inner").withColumn("e", angle_between_deg(F.col("turn"), F.col("g"))), "rotations-near")
    best = near.join(F.broadcast(grouped_quantile(near, "all", "e", share, "cut")), "all").filter(F.col("e") <= F.col("cut"))
    return lookup_join(both, turn(best), "all", "inner").select("node", multiply(F.col("r"), F.col("g")).alias("r"))


def _footprint_share(width: int, height: int, f: float, grid: int):
    """Of batches of camera pairs the share of the first one's ground grid that the second one sees."""
    place = (np.arange(grid) + 0.5) / grid
    a, b = np.meshgrid((place * width - width / 2) / f, (place * height - height / 2) / f, indexing="ij")
    pixels = np.column_stack([a.ravel(), b.ravel(), np.ones(grid * grid)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stack = lambda c, width: np.asarray(batch.column(c).flatten()).reshape(-1, width)
            r, c, ro, co = stack("r", 9).reshape(-1, 3, 3), stack("c", 3), stack("ro", 9).reshape(-1, 3, 3), stack("co", 3)
            share = np.empty(batch.num_rows)
            for at in range(0, batch.num_rows, 256):
                k = slice(at, at + 256)
                d = np.einsum("nji,pj->npi", r[k], pixels)
                down = d[:, :, 2]
                hit = down < -1e-9
                ground = c[k, None, :] + np.where(hit, -c[k, None, 2] / np.where(hit, down, -1.0), 0.0)[:, :, None] * d
                p = np.einsum("nij,npj->npi", ro[k], ground - co[k, None, :])
                z = p[:, :, 2]
                ahead = hit & (z > 1e-9)
                deep = np.where(ahead, z, 1.0)
                u, v = p[:, :, 0] * f / deep + width / 2, p[:, :, 1] * f / deep + height / 2
                share[k] = (ahead & (u >= 0) & (u < width) & (v >= 0) & (v < height)).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("other"), pa.array(share)], ["name", "other", "share"])

    return run


def footprint_overlap(cameras: DataFrame, pairs: DataFrame, width: int, height: int, f: float, grid: int = 24) -> DataFrame:
    """``i, j, overlap``: the smaller of both directions of the share of a camera's ground grid that the other one sees.

    ``cameras`` has ``name, r, c`` (world-to-camera rotation and centre above the plane z = 0); ``pairs`` has ``i, j``, the candidates.
    Grid rays that do not meet the ground count as unseen. "Sees" is half-open: 0 <= u < width, 0 <= v < height.
    """
    both = pairs.select(F.col("i").alias("name"), F.col("j").alias("other")).unionByName(pairs.select(F.col("j").alias("name"), F.col("i").alias("other")))
    met = both.join(cameras.select(F.col("name").alias("other"), F.col("r").alias("ro"), F.col("c").alias("co")), "other").join(cameras.select("name", "r", "c"), "name")
    kind = dict(cameras.dtypes)["name"]
    share = met.select("name", "other", "r", "c", "ro", "co").mapInArrow(_footprint_share(width, height, f, grid), f"name {kind}, other {kind}, share double")
    return share.groupBy(F.least("name", "other").alias("i"), F.greatest("name", "other").alias("j")).agg(F.min("share").alias("overlap"))


def relative_from_absolute(r_i: Column, r_j: Column) -> Column:
    return multiply(r_j, transpose(r_i))
