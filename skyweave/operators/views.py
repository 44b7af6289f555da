"""What cameras see of points: ray angles, ground heights, predicted overlap, lookups in grids, colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.pose import add, centre, direction_angle_deg, let, rotate, rotate_back
from skyweave.functions.vec import dot
from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import grouped_quantile
from skyweave.session import materialise


def lift(u: Column, v: Column, depth: Column, rotation: Column, translation: Column) -> Column:
    """The world point at a depth along the ray of normalised image coordinates."""
    return rotate_back(rotation, add(F.array(u * depth, v * depth, depth), translation, -1))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key by ``order``, combined before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__f")).select(key, "__f.*")


def max_ray_angle(obs: DataFrame, points: DataFrame, track: str, order: Sequence[str], rotation: str = "r", translation: str = "t") -> DataFrame:
    """``track, max_angle``: the widest angle in degrees between a track's rays and the ray of its first observation by ``order``.

    ``points`` has ``track, x`` (array of 3). Tracks without a point are left out.
    """
    met = lookup_join(obs.select(track, *order, F.col(rotation).alias("__r"), F.col(translation).alias("__t")), points.select(track, F.col("x").alias("__x")), track, "inner")
    rays = materialise(met.select(track, *order, add(F.col("__x"), centre(F.col("__r"), F.col("__t")), -1).alias("__ray")), "rays")
    first = first_per_key(rays, track, order).select(track, F.col("__ray").alias("__first"))
    return lookup_join(rays, first, track, "inner").groupBy(track).agg(F.max(direction_angle_deg(F.col("__ray"), F.col("__first"))).alias("max_angle"))


def up_direction(cameras: DataFrame, rotation: str = "r") -> DataFrame:
    """One row ``up``: against the mean view direction, at length 1."""
    mean = cameras.agg(*[(-F.avg(F.get(rotation, F.lit(6 + k)))).alias(f"u{k}") for k in range(3)])
    size = F.sqrt(sum((F.col(f"u{k}") * F.col(f"u{k}") for k in range(3)), F.lit(0.0)))
    return mean.select(F.array(*[F.col(f"u{k}") / size for k in range(3)]).alias("up"))


def ground_heights(obs: DataFrame, points: DataFrame, up: DataFrame, track: str, image: str) -> DataFrame:
    """``image, height``: the median height, along ``up``, of the points that an image observes. ``points`` has ``track, x``."""
    heights = points.crossJoin(F.broadcast(up)).select(track, dot("x", "up").alias("height"))  # one row of up
    met = lookup_join(obs.select(track, image).distinct(), heights, track, "inner")
    return grouped_quantile(met, image, "height", 0.5, "height")


def predicted_overlap(pairs: DataFrame, obs: DataFrame, points: DataFrame, cameras: DataFrame, width: int, height: int, f: float, most: int = 400) -> DataFrame:
    """``i, j, overlap``: the smaller of both directions of the share of a camera's points that the other one sees.

    ``pairs`` (``i, j``) are the candidates; ``obs`` has ``image, track``, ``points`` ``track, x``, ``cameras`` ``image, r, t``.
    A camera is represented by at most ``most`` of its points, the first by MD5 of the track: every camera's share is of the same
    kind of sample, however many points it observes. A camera without points sees nothing. "Sees" is half-open and in front.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("image").orderBy(F.md5(F.col("track").cast("string")), "track")
    sample = obs.select("image", "track").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")
    # at most `most` points per camera, so a list of them is no large group
    held = lookup_join(sample, points.select("track", "x"), "track", "inner").groupBy("image").agg(F.collect_list("x").alias("xs"))
    held = materialise(held, "overlap-points")
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    met = both.join(cameras.select(F.col("image").alias("j"), "r", "t"), "j").join(cameras.select(F.col("image").alias("i")), "i", "left_semi").join(held.withColumnRenamed("image", "i"), "i", "left")

    def sees(x: Column) -> Column:
        def inside(c: Column) -> Column:
            ahead, u, v = F.get(c, F.lit(2)), F.get(c, F.lit(0)) * f, F.get(c, F.lit(1)) * f
            # without a division: -w/2 <= u / z < w/2 and so on
            return (ahead > 1e-12) & (u >= ahead * (-width / 2)) & (u < ahead * (width / 2)) & (v >= ahead * (-height / 2)) & (v < ahead * (height / 2))

        return let(add(rotate(F.col("r"), x), F.col("t")), inside)

    share = F.coalesce(F.size(F.filter("xs", sees)) / F.greatest(F.size("xs"), F.lit(1)), F.lit(0.0))
    one = met.select("i", "j", F.when(F.col("xs").isNull(), 0.0).otherwise(share).alias("share"))
    both_known = F.count(F.lit(1)) == 2
    return one.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.when(both_known, F.min("share")).otherwise(0.0).alias("overlap"))


def bilinear(queries: DataFrame, grid: DataFrame, image: str = "image") -> DataFrame:
    """``queries`` (``image, q, gx, gy``) with ``value``: interpolated between the four grid values around it; NULL if one of them is missing.

    ``grid`` has ``image, ix, iy, value`` with one row per cell. The four neighbours meet in one equi-join.
    """
    x0, y0 = F.floor("gx"), F.floor("gy")
    corners = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    asked = queries.select(image, "q", "gx", "gy", corners.alias("c")).select(image, "q", "gx", "gy", "c.*")
    asked = asked.withColumns({"ix": x0 + F.col("dx"), "iy": y0 + F.col("dy"), "wx": F.when(F.col("dx") == 1, F.col("gx") - x0).otherwise(1 - (F.col("gx") - x0)), "wy": F.when(F.col("dy") == 1, F.col("gy") - y0).otherwise(1 - (F.col("gy") - y0))})
    met = asked.join(grid.filter("value is not null and not isnan(value)").select(image, "ix", "iy", "value"), [image, "ix", "iy"], "left")
    whole = F.count("value") == 4
    return met.groupBy(image, "q", "gx", "gy").agg(F.when(whole, F.sum(F.col("value") * F.col("wx") * F.col("wy"))).alias("value"))


def clipped(value: Column, low: Column, high: Column) -> Column:
    """The place of a value between two bounds, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.greatest(high - low, F.lit(1e-9))))


def two_colours(place: Column, cold: Sequence[float], warm: Sequence[float]) -> Column:
    """Red, green and blue as bytes on the line between two colours (parts of 255, cut off)."""
    return F.array(*[F.floor((F.lit(float(a)) * (1 - place) + F.lit(float(b)) * place)).cast("int") for a, b in zip(cold, warm, strict=True)])


def early_stop(losses: DataFrame, group: str, step: str, loss: str, width: int = 4, least_gain: float = 0.01) -> DataFrame:
    """``group, step``: the first step at which the mean of the last ``width`` losses is not below that of the ``width`` before by the share ``least_gain``.

    Steps are numbered from 0 without gaps. A step meets its neighbours in an equi-join over (group, step), not in a window over the group.
    """
    near = F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1)))
    spread = losses.select(group, F.col(step).alias("at"), F.col(loss).alias("v"), near.alias("back")).withColumn("end", F.col("at") + F.col("back"))
    means = spread.groupBy(group, "end").agg(
        F.avg(F.when(F.col("back") < width, F.col("v"))).alias("late"), F.avg(F.when(F.col("back") >= width, F.col("v"))).alias("early"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("back") == 0, 1)).alias("here")
    )
    stalled = means.filter((F.col("n") == 2 * width) & F.col("here").isNotNull() & (F.col("late") > (1 - least_gain) * F.col("early")))
    return stalled.groupBy(group).agg(F.min("end").alias(step))
