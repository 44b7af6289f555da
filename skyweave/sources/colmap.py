"""Text models of a reconstruction: cameras, images and points, read and written as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.pose import intrinsics

# Endings by which a line is taken for an image.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "tif", "tiff")


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the trimmed lines that are neither empty nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value != '' and not startswith(value, '#')")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return data_lines(spark, path).select(F.split("value", r"\s+").alias("e"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``camera_id, model, width, height, params, fx, fy, cx, cy``; a line whose numbers cannot be read gives NULL there."""
    e = _tokens(spark, path).filter(F.size("e") >= 4)
    at = lambda k, kind: F.get("e", F.lit(k)).try_cast(kind)
    c = e.select(
        at(0, "int").alias("camera_id"), F.get("e", F.lit(1)).alias("model"), at(2, "int").alias("width"), at(3, "int").alias("height"),
        F.transform(F.slice("e", 5, F.greatest(F.size("e") - 4, F.lit(0))), lambda x: x.try_cast("double")).alias("params"),
    )
    return c.withColumn("k", intrinsics(F.col("model"), F.col("params"))).select("*", "k.fx", "k.fy", "k.cx", "k.cy").drop("k")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, qw..qz, tx..tz, camera_id, name``: lines of exactly ten tokens of which the last names an image; lines of 2D points are skipped."""
    e = _tokens(spark, path).filter((F.size("e") == 10) & F.lower(F.get("e", F.lit(9))).rlike(r"\.(" + "|".join(IMAGE_ENDINGS) + r")\z"))
    numbers = [F.get("e", F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))]
    return e.select(F.get("e", F.lit(0)).try_cast("int").alias("image_id"), *numbers, F.get("e", F.lit(8)).try_cast("int").alias("camera_id"), F.get("e", F.lit(9)).alias("name"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``point_id, x, y, z, r, g, b`` of a text file of points."""
    e = _tokens(spark, path).filter(F.size("e") >= 7)
    at = lambda k, kind, n: F.get("e", F.lit(k)).try_cast(kind).alias(n)
    return e.select(at(0, "bigint", "point_id"), *[at(k + 1, "double", n) for k, n in enumerate("xyz")], *[at(k + 4, "smallint", n) for k, n in enumerate("rgb")])


def write_images(images: DataFrame, path: str) -> None:
    """One line per image and an empty line for its 2D points, as part files. Images without a whole pose or a name cannot be written and are refused."""
    columns = ["image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name"]
    if not images.filter(" or ".join(f"{c} is null" for c in columns)).isEmpty():
        raise ValueError("an image lacks a part of its pose, its lens or its name")
    images.select(F.concat(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]), F.lit("\n")).alias("value")).write.text(path)


def write_cameras(cameras: DataFrame, path: str) -> None:
    params = F.array_join(F.transform("params", lambda x: x.cast("string")), " ")
    cameras.select(F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), params).alias("value")).write.text(path)


def write_points(points: DataFrame, path: str) -> None:
    """One line per point: id, position, colour and an error of 0."""
    columns = ["point_id", "x", "y", "z", "r", "g", "b"]
    points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns], F.lit("0")).alias("value")).write.text(path)


def scene_name_of(path: Column) -> Column:
    """:func:`scene_name` of a column; NULL for a path without a name."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")
    leaf = F.try_element_at(parts, F.lit(-1))
    return F.when((F.size(parts) > 1) & (leaf == "colmap_metrics"), F.try_element_at(parts, F.lit(-2))).otherwise(leaf)


def count_guard(points: DataFrame, ties: DataFrame) -> DataFrame:
    """One row ``points, tie_points, source``: the points count only if there are as many as tie points; else only shared counts can be used."""
    both = points.agg(F.count(F.lit(1)).alias("p")).crossJoin(F.broadcast(ties.agg(F.count(F.lit(1)).alias("tie_points"))))  # one row each
    whole = F.col("p") == F.col("tie_points")
    return both.select(F.when(whole, F.col("p")).alias("points"), "tie_points", F.when(whole, "points").otherwise("shared counts only").alias("source"))


def scene_name(path: str) -> str:
    """The folder's name, or its parent's if it is the folder of the model itself."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    return parts[-2] if len(parts) > 1 and parts[-1] == "colmap_metrics" else parts[-1]
