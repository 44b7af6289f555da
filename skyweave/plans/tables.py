"""The tables that queries start from, cleaned the same way everywhere, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators.keyed import latest
from skyweave.operators.pairs import unordered


class Book:
    """Queries by name, with the SQL they are compared with."""

    def __init__(self) -> None:
        self.found: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.found[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """``point_id, image_id``: a track seen by an image."""
    return table(spark, sf, "track_obs").select(F.col("track_id").alias("point_id"), F.col("obs_img").alias("image_id")).filter("point_id is not null and image_id is not null").distinct()


OBS = "o AS (SELECT DISTINCT track_id AS p, obs_img AS m FROM track_obs WHERE track_id IS NOT NULL AND obs_img IS NOT NULL)"
SHARED = OBS + """,
n AS (SELECT m, count(*) AS n FROM o GROUP BY 1),
s AS (SELECT a.m AS i, b.m AS j, count(*) AS shared FROM o a JOIN o b ON a.p = b.p AND a.m < b.m GROUP BY 1, 2)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``src, dst, score``: the latest evaluated finite score of every directed pair of different images."""
    rows = table(spark, sf, "camera_connections").select("image_id", "other_id", "score", "evaluated", "updated_at").filter("image_id != other_id")
    newest = latest(rows, ["image_id", "other_id"], "updated_at", ["evaluated", "score"])
    usable = newest.filter("evaluated and score is not null and not isnan(score) and abs(score) != double('infinity')")
    return usable.select(F.col("image_id").alias("src"), F.col("other_id").alias("dst"), F.col("score").cast("double").alias("score"))


PREDICTED = """pr AS (SELECT image_id AS src, other_id AS dst, CAST(score AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, other_id ORDER BY updated_at DESC NULLS LAST, evaluated DESC NULLS LAST, score DESC NULLS LAST) k
  FROM camera_connections WHERE image_id <> other_id) WHERE k = 1 AND evaluated AND score IS NOT NULL AND isfinite(score)),
pp AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, max(score) AS score FROM pr GROUP BY 1, 2)"""


def predicted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``i, j, score``: the larger of both directions."""
    return unordered(predictions(spark, sf), "src", "dst").groupBy("i", "j").agg(F.max("score").alias("score"))


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """``batch_id, i, j, overlap``: the latest measurement of every pair in every batch, if it is not missing."""
    rows = unordered(table(spark, sf, "batch_pairs").filter("batch_id is not null"), "image_i", "image_j").select("batch_id", "i", "j", "overlap", "measured_at")
    newest = latest(rows, ["batch_id", "i", "j"], "measured_at", ["overlap"])
    return newest.filter("overlap is not null and not isnan(overlap)").select("batch_id", "i", "j", F.col("overlap").cast("double").alias("overlap"))


MEASURED = """me AS (SELECT batch_id, i, j, CAST(overlap AS DOUBLE) AS overlap FROM (
  SELECT batch_id, least(image_i, image_j) AS i, greatest(image_i, image_j) AS j, overlap,
         row_number() OVER (PARTITION BY batch_id, least(image_i, image_j), greatest(image_i, image_j) ORDER BY measured_at DESC NULLS LAST, overlap DESC NULLS LAST) k
  FROM batch_pairs WHERE image_i <> image_j AND batch_id IS NOT NULL) WHERE k = 1 AND overlap IS NOT NULL AND NOT isnan(overlap)),
mp AS (SELECT i, j, sum(overlap) AS total, count(*) AS n, max(overlap) AS top, sum(overlap) / count(*) AS mean FROM me GROUP BY 1, 2)"""


def views(spark: SparkSession, sf: str) -> DataFrame:
    """``member_id, batch_id, kind, pos, image_id, cam_conf, descriptors``: the latest row of every member; a missing confidence is NULL."""
    rows = table(spark, sf, "batch_members").filter("member_id is not null")
    newest = latest(rows, ["member_id"], "predicted_at", ["cam_conf", "batch_id", "image_id"])
    return newest.withColumn("cam_conf", F.when(~F.isnan("cam_conf"), F.col("cam_conf").cast("double"))).drop("predicted_at")


VIEWS = """vw AS (SELECT member_id, batch_id, kind, pos, image_id, CASE WHEN NOT isnan(cam_conf) THEN CAST(cam_conf AS DOUBLE) END AS cam_conf, descriptors FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY predicted_at DESC NULLS LAST, cam_conf DESC NULLS LAST, batch_id DESC NULLS LAST, image_id DESC NULLS LAST) k
  FROM batch_members WHERE member_id IS NOT NULL) WHERE k = 1)"""


def photos(spark: SparkSession, sf: str) -> DataFrame:
    """``image_id, qw, qx, qy, qz, tx, ty, tz, camera_id, name``: every image once; anchors included."""
    both = table(spark, sf, "images").unionByName(table(spark, sf, "anchor_images"))
    return both.dropDuplicates(["image_id"])


#: of the placed images only, as the rows of an image may differ in nothing else
POSED = """ps AS (SELECT DISTINCT image_id, qw, qx, qy, qz, tx, ty, tz, camera_id, name FROM (SELECT * FROM images UNION ALL SELECT * FROM anchor_images)
  WHERE isfinite(qw) AND isfinite(qx) AND isfinite(qy) AND isfinite(qz) AND isfinite(tx) AND isfinite(ty) AND isfinite(tz)
  AND qw * qw + qx * qx + qy * qy + qz * qz > 0)"""


def posed(spark: SparkSession, sf: str) -> DataFrame:
    """Images with a whole pose: all seven numbers finite and a quaternion that is not zero."""
    numbers = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    whole = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) != double('infinity')" for c in numbers)
    both = table(spark, sf, "images").unionByName(table(spark, sf, "anchor_images"))
    return both.filter(whole + " and qw * qw + qx * qx + qy * qy + qz * qz > 0").distinct()
