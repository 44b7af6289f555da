"""Covisibility of the observation table, and simple facts of tracks and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.operators.covis import directional, edges_above, normalise, points_per_image, shared_counts
from skyweave.operators.keyed import latest
from skyweave.operators.ordering import six
from skyweave.plans.tables import OBS, SHARED, Book, observations, photos, table

book = Book()


@book.query(f"WITH {SHARED} SELECT i, j, shared FROM s")
def covis_shared(spark: SparkSession, sf: str) -> DataFrame:
    return shared_counts(observations(spark, sf))


def _scores(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    obs = observations(spark, sf)
    return normalise(shared_counts(obs), points_per_image(obs), kind)


@book.query(f"WITH {SHARED} SELECT i, j, floor(shared / least(a.n, b.n) * 1e6 + 0.5) / 1e6 AS overlap FROM s JOIN n a ON a.m = i JOIN n b ON b.m = j")
def covis_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "overlap").select("i", "j", six(F.col("score")).alias("overlap"))


@book.query(f"WITH {SHARED} SELECT i, j, floor(shared / (a.n + b.n - shared) * 1e6 + 0.5) / 1e6 AS jaccard FROM s JOIN n a ON a.m = i JOIN n b ON b.m = j")
def covis_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "jaccard").select("i", "j", six(F.col("score")).alias("jaccard"))


@book.query(f"WITH {SHARED} SELECT i, j FROM s JOIN n a ON a.m = i JOIN n b ON b.m = j WHERE shared / least(a.n, b.n) >= 0.1")
def edges_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return edges_above(_scores(spark, sf, "overlap"), 0.1).select("i", "j")


@book.query(f"WITH {SHARED}, d AS (SELECT i AS src, j AS dst, shared FROM s UNION ALL SELECT j, i, shared FROM s) SELECT src, dst, floor(shared / n * 1e6 + 0.5) / 1e6 AS share FROM d JOIN n ON m = src")
def covis_directional(spark: SparkSession, sf: str) -> DataFrame:
    obs = observations(spark, sf)
    return directional(shared_counts(obs), points_per_image(obs)).select("src", "dst", six(F.col("share")).alias("share"))


@book.query(f"WITH {OBS}, i AS (SELECT image_id FROM images UNION SELECT image_id FROM anchor_images) SELECT i.image_id, count(o.p) AS points FROM i LEFT JOIN o ON o.m = i.image_id WHERE i.image_id IS NOT NULL GROUP BY 1")
def obs_per_image(spark: SparkSession, sf: str) -> DataFrame:
    """Images without observations are kept with 0."""
    ids = photos(spark, sf).filter("image_id is not null").select("image_id")
    return ids.join(points_per_image(observations(spark, sf)), "image_id", "left").select("image_id", F.coalesce("points", F.lit(0)).alias("points"))


@book.query(f"WITH {OBS}, i AS (SELECT image_id FROM images UNION SELECT image_id FROM anchor_images) SELECT m AS image_id, count(*) AS points FROM o WHERE m IN (SELECT image_id FROM i) GROUP BY 1 HAVING count(*) >= 20")
def min_obs_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images of the reference list with at least 20 observations."""
    return points_per_image(observations(spark, sf)).filter("points >= 20").join(photos(spark, sf).select("image_id"), "image_id", "left_semi")


@book.query(f"WITH {OBS}, i AS (SELECT image_id FROM images UNION SELECT image_id FROM anchor_images) SELECT count(*) AS kept, (SELECT count(*) FROM o) AS total FROM o WHERE m IN (SELECT image_id FROM i)")
def photo_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of unknown photos are dropped; how many are kept, of how many."""
    known = photos(spark, sf).select("image_id", F.lit(1).alias("known")).filter("image_id is not null")
    return observations(spark, sf).join(known, "image_id", "left").agg(F.count("known").alias("kept"), F.count(F.lit(1)).alias("total"))


@book.query(f"WITH {OBS} SELECT p AS track_id, count(*) AS views FROM o GROUP BY 1")
def track_length(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy(F.col("point_id").alias("track_id")).agg(F.count(F.lit(1)).alias("views"))


@book.query(f"WITH {OBS} SELECT p AS track_id, m AS obs_img FROM o WHERE p IN (SELECT p FROM o GROUP BY 1 HAVING count(*) >= 3)")
def min_track_len(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of tracks with at least 3 views."""
    obs = observations(spark, sf)
    long = obs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return obs.join(long, "point_id", "left_semi").select(F.col("point_id").alias("track_id"), F.col("image_id").alias("obs_img"))


_LATEST = """t AS (SELECT track_id, obs_img, obs_feat, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, CASE WHEN isnan(conf) THEN NULL ELSE CAST(conf AS DOUBLE) END AS conf FROM (
  SELECT *, row_number() OVER (PARTITION BY obs_img, obs_feat ORDER BY logged_at DESC NULLS LAST, conf DESC NULLS LAST, track_id DESC NULLS LAST) k FROM track_obs
  WHERE obs_img IS NOT NULL AND obs_feat IS NOT NULL) WHERE k = 1)"""


def newest_observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "track_obs").filter("obs_img is not null and obs_feat is not null")
    newest = latest(rows, ["obs_img", "obs_feat"], "logged_at", ["conf", "track_id"])
    return newest.select("track_id", "obs_img", "obs_feat", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.when(~F.isnan("conf"), F.col("conf").cast("double")).alias("conf"))


@book.query(f"WITH {_LATEST} SELECT track_id, count(*) AS views, floor(avg(conf) * 1e6 + 0.5) / 1e6 AS mean_conf, floor((max(x) - min(x)) * 1e6 + 0.5) / 1e6 AS extent_x FROM t WHERE track_id IS NOT NULL GROUP BY 1")
def track_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Views, mean confidence and extent of every track."""
    g = newest_observations(spark, sf).filter("track_id is not null").groupBy("track_id")
    return g.agg(F.count(F.lit(1)).alias("views"), six(F.avg("conf")).alias("mean_conf"), six(F.max("x") - F.min("x")).alias("extent_x"))


@book.query(f"WITH {_LATEST}, q AS (SELECT track_id, count(*) AS views, avg(conf) AS c FROM t WHERE track_id IS NOT NULL GROUP BY 1) SELECT track_id, views FROM q WHERE views >= 3 AND c >= 5")
def point_quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks that meet thresholds over aggregates."""
    g = newest_observations(spark, sf).filter("track_id is not null").groupBy("track_id").agg(F.count(F.lit(1)).alias("views"), F.avg("conf").alias("c"))
    return g.filter("views >= 3 and c >= 5").select("track_id", "views")


@book.query(
    f"WITH {_LATEST}, c AS (SELECT *, CAST(floor(x / 32) AS BIGINT) AS cx, CAST(floor(y / 32) AS BIGINT) AS cy FROM t WHERE conf IS NOT NULL AND isfinite(x) AND isfinite(y)), "
    "m AS (SELECT obs_img, cx, cy, max(conf) AS best FROM c GROUP BY 1, 2, 3) SELECT obs_img, cx, cy, obs_feat FROM c JOIN m USING (obs_img, cx, cy) WHERE conf = best"
)
def cell_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The most confident observations of every 32-pixel cell of an image; equal ones are all kept."""
    t = newest_observations(spark, sf).filter("conf is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    cells = t.withColumns({"cx": F.floor(F.col("x") / 32), "cy": F.floor(F.col("y") / 32)})
    best = Window.partitionBy("obs_img", "cx", "cy").orderBy(F.col("conf").desc())
    return cells.withColumn("r", F.rank().over(best)).filter("r = 1").select("obs_img", "cx", "cy", "obs_feat")


@book.query(f"WITH {_LATEST} SELECT track_id, obs_img, obs_feat FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY obs_img, obs_feat) k FROM t WHERE track_id IS NOT NULL) WHERE k = 1")
def first_observation(spark: SparkSession, sf: str) -> DataFrame:
    t = newest_observations(spark, sf).filter("track_id is not null")
    w = Window.partitionBy("track_id").orderBy("obs_img", "obs_feat")
    return t.withColumn("k", F.row_number().over(w)).filter("k = 1").select("track_id", "obs_img", "obs_feat")
