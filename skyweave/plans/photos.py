"""Queries over photo positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators.keyed import latest
from skyweave.operators.spatial import containing_regions, near_pairs, near_places
from skyweave.plans.tables import Book

book = Book()


def photo_positions(spark: SparkSession, sf: str) -> DataFrame:
    """``name, lat, lon, alt`` of every photo by its latest row; positions that do not count are NULL.

    A photo is the file name after the last slash or backslash. It has no position if its latitude or longitude is
    missing, both are 0, or one is out of range.
    """
    g = spark.read.parquet(f"{sf}/gps.parquet").filter("names is not null")
    g = g.select(F.regexp_extract("names", r"(?s)([^/\\]*)\z", 1).alias("name"), F.get("lla", F.lit(0)).alias("lat"), F.get("lla", F.lit(1)).alias("lon"), F.get("lla", F.lit(2)).alias("alt"), "received_at")
    g = latest(g, ["name"], "received_at", ["lat", "lon", "alt"])
    usable = F.expr("not isnan(lat) and not isnan(lon) and not (lat = 0 and lon = 0) and abs(lat) <= 90 and abs(lon) <= 180")
    kept = lambda c: F.when(usable, F.col(c)).alias(c)
    return g.select("name", kept("lat"), kept("lon"), "alt")


P5_FOUND = r"""
WITH g AS (SELECT regexp_extract(names, '[^/\\]*$') AS name, lla[1] AS lat, lla[2] AS lon, received_at FROM gps WHERE names IS NOT NULL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY received_at DESC NULLS LAST, lat DESC NULLS LAST, lon DESC NULLS LAST) k FROM g) WHERE k = 1),
p AS (SELECT name, lat, lon, 6378137.0 / sqrt(1 - 6.69437999014e-3 * power(sin(radians(lat)), 2)) AS n FROM l
      WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0) AND abs(lat) <= 90 AND abs(lon) <= 180),
e AS (SELECT name, lat, lon, n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - 6.69437999014e-3) * sin(radians(lat)) AS z FROM p),
c AS (SELECT zone_code, lons[1] AS first, unnest(lons) AS x1, unnest(lats) AS y1, unnest(list_concat(lons[2:], lons[1:1])) AS x2, unnest(list_concat(lats[2:], lats[1:1])) AS y2 FROM zones),
t AS (SELECT zone_code, first, first + ((x1 - first + 180) - 360 * floor((x1 - first + 180) / 360)) - 180 AS x1, y1, first + ((x2 - first + 180) - 360 * floor((x2 - first + 180) / 360)) - 180 AS x2, y2 FROM c),
i AS (SELECT e.name, t.zone_code, count(*) AS n FROM e JOIN t ON (t.y1 <= e.lat) <> (t.y2 <= e.lat)
      AND e.lon + 360 * round((t.first - e.lon) / 360) < t.x1 + (e.lat - t.y1) * (t.x2 - t.x1) / (t.y2 - t.y1) GROUP BY 1, 2)
SELECT 'near' AS kind, a.name AS key_a, b.name AS key_b FROM e a JOIN e b ON a.name < b.name AND abs(a.lat - b.lat) < 0.001
  AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 5
UNION ALL SELECT 'zone', name, zone_code FROM i WHERE n % 2 = 1
"""


@book.query(P5_FOUND)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    photos = photo_positions(spark, sf)
    near = near_pairs(photos, "name", "lat", "lon", 5.0).select(F.lit("near").alias("kind"), "key_a", "key_b")
    zones = spark.read.parquet(f"{sf}/zones.parquet")
    inside = containing_regions(photos, "name", "lat", "lon", zones, "zone_code", "lons", "lats")
    return near.unionByName(inside.select(F.lit("zone").alias("kind"), F.col("key").alias("key_a"), F.col("region").alias("key_b")))


@book.query(
    P5_FOUND.split("c AS (SELECT zone_code")[0].rstrip().rstrip(",") + """, q AS (SELECT lat, lon, min(name) AS n, count(*) AS photos, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM e GROUP BY lat, lon)
SELECT (SELECT count(*) FROM q) AS places, (SELECT CAST(sum(photos) AS BIGINT) FROM q) AS photos, count(*) AS pairs FROM q a JOIN q b ON (a.n, a.lat, a.lon) < (b.n, b.lat, b.lon)
  AND abs(a.lat - b.lat) < 0.001 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 5"""
)
def near_place_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Photos by place, and the pairs of places at most 5 m apart."""
    members, pairs = near_places(photo_positions(spark, sf), "name", "lat", "lon", 5.0)
    a = members.agg(F.countDistinct("place").alias("places"), F.count(F.lit(1)).alias("photos"))
    return a.crossJoin(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("pairs"))))  # one row each
