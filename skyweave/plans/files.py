"""Queries through the file formats: what is derived from the tables, written and read again must be what the SQL says of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.pose import rotation_of_quaternion
from skyweave.operators.ordering import six
from skyweave.plans.geometry import _ROT, _m, centre_points, milli, poses
from skyweave.plans.tables import MEASURED, OBS, POSED, Book, measurements, observations, posed, table
from skyweave.session import scratch_path
from skyweave.sources import ply
from skyweave.sources.colmap import count_guard, read_cameras, read_points, scene_name_of, write_cameras, write_points
from skyweave.sources.exports import calibration, read_camera_list, read_images_binary, read_photos, read_tie_points, write_images_binary, xmp_attributes
from skyweave.sources.snapshots import load_round, same_images, save_round
from skyweave.streaming.accumulators import closed_windows, file_stream

book = Book()

_LENS = """cm AS (SELECT DISTINCT camera_id FROM (SELECT camera_id FROM images UNION ALL SELECT camera_id FROM anchor_images) WHERE camera_id IS NOT NULL)"""


@book.query(
    f"WITH {_LENS} SELECT camera_id, CASE camera_id % 4 WHEN 0 THEN 'PINHOLE' WHEN 1 THEN 'SIMPLE_RADIAL' WHEN 2 THEN 'SIMPLE_PINHOLE' ELSE 'OPENCV' END AS model, CAST(3000.5 + camera_id AS DOUBLE) AS fx, "
    "CAST(3000.5 + camera_id + CASE WHEN camera_id % 4 IN (1, 2) THEN 0 ELSE 0.25 END AS DOUBLE) AS fy, CAST(2000.125 AS DOUBLE) AS cx, CAST(1500.75 AS DOUBLE) AS cy FROM cm"
)
def cameras_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Lenses of all images as a text model of four camera models with comments and empty lines, and their intrinsics read again."""
    ids = table(spark, sf, "images").select("camera_id").union(table(spark, sf, "anchor_images").select("camera_id")).filter("camera_id is not null").distinct()
    kind = F.col("camera_id") % 4
    model = F.when(kind == 0, "PINHOLE").when(kind == 1, "SIMPLE_RADIAL").when(kind == 2, "SIMPLE_PINHOLE").otherwise("OPENCV")
    f, centre = F.lit(3000.5) + F.col("camera_id"), F.array(F.lit(2000.125), F.lit(1500.75))
    one, two = F.concat(F.array(f), centre), F.concat(F.array(f, f + 0.25), centre)
    params = F.when(kind == 0, two).when(kind == 1, F.concat(one, F.array(F.lit(0.01)))).when(kind == 2, one).otherwise(F.concat(two, F.array(*[F.lit(0.0)] * 4)))
    path = scratch_path(spark, "cameras-txt")
    write_cameras(ids.select("camera_id", model.alias("model"), F.lit(4000).alias("width"), F.lit(3000).alias("height"), params.alias("params")), path)
    spark.createDataFrame([("# Camera list",), ("",), ("   ",), ("  # id model width height",)], "value string").write.mode("append").text(path)
    return read_cameras(spark, path).select("camera_id", "model", "fx", "fy", "cx", "cy")


@book.query(f"WITH {_ROT} SELECT CAST(image_id AS BIGINT) AS point_id, {_m('cx', 'x')}, {_m('cy', 'y')}, {_m('cz', 'z')}, CAST(image_id % 256 AS SMALLINT) AS r, CAST(7 AS SMALLINT) AS g, CAST((image_id // 256) % 256 AS SMALLINT) AS b FROM ce")
def points_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Camera centres as coloured points of a text model."""
    path = scratch_path(spark, "points-txt")
    write_points(_coloured(spark, sf), path)
    return read_points(spark, path).select("point_id", *[milli(F.col(c)).alias(c) for c in "xyz"], "r", "g", "b")


def _coloured(spark: SparkSession, sf: str) -> DataFrame:
    low, high = (F.col("image_id") % 256).cast("smallint"), (F.floor(F.col("image_id") / 256) % 256).cast("smallint")
    return centre_points(spark, sf).select(F.col("image_id").cast("long").alias("point_id"), "x", "y", "z", low.alias("r"), F.lit(7).cast("smallint").alias("g"), high.alias("b"))


@book.query(f"WITH {_ROT} SELECT floor(CAST(CAST(cx AS FLOAT) AS DOUBLE) * 1e2 + 0.5) / 1e2 AS x, floor(CAST(CAST(cy AS FLOAT) AS DOUBLE) * 1e2 + 0.5) / 1e2 AS y, CAST(image_id % 256 AS SMALLINT) AS red, CAST(7 AS SMALLINT) AS green, CAST((image_id // 256) % 256 AS SMALLINT) AS blue FROM ce")
def ply_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Camera centres as a binary point cloud, written by many tasks and read in ranges."""
    ply.register(spark)
    path = scratch_path(spark, "cloud")
    cloud = _coloured(spark, sf).select(*[F.col(c).cast("float").alias(c) for c in "xyz"], F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue"))
    cloud.write.format("ply").mode("append").save(path)
    read = spark.read.format("ply").option("rowsPerTask", 100_000).load(path)
    return read.select(*[(F.floor(F.col(c).cast("double") * 1e2 + 0.5) / 1e2).alias(c) for c in "xy"], "red", "green", "blue")


@book.query(r"SELECT regexp_extract(names, '[^/\\]*$') AS name, floor(lla[1] * 1e6 + 0.5) / 1e6 AS lat, floor(lla[2] * 1e6 + 0.5) / 1e6 AS lon FROM gps WHERE names IS NOT NULL AND isfinite(lla[1]) AND isfinite(lla[2])")
def photo_xml_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All deliveries of photo positions as a block export, read again: base names, whatever the style of the folders."""
    g = _positions(spark, sf)
    path = scratch_path(spark, "photos-xml")
    g.select(F.monotonically_increasing_id().alias("Id"), F.col("names").alias("ImagePath"), F.struct(F.struct(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude")).alias("GPS")).alias("ExifData")).write.format("xml").option("rowTag", "Photo").option("rootTag", "Photos").save(path)
    return read_photos(spark, path).select("name", six(F.col("lat")).alias("lat"), six(F.col("lon")).alias("lon"))


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gps").select("names", F.get("lla", F.lit(0)).alias("lat"), F.get("lla", F.lit(1)).alias("lon"), F.get("yaw_pitch", F.lit(0)).alias("yaw"))
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) != double('infinity')" for c in ("lat", "lon"))
    return g.filter(f"names is not null and {finite}")


@book.query(f"WITH {OBS}, im AS (SELECT DISTINCT image_id, name FROM (SELECT image_id, name FROM images UNION ALL SELECT image_id, name FROM anchor_images) WHERE image_id IS NOT NULL AND name IS NOT NULL) SELECT p AS track_id, name FROM o JOIN im ON im.image_id = o.m")
def tie_points_xml_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks as tie points of a block export with measurements by photo id; measurements of unknown photos are dropped."""
    path = scratch_path(spark, "ties-xml")
    both = table(spark, sf, "images").select("image_id", "name").union(table(spark, sf, "anchor_images").select("image_id", "name"))
    known = both.filter("image_id is not null and name is not null").distinct()
    known.select(F.col("image_id").cast("long").alias("Id"), F.concat(F.lit("C:\\flight\\"), "name").alias("ImagePath")).write.format("xml").option("rowTag", "Photo").option("rootTag", "Photos").save(f"{path}/photos")
    ties = observations(spark, sf).groupBy(F.col("point_id").alias("t")).agg(F.collect_list(F.struct(F.col("image_id").cast("long").alias("PhotoId"))).alias("Measurement"))
    ties.select(F.struct(F.col("t").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")).alias("Position"), "Measurement").write.format("xml").option("rowTag", "TiePoint").option("rootTag", "TiePoints").save(f"{path}/ties")
    points, seen = read_tie_points(spark, f"{path}/*")
    return seen.join(points, "point_id").select(F.col("x").cast("long").alias("track_id"), "name")


@book.query(r"SELECT regexp_extract(names, '[^/\\]*$') AS name, floor(lla[1] * 1e6 + 0.5) / 1e6 AS lat, floor(lla[2] * 1e6 + 0.5) / 1e6 AS lon, 3000.5 + 1 AS fx, 2000 + 12.5 AS cx, 1500 - 7.25 AS cy, CAST(0.015 AS DOUBLE) AS k3 FROM gps WHERE names IS NOT NULL AND isfinite(lla[1]) AND isfinite(lla[2])")
def xmp_and_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The attributes that a drone embeds in its photos, found in the text around them, and the calibration among them."""
    g = _positions(spark, sf)
    head = F.concat(F.lit('\x00JFIF <x drone-dji:GpsLatitude="'), F.col("lat").cast("string"), F.lit('" drone-dji:GpsLongitude="'), F.col("lon").cast("string"), F.lit('" drone-dji:DewarpData="2024-01-01;3001.5,3001.5,12.5,-7.25,0.1,0.2,0.001,0.002,0.015"/> \xff'))
    found = xmp_attributes(g.select("names", head.alias("x")), "x").withColumn("k", calibration(F.col("DewarpData"), 4000, 3000))
    name = F.regexp_extract("names", r"(?s)([^/\\]*)\z", 1)
    return found.select(name.alias("name"), six(F.col("GpsLatitude").cast("double")).alias("lat"), six(F.col("GpsLongitude").cast("double")).alias("lon"), "k.fx", "k.cx", "k.cy", "k.k3")


_SIX = ", ".join(f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"))


@book.query(f"WITH {POSED} SELECT image_id, {_SIX}, camera_id, name FROM ps WHERE camera_id IS NOT NULL AND name IS NOT NULL")
def images_binary_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Posed images as a binary model, one file a task, read again."""
    path = scratch_path(spark, "images-bin")
    write_images_binary(posed(spark, sf).filter("image_id is not null and camera_id is not null and name is not null"), path)
    return read_images_binary(spark, path).select("image_id", *[six(F.col(c)).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], "camera_id", "name")


@book.query(f"WITH {_ROT} SELECT name, {_m('cx', 'x')}, {_m('cy', 'y')}, {_m('cz', 'z')} FROM ce WHERE name IS NOT NULL")
def camera_list_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """World-to-camera matrices as a JSON list of cameras; centres read again."""
    r = rotation_of_quaternion(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz"))
    p = posed(spark, sf).filter("name is not null").select("name", r.alias("r"), "tx", "ty", "tz")
    row = lambda k, t: F.array(*[F.get("r", F.lit(3 * k + j)) for j in range(3)], F.col(t))
    path = scratch_path(spark, "cameras-json")
    p.select("name", F.array(row(0, "tx"), row(1, "ty"), row(2, "tz"), F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).alias("w2c"), F.lit(3000.0).alias("fx")).write.json(path)
    c = read_camera_list(spark, path, lines=True)
    return c.select("name", *[milli(F.get("c", F.lit(k))).alias(n) for k, n in enumerate("xyz")])


@book.query(f"WITH {MEASURED}, {POSED} SELECT 'pairs' AS what, count(*) AS n, 2 AS round, TRUE AS resumable FROM mp UNION ALL SELECT 'cameras', count(*), 2, TRUE FROM ps")
def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of a graph and its poses saved; the last complete one is loaded, and may be resumed as its images are the same."""
    path = scratch_path(spark, "rounds")
    cameras = posed(spark, sf).select("image_id", "name", "tx", "ty", "tz")
    pairs = measurements(spark, sf).select("i", "j").distinct()
    save_round(spark, path, 1, {"pairs": pairs.limit(1), "cameras": cameras})
    save_round(spark, path, 2, {"pairs": pairs, "cameras": cameras})
    last = load_round(spark, path)
    same = same_images(last["cameras"], cameras, "name")
    count = lambda what: last[what].agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"), F.lit(2).alias("round"), F.lit(same).alias("resumable"))
    return count("pairs").unionByName(count("cameras"))


@book.query(f"WITH {OBS} SELECT m AS image_id, count(*) AS observations FROM o GROUP BY 1")
def adjustment_tables_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The flat observation table of an adjustment's result with its poses; observations per image after reading."""
    path = scratch_path(spark, "result")
    save_round(spark, path, 1, {"observations": observations(spark, sf), "cameras": posed(spark, sf)})
    return load_round(spark, path)["observations"].groupBy("image_id").agg(F.count(F.lit(1)).alias("observations"))


@book.query(f"WITH {MEASURED} SELECT count(*) AS pairs, floor(avg(mean) * 1e6 + 0.5) / 1e6 AS mean, count(*) FILTER (mean >= 0.2) AS strong FROM mp")
def metrics_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Nested metrics written as JSON and read again."""
    m = measurements(spark, sf).groupBy("i", "j").agg((F.sum("overlap") / F.count(F.lit(1))).alias("mean"))
    a = m.agg(F.count(F.lit(1)).alias("pairs"), six(F.avg("mean")).alias("mean"), F.count_if(F.col("mean") >= 0.2).alias("strong"))
    path = scratch_path(spark, "metrics")
    a.select(F.struct("pairs", F.struct("mean", "strong").alias("overlap")).alias("graph")).write.json(path)
    read = spark.read.schema("graph struct<pairs: bigint, overlap: struct<mean: double, strong: bigint>>").json(path)
    return read.select("graph.pairs", "graph.overlap.mean", "graph.overlap.strong")


@book.query(r"""WITH p AS (SELECT DISTINCT names, list_filter(string_split(replace(names, '\', '/'), '/'), lambda x: x <> '') AS e FROM gps WHERE names IS NOT NULL)
SELECT names, CASE WHEN len(e) = 0 THEN NULL ELSE e[-1] END AS scene, CASE WHEN len(e) = 0 THEN 'root' ELSE e[-1] END AS leaf_scene FROM p""")
def scene_names(spark: SparkSession, sf: str) -> DataFrame:
    """The scene that a path names; the folder of the model itself is passed over."""
    n = table(spark, sf, "gps").select("names").filter("names is not null").distinct()
    return n.select("names", scene_name_of(F.col("names")).alias("scene"), scene_name_of(F.concat(F.lit("root/"), "names", F.lit("/colmap_metrics"))).alias("leaf_scene"))


@book.query(f"WITH {OBS}, t AS (SELECT count(DISTINCT p) AS n FROM o) SELECT n AS points, n AS tie_points, 'points' AS source FROM t UNION ALL SELECT CAST(-1 AS BIGINT), n, 'shared counts only' FROM t")
def reference_scene(spark: SparkSession, sf: str) -> DataFrame:
    """A reference is whole only if it has as many points as tie points; else the shared counts alone are used."""
    obs = observations(spark, sf)
    ties = obs.select("point_id").distinct()
    whole = count_guard(ties, ties)
    short = count_guard(ties.filter("point_id % 2 = 0").unionByName(ties.limit(0)), ties)
    return whole.unionByName(short).withColumn("points", F.coalesce("points", F.lit(-1).cast("long")))


@book.query("WITH b AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type AS kind FROM events), m AS (SELECT max(epoch(ts)) AS last FROM events) SELECT day, kind, count(*) AS n FROM b, m WHERE (day + 1) * 86400 <= last - 86400 GROUP BY 1, 2")
def stream_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Days of events that a watermark of one day has closed, streamed in append mode."""
    out = scratch_path(spark, "closed")
    w = closed_windows(file_stream(spark, f"{sf}/events.parquet"), "ts", "1 day", "1 day", "event_type")
    w.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("start timestamp, kind string, n bigint").parquet(out)
    return read.select(F.floor(F.unix_timestamp("start") / 86400).cast("long").alias("day"), "kind", "n")
