"""Exports of survey software and drones: XML blocks, embedded metadata, camera lists, binary images."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators.ordering import with_index
from skyweave.session import materialise

_PHOTO = "Id bigint, ImagePath string, ExifData struct<GPS: struct<Latitude: double, Longitude: double, Altitude: double>>"
_TIE = "Position struct<x: double, y: double, z: double>, Measurement array<struct<PhotoId: bigint>>"


def _base(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """``photo_id, name, lat, lon, alt`` of the photos of a block export; photos without a path are left out."""
    p = spark.read.format("xml").option("rowTag", "Photo").schema(_PHOTO).load(path)
    gps = F.col("ExifData.GPS")
    return p.filter("ImagePath is not null").select(F.col("Id").alias("photo_id"), _base(F.col("ImagePath")).alias("name"), gps["Latitude"].alias("lat"), gps["Longitude"].alias("lon"), gps["Altitude"].alias("alt"))


def read_tie_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``points(point_id, x, y, z)`` and ``observations(point_id, name)``: point i is the i-th tie point of the document."""
    t = spark.read.format("xml").option("rowTag", "TiePoint").schema(_TIE).load(path)
    held = materialise(t.withColumn("at", F.monotonically_increasing_id()), "tie-points")
    numbered = materialise(with_index(held, [F.col("at")], "point_id"), "tie-points")
    points = numbered.select("point_id", F.col("Position.x").alias("x"), F.col("Position.y").alias("y"), F.col("Position.z").alias("z"))
    seen = numbered.select("point_id", F.explode("Measurement.PhotoId").alias("photo_id"))
    return points, seen.join(read_photos(spark, path).select("photo_id", "name"), "photo_id").select("point_id", "name")


# Names of the attributes that a drone writes into its photos.
XMP_KEYS = ("GpsLatitude", "GpsLongitude", "AbsoluteAltitude", "GimbalYawDegree", "GimbalPitchDegree", "DewarpData")


def read_xmp(spark: SparkSession, path: str, head: int = 300_000) -> DataFrame:
    """``path, name`` and one column per attribute, from the first ``head`` bytes of every photo under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = files.select("path", _base(F.col("path")).alias("name"), F.decode(F.substring("content", 1, head), "ISO-8859-1").alias("x"))
    return xmp_attributes(text, "x").drop("x")


def xmp_attributes(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one column per attribute that ``text`` holds; NULL where it is absent or empty."""
    found = lambda k: F.nullif(F.regexp_extract(text, f'drone-dji:{k}="([^"]*)"', 1), F.lit(""))
    return df.select("*", *[found(k).alias(k) for k in XMP_KEYS])


def calibration(dewarp, width: int, height: int):
    """fx, fy, cx, cy, k1, k2, p1, p2, k3 of ``date;numbers``; the centre is given as an offset from the middle."""
    n = F.split(F.element_at(F.split(dewarp, ";"), -1), ",")
    at = lambda k: F.get(n, F.lit(k)).try_cast("double")
    return F.struct(at(0).alias("fx"), at(1).alias("fy"), (at(2) + width / 2).alias("cx"), (at(3) + height / 2).alias("cy"), *[at(k + 4).alias(c) for k, c in enumerate(("k1", "k2", "p1", "p2", "k3"))])


def read_camera_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``name, r, c`` (camera-to-world rotation and centre) and intrinsics of a JSON list of cameras, or of one camera a line."""
    schema = "name string, w2c array<array<double>>, fx double, fy double, cx double, cy double, width int, height int"
    j = spark.read.schema(schema).json(path, multiLine=not lines).filter("w2c is not null")
    m = lambda i, k: F.get(F.get("w2c", F.lit(i)), F.lit(k))
    turned = F.array(*[m(k, i) for i in range(3) for k in range(3)])
    centre = F.array(*[-(m(0, i) * m(0, 3) + m(1, i) * m(1, 3) + m(2, i) * m(2, 3)) for i in range(3)])
    return j.select("name", turned.alias("r"), centre.alias("c"), "fx", "fy", "cx", "cy", "width", "height")


def listing_problems(spark: SparkSession, path: str) -> DataFrame:
    """``name, n``: file names that occur more than once under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_base(F.col("path")).alias("name"))
    return files.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


_HEAD = "<i7di"


def write_images_binary(images: DataFrame, path: str) -> None:
    """Binary model files without 2D points, one complete file a task, in a folder of a file system that all executors share.

    A file of a task that is repeated replaces the one before; images without a whole pose, lens or name are refused.
    """
    columns = ["image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name"]
    if not images.filter(" or ".join(f"{c} is null" for c in columns)).isEmpty():
        raise ValueError("an image lacks a part of its pose, its lens or its name")
    folder = path.removeprefix("file://").removeprefix("file:")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        rows = [struct.pack(_HEAD, *r[:9]) + r[9].encode() + b"\0" + struct.pack("<Q", 0) for frame in frames for r in frame[columns].itertuples(index=False, name=None)]
        if rows:
            os.makedirs(folder, exist_ok=True)
            hidden = os.path.join(folder, f".part-{part:05d}-{os.getpid()}")
            with open(hidden, "wb") as f:
                f.write(struct.pack("<Q", len(rows)))
                f.writelines(rows)
            os.replace(hidden, os.path.join(folder, f"part-{part:05d}.bin"))
        yield pd.DataFrame({"n": [len(rows)]})

    written = images.select(*columns).mapInPandas(write, "n long").agg(F.sum("n")).first()[0]
    if written and not os.path.isdir(folder):
        raise RuntimeError(f"{folder} is not shared between the driver and the executors")


def read_images_binary(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, qw..qz, tx..tz, camera_id, name`` of binary model files; each file is one task, its 2D points are skipped."""
    columns = ["image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id"]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                (count,) = struct.unpack_from("<Q", content, 0)
                at, rows = 8, []
                for _ in range(count):
                    head = struct.unpack_from(_HEAD, content, at)
                    at += struct.calcsize(_HEAD)
                    end = content.index(b"\0", at)
                    (points,) = struct.unpack_from("<Q", content, end + 1)
                    rows.append((*head, content[at:end].decode()))
                    at = end + 9 + 24 * points
                yield pd.DataFrame(rows, columns=[*columns, "name"])

    schema = "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)
