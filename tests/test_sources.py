import json
import struct

import pytest
from pyspark.sql import functions as F

from skyweave.sources import colmap, exports, ply, snapshots
from skyweave.streaming.accumulators import accumulate_pairs, accumulated_pairs, closed_windows, file_stream


def test_text_models(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# cameras\n\n1 SIMPLE_RADIAL 100 80 90.5 50 40 0.1\n2 PINHOLE 100 80 90 91 50 40\n 3 OPENCV x 80 90 91 50 40 0 0 0 0\n")
    (tmp_path / "images.txt").write_text("# images\n1 1 0 0 0 1.5 2 3 1 a_001.JPG\n\n2 1 0 0 0 1 2 3 1 b.png\n1 2 3 4 5 6 7 8 9 10\n12 4 3\n")
    (tmp_path / "points.txt").write_text("# p\n7 1 2 3 10 20 30 0.5 1 2\n")
    c = {r.camera_id: r for r in colmap.read_cameras(spark, str(tmp_path / "cameras.txt")).collect()}
    assert (c[1].fx, c[1].fy, c[1].cx) == (90.5, 90.5, 50.0) and (c[2].fy, c[2].cx) == (91.0, 50.0) and c[3].width is None
    i = colmap.read_images(spark, str(tmp_path / "images.txt"))
    assert [(r.image_id, r.tx, r.name) for r in i.orderBy("image_id").collect()] == [(1, 1.5, "a_001.JPG"), (2, 1.0, "b.png")]
    assert tuple(colmap.read_points(spark, str(tmp_path / "points.txt")).first()) == (7, 1.0, 2.0, 3.0, 10, 20, 30)
    colmap.write_images(i, str(tmp_path / "out"))
    colmap.write_cameras(colmap.read_cameras(spark, str(tmp_path / "cameras.txt")).filter("width is not null"), str(tmp_path / "cams"))
    assert sorted(colmap.read_images(spark, str(tmp_path / "out")).collect()) == sorted(i.collect())
    assert colmap.read_cameras(spark, str(tmp_path / "cams")).count() == 2
    with pytest.raises(ValueError):
        colmap.write_images(i.withColumn("qw", F.lit(None).cast("double")), str(tmp_path / "no"))
    assert colmap.scene_name("/x/site/colmap_metrics") == "site" and colmap.scene_name("/x/site/") == "site"


def test_point_clouds(spark, tmp_path):
    ply.register(spark)
    df = spark.range(1000).select((F.col("id") / 4).cast("float").alias("x"), F.lit(1.5).cast("float").alias("y"), F.lit(-2.0).cast("float").alias("z"), (F.col("id") % 256).cast("smallint").alias("red"), F.lit(7).cast("smallint").alias("green"), F.lit(255).cast("smallint").alias("blue"))
    path = str(tmp_path / "cloud")
    df.repartition(3).write.format("ply").mode("append").save(path)
    back = spark.read.format("ply").option("rowsPerTask", 100).load(path)
    assert back.rdd.getNumPartitions() >= 10 and sorted(back.collect()) == sorted(df.collect())
    df.limit(5).coalesce(1).write.format("ply").mode("overwrite").save(path)
    assert spark.read.format("ply").load(path).count() == 5
    extra = tmp_path / "other.ply"
    extra.write_bytes(b"ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex 2\nproperty double x\nproperty double y\nproperty double z\nproperty float nx\nend_header\n" + struct.pack("<dddfdddf", 1, 2, 3, 9, 4, 5, 6, 9))
    assert [(r.x, r.z, r.red) for r in spark.read.format("ply").load(str(extra)).collect()] == [(1.0, 3.0, None), (4.0, 6.0, None)]


def test_block_exports(spark, tmp_path):
    photo = lambda k, path, gps: f"<Photo><Id>{k}</Id><ImagePath>{path}</ImagePath>" + (f"<ExifData><GPS><Latitude>{gps}</Latitude><Longitude>8</Longitude><Altitude>90</Altitude></GPS></ExifData>" if gps else "") + "</Photo>"
    tie = lambda x, *ids: f"<TiePoint><Position><x>{x}</x><y>0</y><z>0</z></Position>" + "".join(f"<Measurement><PhotoId>{i}</PhotoId><x>1</x></Measurement>" for i in ids) + "</TiePoint>"
    body = "<B><SRS><Id>77</Id></SRS><Photos>" + photo(5, "c:\\fly\\a.jpg", 50.5) + photo(6, "/fly/b.jpg", None) + "</Photos><T>" + tie(1, 5, 6) + tie(2, 6) + tie(3, 5, 99) + "</T></B>"
    (tmp_path / "at.xml").write_text(body)
    path = str(tmp_path / "at.xml")
    assert {(r.photo_id, r.name, r.lat) for r in exports.read_photos(spark, path).collect()} == {(5, "a.jpg", 50.5), (6, "b.jpg", None)}
    points, seen = exports.read_tie_points(spark, path)
    assert {(r.point_id, r.x) for r in points.collect()} == {(0, 1.0), (1, 2.0), (2, 3.0)}
    assert {(r.point_id, r.name) for r in seen.collect()} == {(0, "a.jpg"), (0, "b.jpg"), (1, "b.jpg"), (2, "a.jpg")}


def test_metadata_lists_and_binary_images(spark, tmp_path):
    shots = tmp_path / "shots"
    (shots / "x").mkdir(parents=True)
    (shots / "a.jpg").write_bytes(b'\xff\xd8..drone-dji:GpsLatitude="+50.5" drone-dji:DewarpData="2024-01-01;3000,3001,5,-6,0.1,0.2,0.3,0.4,0.5"' + b"\0" * 99)
    (shots / "x" / "a.jpg").write_bytes(b"none")
    m = exports.read_xmp(spark, str(shots)).withColumn("k", exports.calibration(F.col("DewarpData"), 100, 80))
    got = sorted(m.collect(), key=lambda r: r.path)
    assert got[0].GpsLatitude == "+50.5" and (got[0].k.fx, got[0].k.cx, got[0].k.cy, got[0].k.k3) == (3000.0, 55.0, 34.0, 0.5) and got[1].GpsLatitude is None
    assert [tuple(r) for r in exports.listing_problems(spark, str(shots)).collect()] == [("a.jpg", 2)]
    (tmp_path / "c.json").write_text(json.dumps([{"name": "n", "w2c": [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]], "fx": 1, "fy": 1, "cx": 0, "cy": 0, "width": 9, "height": 8}]))
    c = exports.read_camera_list(spark, str(tmp_path / "c.json")).first()
    assert c.c == [-2.0, 1.0, -3.0] and c.r == [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    record = lambda k, name, n: struct.pack("<i7di", k, 1, 0, 0, 0, 1, 2, 3, 4) + name.encode() + b"\0" + struct.pack("<Q", n) + b"\1" * 24 * n
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + record(1, "a.jpg", 3) + record(2, "ö.jpg", 0))
    assert {(r.image_id, r.tz, r.camera_id, r.name) for r in exports.read_images_binary(spark, str(tmp_path / "images.bin")).collect()} == {(1, 3.0, 4, "a.jpg"), (2, 3.0, 4, "ö.jpg")}


def test_snapshots_show_complete_rounds_only(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert snapshots.latest_round(spark, path) is None
    with pytest.raises(FileNotFoundError):
        snapshots.load_round(spark, path)
    snapshots.save_round(spark, path, 1, {"a": spark.range(3), "b": spark.range(1)})
    spark.range(9).write.parquet(f"{path}/round=2/a")  # a round that was not finished
    assert snapshots.latest_round(spark, path) == 1 and snapshots.load_round(spark, path)["a"].count() == 3


def test_streams_of_several_batches(spark, tmp_path):
    data = [(1, 2, 0.5), (2, 1, 1.5), (1, 1, 9.0), (3, 4, None), (4, 3, 2.0), (1, 2, 1.0)]
    for k in range(3):
        spark.createDataFrame(data[2 * k : 2 * k + 2], "a int, b int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    accumulate_pairs(stream, "a", "b", "v", out, str(tmp_path / "state")).awaitTermination()
    assert {(r.i, r.j): (r.total, r.n, r.top, r["mean"]) for r in accumulated_pairs(spark, out).collect()} == {(1, 2): (3.0, 3, 1.5, 1.0), (3, 4): (2.0, 1, 2.0, 2.0)}
    accumulate_pairs(stream, "a", "b", "v", out, str(tmp_path / "state")).awaitTermination()  # nothing new
    assert accumulated_pairs(spark, out).filter("i = 1").first().n == 3


def test_watermark_closes_windows(spark, tmp_path):
    day = "timestamp'2024-01-01 {}'"
    rows = spark.createDataFrame([("00:10:00", "x"), ("00:50:00", "x"), ("03:00:00", "y")], "t string, k string").select(F.expr(day.format("00:00:00")).alias("d"), F.expr("to_timestamp(concat('2024-01-01 ', t))").alias("at"), "k")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = closed_windows(file_stream(spark, str(tmp_path / "in")), "at", "30 minutes", "1 hour", "k").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "o"))
    q.awaitTermination()
    assert [(r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("x", 2)]
