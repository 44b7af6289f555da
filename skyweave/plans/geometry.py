"""Poses, geodesy, estimates and point clouds over the images and photo positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.geo import ecef, enu
from skyweave.functions.pose import angle_between_deg, centre, direction_angle_deg, multiply, quaternion_of_rotation, relative, rotation_of_gimbal, rotation_of_quaternion, transpose
from skyweave.functions.vec import distance, norm
from skyweave.operators.cloud import median_cells, mutual_matches, nearest_of_set, voxel_counts, voxel_representative, voxel_size_for
from skyweave.operators.estimators import SIMILARITY, mean_rotation, robust_similarity_fit, triangulate
from skyweave.operators.keyed import latest
from skyweave.operators.matching import sound_points
from skyweave.operators.ordering import six
from skyweave.operators.spatial import nearest_points
from skyweave.plans.covisibility import newest_observations
from skyweave.plans.photos import photo_positions
from skyweave.plans.sequences import _PLACES, places
from skyweave.plans.tables import MEASURED, POSED, Book, measurements, posed, table
from skyweave.session import materialise

book = Book()

milli = lambda c: F.floor(c * 1e3 + 0.5) / 1e3
cents = lambda c: F.floor(c * 1e2 + 0.5) / 1e2


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """``image_id, camera_id, name, r, t, c``: rotation, translation and centre of every posed image."""
    r = rotation_of_quaternion(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz"))
    p = posed(spark, sf).select("image_id", "camera_id", "name", r.alias("r"), F.array("tx", "ty", "tz").alias("t"))
    return p.withColumn("c", centre(F.col("r"), F.col("t")))


_ROT = POSED + """, un AS (SELECT image_id, camera_id, name, tx, ty, tz, qw / n AS w, qx / n AS x, qy / n AS y, qz / n AS z FROM (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n FROM ps)),
ro AS (SELECT image_id, camera_id, name, tx, ty, tz, 1 - 2 * (y * y + z * z) AS r0, 2 * (x * y - w * z) AS r1, 2 * (x * z + w * y) AS r2, 2 * (x * y + w * z) AS r3, 1 - 2 * (x * x + z * z) AS r4,
 2 * (y * z - w * x) AS r5, 2 * (x * z - w * y) AS r6, 2 * (y * z + w * x) AS r7, 1 - 2 * (x * x + y * y) AS r8, w, x, y, z FROM un),
ce AS (SELECT image_id, camera_id, name, -(r0 * tx + r3 * ty + r6 * tz) AS cx, -(r1 * tx + r4 * ty + r7 * tz) AS cy, -(r2 * tx + r5 * ty + r8 * tz) AS cz FROM ro)"""


def _m(c: str, name: str) -> str:
    return f"floor(({c}) * 1e3 + 0.5) / 1e3 AS {name}"


@book.query(f"WITH {_ROT} SELECT image_id, " + ", ".join(_m(f"r{k} + 0.00007", f"r{k}") for k in range(9)) + " FROM ro")
def quaternion_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Rotation matrices to 3 decimals; shifted a little, so that exact zeros do not sit on a rounding step."""
    return poses(spark, sf).select("image_id", *[milli(F.get("r", F.lit(k)) + 0.00007).alias(f"r{k}") for k in range(9)])


@book.query(f"WITH {_ROT} SELECT image_id, " + ", ".join(_m(f"{c} * (CASE WHEN w < 0 THEN -1 ELSE 1 END) + 0.00007", f"q{c}") for c in "wxyz") + " FROM ro")
def rotation_quaternion(spark: SparkSession, sf: str) -> DataFrame:
    """Back from the matrix: the quaternion with a positive w."""
    q = poses(spark, sf).withColumn("q", quaternion_of_rotation(F.col("r")))
    return q.select("image_id", *[milli(F.get("q", F.lit(k)) + 0.00007).alias(f"q{c}") for k, c in enumerate("wxyz")])


@book.query(f"WITH {_ROT} SELECT image_id, " + ", ".join(_m(c, c) for c in ("cx", "cy", "cz")) + " FROM ce")
def camera_centres(spark: SparkSession, sf: str) -> DataFrame:
    return poses(spark, sf).select("image_id", *[milli(F.get("c", F.lit(k))).alias(n) for k, n in enumerate(("cx", "cy", "cz"))])


@book.query(f"WITH {_ROT}, an AS (SELECT cx, cy, cz FROM ce WHERE image_id IN (SELECT image_id FROM anchor_images)) SELECT ce.image_id, {_m('min(sqrt(power(ce.cx - an.cx, 2) + power(ce.cy - an.cy, 2) + power(ce.cz - an.cz, 2)))', 'd')} FROM ce, an GROUP BY 1")
def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every camera from the nearest anchor."""
    p = centre_points(spark, sf)
    anchors = p.join(table(spark, sf, "anchor_images").select("image_id"), "image_id", "left_semi")
    return nearest_of_set(p, anchors, "image_id", ["x", "y", "z"]).select("image_id", milli(F.col("d")).alias("d"))


@book.query(f"WITH {_PLACES} SELECT name, {_m('n * cos(radians(lat)) * cos(radians(lon))', 'x')}, {_m('n * cos(radians(lat)) * sin(radians(lon))', 'y')}, {_m('n * (1 - 6.69437999014e-3) * sin(radians(lat))', 'z')} FROM (SELECT *, 6378137.0 / sqrt(1 - 6.69437999014e-3 * power(sin(radians(lat)), 2)) AS n FROM pl)")
def geodetic_ecef(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = ecef(F.col("lat"), F.col("lon"))
    return places(spark, sf).select("name", milli(x).alias("x"), milli(y).alias("y"), milli(z).alias("z"))


_ECEF = "6378137.0 / sqrt(1 - 6.69437999014e-3 * power(sin(radians({la})), 2))"
_XYZ = "{n} * cos(radians({la})) * cos(radians({lo})) AS {p}x, {n} * cos(radians({la})) * sin(radians({lo})) AS {p}y, {n} * (1 - 6.69437999014e-3) * sin(radians({la})) AS {p}z"
_ENU = (
    _PLACES
    + ", o1 AS (SELECT seq, arg_min(lon, name) AS lon1 FROM pl GROUP BY 1), oo AS (SELECT seq, avg(lat) AS la0, avg(lon + 360 * round((lon1 - lon) / 360)) AS lo0 FROM pl JOIN o1 USING (seq) GROUP BY 1), "
    + "xx AS (SELECT name, seq, la0, lo0, " + _XYZ.format(n="(" + _ECEF.format(la="lat") + ")", la="lat", lo="lon", p="a") + ", " + _XYZ.format(n="(" + _ECEF.format(la="la0") + ")", la="la0", lo="lo0", p="o") + " FROM pl JOIN oo USING (seq)), "
    + "dd AS (SELECT name, seq, ax - ox AS dx, ay - oy AS dy, az - oz AS dz, sin(radians(la0)) AS sp, cos(radians(la0)) AS cp, sin(radians(lo0)) AS sl, cos(radians(lo0)) AS cl FROM xx)"
)


def enu_places(spark: SparkSession, sf: str) -> DataFrame:
    """``name, seq, e, n, u``: metres from the mean position of the sequence at height 0.

    Longitudes are averaged within 180 degrees of that of the sequence's smallest name, so the date line does not matter.
    """
    p = places(spark, sf)
    first = p.groupBy("seq").agg(F.min_by("lon", "name").alias("lon1"))
    near = p.join(first, "seq").withColumn("near", F.col("lon") + 360 * F.round((F.col("lon1") - F.col("lon")) / 360))
    origin = near.groupBy("seq").agg(F.avg("lat").alias("lat0"), F.avg("near").alias("lon0"))
    e, n, u = enu(F.col("lat"), F.col("lon"), F.lit(0.0), F.col("lat0"), F.col("lon0"), F.lit(0.0))
    return p.join(origin, "seq").select("name", "seq", e.alias("e"), n.alias("n"), u.alias("u"))


@book.query(f"WITH {_ENU} SELECT name, {_m('cl * dy - sl * dx', 'e')}, {_m('cp * dz - sp * (cl * dx + sl * dy)', 'n')} FROM dd")
def geodetic_enu(spark: SparkSession, sf: str) -> DataFrame:
    return enu_places(spark, sf).select("name", milli(F.col("e")).alias("e"), milli(F.col("n")).alias("n"))


_GIMBAL = r"""gg AS (SELECT * FROM (SELECT regexp_extract(names, '[^/\\]*$') AS name, yaw_pitch[1] AS yaw, yaw_pitch[2] AS pitch, row_number() OVER (PARTITION BY regexp_extract(names, '[^/\\]*$') ORDER BY received_at DESC NULLS LAST, yaw_pitch[1] DESC NULLS LAST, yaw_pitch[2] DESC NULLS LAST) k FROM gps WHERE names IS NOT NULL)
  WHERE k = 1 AND yaw IS NOT NULL AND pitch IS NOT NULL AND NOT isnan(yaw) AND NOT isnan(pitch))"""


def gimbals(spark: SparkSession, sf: str) -> DataFrame:
    """``name, yaw, pitch``: the latest complete gimbal angles of every photo."""
    g = table(spark, sf, "gps").filter("names is not null")
    g = g.select(F.regexp_extract("names", r"(?s)([^/\\]*)\z", 1).alias("name"), F.get("yaw_pitch", F.lit(0)).alias("yaw"), F.get("yaw_pitch", F.lit(1)).alias("pitch"), "received_at")
    return latest(g, ["name"], "received_at", ["yaw", "pitch"]).filter("yaw is not null and pitch is not null and not isnan(yaw) and not isnan(pitch)").select("name", "yaw", "pitch")


@book.query(
    f"WITH {_GIMBAL} SELECT name, " + ", ".join(_m(f"{c} + 0.00007", n) for n, c in (("right_e", "cos(radians(yaw))"), ("right_n", "-sin(radians(yaw))"), ("ahead_e", "sin(radians(yaw)) * cos(radians(pitch))"), ("ahead_n", "cos(radians(yaw)) * cos(radians(pitch))"), ("ahead_u", "sin(radians(pitch))"), ("down_u", "-cos(radians(pitch))"))) + " FROM gg"
)
def gimbal_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Axes of the camera from the gimbal angles."""
    g = gimbals(spark, sf).withColumn("r", rotation_of_gimbal(F.col("yaw"), F.col("pitch")))
    return g.select("name", *[milli(F.get("r", F.lit(k)) + 0.00007).alias(n) for n, k in (("right_e", 0), ("right_n", 1), ("ahead_e", 6), ("ahead_n", 7), ("ahead_u", 8), ("down_u", 5))])


@book.query(r"WITH i AS (SELECT DISTINCT image_id, name FROM (SELECT image_id, name FROM images UNION ALL SELECT image_id, name FROM anchor_images)), " + _PLACES + " SELECT image_id, i.name, pl.name IS NOT NULL AS has_position FROM i LEFT JOIN pl ON pl.name = i.name")
def gps_left_join_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Which images have a position."""
    i = table(spark, sf, "images").select("image_id", "name").unionByName(table(spark, sf, "anchor_images").select("image_id", "name")).distinct()
    p = photo_positions(spark, sf).filter("lat is not null and lon is not null").select("name", F.lit(True).alias("known"))
    return i.join(p, "name", "left").select("image_id", "name", F.col("known").isNotNull().alias("has_position"))


@book.query(f"WITH {_ROT}, {MEASURED} SELECT mp.i, mp.j, {_m('sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2) + power(a.cz - b.cz, 2))', 'baseline')} FROM mp JOIN ce a ON a.image_id = mp.i JOIN ce b ON b.image_id = mp.j")
def pair_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Distance between the cameras of measured pairs."""
    p = poses(spark, sf)
    pairs = measurements(spark, sf).select("i", "j").distinct()
    both = pairs.join(p.select(F.col("image_id").alias("i"), F.col("c").alias("ci")), "i").join(p.select(F.col("image_id").alias("j"), F.col("c").alias("cj")), "j")
    return both.select("i", "j", milli(distance("ci", "cj")).alias("baseline"))


_GIMBALS = _GIMBAL + """, gr AS (SELECT name, cos(radians(yaw)) AS r0, -sin(radians(yaw)) AS r1, 0.0 AS r2, sin(radians(yaw)) * sin(radians(pitch)) AS r3, cos(radians(yaw)) * sin(radians(pitch)) AS r4, -cos(radians(pitch)) AS r5,
 sin(radians(yaw)) * cos(radians(pitch)) AS r6, cos(radians(yaw)) * cos(radians(pitch)) AS r7, sin(radians(pitch)) AS r8 FROM gg)"""
_LOCAL = _ENU + ", en AS (SELECT name, seq, cl * dy - sl * dx AS e, cp * dz - sp * (cl * dx + sl * dy) AS n, cp * (cl * dx + sl * dy) + sp * dz AS u FROM dd)"


def _pose_sql(source: str, out: str) -> str:
    """Relative rotation and shift of the pairs of ``source``, which has rotations a0.. and b0.. and shifts at0.. and bt0..."""
    r = [" + ".join(f"b{3 * i + k} * a{3 * j + k}" for k in range(3)) for i in range(3) for j in range(3)]
    turned = f"SELECT *, {', '.join(f'{x} AS m{k}' for k, x in enumerate(r))} FROM {source}"
    return f"SELECT i, j, {', '.join(f'm{k} AS {out}{k}' for k in range(9))}, " + ", ".join(f"bt{i} - ({' + '.join(f'm{3 * i + k} * at{k}' for k in range(3))}) AS {out}t{i}" for i in range(3)) + f" FROM ({turned})"


def _sides(left: str, columns: list[str], shift: list[str]) -> str:
    one = lambda side, name: ", ".join(f"{side}.{c} AS {name}{k}" for k, c in enumerate(columns)) + ", " + ", ".join(f"{side}.{c} AS {name}t{k}" for k, c in enumerate(shift))
    return f"(SELECT mp.i, mp.j, {one('x', 'a')}, {one('y', 'b')} FROM mp JOIN {left} x ON x.image_id = mp.i JOIN {left} y ON y.image_id = mp.j)"


_R = [f"r{k}" for k in range(9)]
_TB = ", ".join(f"-(gr.r{3 * k} * e + gr.r{3 * k + 1} * n + gr.r{3 * k + 2} * u) AS tb{k}" for k in range(3))
_POSE_ERRORS = (
    f"WITH {_ROT}, {_LOCAL}, {_GIMBALS}, {MEASURED}, bb AS (SELECT ro.image_id, ro.r0 AS w0, ro.r1 AS w1, ro.r2 AS w2, ro.r3 AS w3, ro.r4 AS w4, ro.r5 AS w5, ro.r6 AS w6, ro.r7 AS w7, ro.r8 AS w8, tx, ty, tz, {', '.join(f'gr.r{k} AS g{k}' for k in range(9))}, {_TB} FROM ro JOIN en USING (name) JOIN gr USING (name)), "
    f"p1 AS ({_pose_sql(_sides('bb', [f'w{k}' for k in range(9)], ['tx', 'ty', 'tz']), 'u')}), p2 AS ({_pose_sql(_sides('bb', [f'g{k}' for k in range(9)], ['tb0', 'tb1', 'tb2']), 'v')}) "
    f"SELECT i, j, floor(degrees(acos(greatest(-1, least(1, ({' + '.join(f'u{k} * v{k}' for k in range(9))} - 1) / 2)))) * 1e2 + 0.5) / 1e2 AS rotation_deg, "
    f"CASE WHEN least({' + '.join(f'ut{k} * ut{k}' for k in range(3))}, {' + '.join(f'vt{k} * vt{k}' for k in range(3))}) < 1e-6 THEN -1.0 ELSE "
    f"floor(degrees(acos(greatest(-1, least(1, ({' + '.join(f'ut{k} * vt{k}' for k in range(3))}) / (sqrt({' + '.join(f'ut{k} * ut{k}' for k in range(3))}) * sqrt({' + '.join(f'vt{k} * vt{k}' for k in range(3))}) + 1e-12))))) * 1e2 + 0.5) / 1e2 END AS direction_deg FROM p1 JOIN p2 USING (i, j)"
)


@book.query(_POSE_ERRORS)
def relative_pose_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Rotation and translation-direction errors of the poses against those of position and gimbal, over measured pairs.

    Two cameras at one place have no direction between them: -1.
    """
    a = poses(spark, sf).select("image_id", "name", "r", "t")
    b = enu_places(spark, sf).join(gimbals(spark, sf), "name").withColumn("rb", rotation_of_gimbal(F.col("yaw"), F.col("pitch")))
    b = b.select("name", "rb", F.transform(F.array(*[sum((F.get("rb", F.lit(3 * i + k)) * F.col(c) for k, c in enumerate("enu")), F.lit(0.0)) for i in range(3)]), lambda x: -x).alias("tb"))
    p = a.join(b, "name").select("image_id", "r", "t", "rb", "tb")
    side = lambda s: p.select(F.col("image_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("r", "t", "rb", "tb")])
    both = measurements(spark, sf).select("i", "j").distinct().join(side("i"), "i").join(side("j"), "j")
    r1, t1 = relative(F.col("r_i"), F.col("t_i"), F.col("r_j"), F.col("t_j"))
    r2, t2 = relative(F.col("rb_i"), F.col("tb_i"), F.col("rb_j"), F.col("tb_j"))
    return both.select("i", "j", r1.alias("r1"), t1.alias("t1"), r2.alias("r2"), t2.alias("t2")).select("i", "j", cents(angle_between_deg(F.col("r1"), F.col("r2"))).alias("rotation_deg"), F.when(F.least(norm("t1"), norm("t2")) < 1e-3, -1.0).otherwise(cents(direction_angle_deg(F.col("t1"), F.col("t2")))).alias("direction_deg"))


@book.query()
def mean_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """The chordal mean rotation of every lens."""
    return mean_rotation(poses(spark, sf), "camera_id", "r")


@book.query()
def sequence_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity that takes each sequence's local metres to its camera centres, fitted with trimming."""
    c = poses(spark, sf).select("name", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(3)])
    both = enu_places(spark, sf).join(c, "name")
    return robust_similarity_fit(both, "seq", ["e", "n", "u"], ["c0", "c1", "c2"]).select("seq", "n", *SIMILARITY)


def posed_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The newest observations of tracks, with ``r`` and ``t`` of their images."""
    obs = newest_observations(spark, sf).filter("track_id is not null and x is not null and y is not null")
    return materialise(obs.join(poses(spark, sf).select(F.col("image_id").alias("obs_img"), "r", "t"), "obs_img"), "posed-observations")


def track_points(obs: DataFrame) -> DataFrame:
    points = materialise(triangulate(obs, "track_id", (F.col("x") - 2000.0) / 3000.0, (F.col("y") - 1500.0) / 3000.0, "r", "t"), "points")
    return sound_points(obs, points, "track_id", "x", "y", 3000.0, 3000.0, 2000.0, 1500.0, 64.0)


@book.query()
def triangulated_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the tracks with at least 2 posed views, for a focal length of 3,000 pixels and a centre of (2,000, 1,500).

    A track counts if all its views are ahead and within 64 pixels, and two of its rays are at least 1 degree apart.
    """
    return track_points(posed_observations(spark, sf)).filter("views >= 2")


_VOXEL = ", ".join(f"CAST(floor(c{a} / 25) AS BIGINT) AS v{a}" for a in "xyz")


def centre_points(spark: SparkSession, sf: str) -> DataFrame:
    return poses(spark, sf).select("image_id", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("x", "y", "z"))])


@book.query(f"WITH {_ROT} SELECT {_VOXEL}, count(*) AS n FROM ce GROUP BY 1, 2, 3")
def voxel_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return voxel_counts(centre_points(spark, sf), ["x", "y", "z"], 25.0)


@book.query(f"WITH {_ROT} SELECT {_VOXEL}, min(image_id) AS image_id FROM ce GROUP BY 1, 2, 3")
def voxel_first(spark: SparkSession, sf: str) -> DataFrame:
    """The camera with the smallest id in every voxel."""
    r = voxel_representative(centre_points(spark, sf), "image_id", ["x", "y", "z"], 25.0, F.lit(0))
    return r.select("vx", "vy", "vz", "image_id")


_THINNING = f"""WITH RECURSIVE {_ROT}, h(k, lo, hi) AS (
  SELECT 0, CAST(0.01 AS DOUBLE), CAST(10000 AS DOUBLE)
  UNION ALL
  SELECT k + 1, CASE WHEN n > most THEN size ELSE lo END, CASE WHEN n > most THEN hi ELSE size END FROM (
    SELECT k, lo, hi, size, count(DISTINCT (floor(cx / size), floor(cy / size), floor(cz / size))) AS n, greatest(1, count(*) // 2) AS most
    FROM (SELECT k, lo, hi, sqrt(lo * hi) AS size FROM h WHERE k < 20), ce GROUP BY 1, 2, 3, 4)),
v AS (SELECT hi AS voxel FROM h WHERE k = 20)
SELECT image_id, {_m('cx', 'x')}, {_m('cy', 'y')}, {_m('cz', 'z')}, floor(voxel * 1e6 + 0.5) / 1e6 AS voxel FROM (
  SELECT *, row_number() OVER (PARTITION BY floor(cx / voxel), floor(cy / voxel), floor(cz / voxel) ORDER BY md5(CAST(image_id AS VARCHAR)), image_id) AS r FROM ce, v) WHERE r = 1"""


@book.query(_THINNING)
def voxel_thinning(spark: SparkSession, sf: str) -> DataFrame:
    """One camera per voxel, with the voxel size bisected so that at most half as many voxels as cameras remain."""
    points = materialise(centre_points(spark, sf), "thinning")
    size = voxel_size_for(points, ["x", "y", "z"], max(1, points.count() // 2), 0.01, 10_000.0)
    kept = voxel_representative(points, "image_id", ["x", "y", "z"], size)
    return kept.select("image_id", *[milli(F.col(c)).alias(c) for c in "xyz"], six(F.lit(size)).alias("voxel"))


_NEAR = f"""{_PLACES}, xe AS (SELECT name, lat, lon, {_XYZ.format(n="(" + _ECEF.format(la="lat") + ")", la="lat", lo="lon", p="")} FROM pl),
ds AS (SELECT a.name, b.name AS other, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM xe a JOIN xe b ON a.name <> b.name),
kn AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(d, 6), other) AS r FROM ds)"""


@book.query(f"WITH {_NEAR} SELECT name, other, CAST(r AS INTEGER) AS rank FROM kn WHERE r <= 4")
def nearest_photos(spark: SparkSession, sf: str) -> DataFrame:
    """The four nearest photos of every photo."""
    n = nearest_points(places(spark, sf), "name", "lat", "lon", 4)
    return n.select(F.col("key").alias("name"), "other", "rank")


@book.query(f"WITH {_NEAR} SELECT name, {_m('avg(d)', 'mean_m')}, avg(d) > 30 AS outlier FROM kn WHERE r <= 16 GROUP BY 1")
def position_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Photos whose 16 nearest neighbours are farther than 30 m on average."""
    n = nearest_points(places(spark, sf), "name", "lat", "lon", 16)
    return n.groupBy(F.col("key").alias("name")).agg(milli(F.avg("dist_m")).alias("mean_m"), (F.avg("dist_m") > 30).alias("outlier"))


_CELLS = f"""WITH RECURSIVE {_ROT}, k(id, x, y, cell, n) AS (
  SELECT image_id, cx, cy, CAST(1 AS BIGINT), (SELECT count(*) FROM ce) FROM ce
  UNION ALL
  SELECT id, x, y, cell, count(*) OVER (PARTITION BY cell) FROM (
    SELECT id, x, y, cell * 2 + CASE WHEN row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN by_x THEN x ELSE y END, id) - 1 >= n // 2 THEN 1 ELSE 0 END AS cell FROM (
      SELECT *, max(x) OVER (PARTITION BY cell) - min(x) OVER (PARTITION BY cell) >= max(y) OVER (PARTITION BY cell) - min(y) OVER (PARTITION BY cell) AS by_x FROM k WHERE n > 64)))
SELECT id AS image_id, cell FROM k WHERE n <= 64"""


@book.query(_CELLS)
def median_split_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of at most 64 cameras by recursive median splits of their ground positions."""
    return median_cells(centre_points(spark, sf), "image_id", "x", "y", 64)


_MNN = """u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
d AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, sqrt(greatest(2 - 2 * round(list_inner_product(a.v, b.v), 12), 0)) AS d FROM u a JOIN u b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY label, b ORDER BY d, a) AS rb, lead(d) OVER (PARTITION BY label, a ORDER BY d, b) AS second FROM d)
SELECT label, a, b, floor(d * 1e6 + 0.5) / 1e6 AS distance FROM r WHERE ra = 1 AND rb = 1 AND d < 0.97 * second"""


@book.query("WITH " + _MNN)
def mutual_nearest_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual nearest neighbours of even and odd vectors with one label, with a ratio test."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    m = mutual_matches(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "label", "vec_id", "embedding", ratio=0.97)
    return m.select("label", "a", "b", six(F.col("distance")).alias("distance"))


@book.query(f"WITH {_ROT}, {MEASURED} SELECT count(*) AS pairs, {_m('max(abs(x.r0 * y.r0 + x.r1 * y.r1 + x.r2 * y.r2 + x.r3 * y.r3 + x.r4 * y.r4 + x.r5 * y.r5 + x.r6 * y.r6 + x.r7 * y.r7 + x.r8 * y.r8))', 'largest_trace')} FROM mp JOIN ro x ON x.image_id = mp.i JOIN ro y ON y.image_id = mp.j")
def relative_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Largest trace of the relative rotations of measured pairs."""
    p = poses(spark, sf)
    pairs = measurements(spark, sf).select("i", "j").distinct()
    both = pairs.join(p.select(F.col("image_id").alias("i"), F.col("r").alias("ri")), "i").join(p.select(F.col("image_id").alias("j"), F.col("r").alias("rj")), "j")
    both = both.withColumn("m", multiply(F.col("rj"), transpose(F.col("ri"))))
    trace = F.abs(F.get("m", F.lit(0)) + F.get("m", F.lit(4)) + F.get("m", F.lit(8)))
    return both.agg(F.count(F.lit(1)).alias("pairs"), milli(F.max(trace)).alias("largest_trace"))
