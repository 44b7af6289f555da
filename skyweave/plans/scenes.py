"""Queries over points on the rays of the tracks' first observations: what cameras see of them, and functions of poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.pose import apply_similarity, centre, compose_similarity, invert_similarity, let, move_pose, project, rotation_of_vector, similarity
from skyweave.functions.vec import cosine, power_mean, root_unit, total, unit
from skyweave.operators.keyed import lookup_join
from skyweave.operators.matching import filter_tracks, residuals
from skyweave.operators.ordering import grouped_quantile, positions_in_group, running_totals, six, with_index
from skyweave.operators.views import bilinear, clipped, early_stop, first_per_key, ground_heights, lift, max_ray_angle, predicted_overlap, two_colours, up_direction
from skyweave.plans.covisibility import _LATEST, newest_observations
from skyweave.plans.geometry import _ROT, _m, centre_points, milli, poses
from skyweave.plans.sequences import _PLACES, places
from skyweave.plans.tables import MEASURED, Book, measurements, table
from skyweave.session import materialise

book = Book()

W, H, FOCAL = 4000, 3000, 3000.0
_IN = "((x - 2000) / 3000)", "((y - 1500) / 3000)"

#: observations with their pose, the first of every track, and its point 40 to 64 units along the ray
_RAYS = f"""{_ROT}, {_LATEST}, ob AS (SELECT t.track_id, t.obs_img, t.obs_feat, t.x, t.y, ro.* EXCLUDE (x, y, z, w) FROM t JOIN ro ON ro.image_id = t.obs_img WHERE t.track_id IS NOT NULL AND isfinite(t.x) AND isfinite(t.y)),
fo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY obs_img, obs_feat) AS k FROM ob) WHERE k = 1),
la AS (SELECT *, d * (x - 2000) / 3000 - tx AS ax, d * (y - 1500) / 3000 - ty AS ay, d - tz AS az FROM (SELECT *, CAST(40 + track_id % 25 AS DOUBLE) AS d FROM fo)),
pt AS (SELECT track_id, r0 * ax + r3 * ay + r6 * az AS px, r1 * ax + r4 * ay + r7 * az AS py, r2 * ax + r5 * ay + r8 * az AS pz FROM la),
se AS (SELECT ob.*, px, py, pz, r0 * px + r1 * py + r2 * pz + tx AS qx, r3 * px + r4 * py + r5 * pz + ty AS qy, r6 * px + r7 * py + r8 * pz + tz AS qz FROM ob JOIN pt USING (track_id))"""


def ray_observations(spark: SparkSession, sf: str) -> DataFrame:
    """``track_id, obs_img, obs_feat, x, y, r, t`` of the newest observations in posed images."""
    obs = newest_observations(spark, sf).filter("track_id is not null and x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) != double('infinity') and abs(y) != double('infinity')")
    return materialise(obs.join(poses(spark, sf).select(F.col("image_id").alias("obs_img"), "r", "t"), "obs_img").select("track_id", "obs_img", "obs_feat", "x", "y", "r", "t"), "ray-observations")


def ray_points(obs: DataFrame) -> DataFrame:
    """``track_id, x`` (array of 3): a point on the ray of each track's first observation, at a depth that depends on the track."""
    first = first_per_key(obs, "track_id", ["obs_img", "obs_feat"])
    depth = (F.lit(40) + F.col("track_id") % 25).cast("double")
    return materialise(first.select("track_id", lift((F.col("x") - 2000) / 3000, (F.col("y") - 1500) / 3000, depth, F.col("r"), F.col("t")).alias("x")), "ray-points")


@book.query(f"WITH {_RAYS} SELECT track_id, {_m('px', 'x')}, {_m('py', 'y')}, {_m('pz', 'z')} FROM pt")
def lifted_points(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels lifted into the world at a depth."""
    return ray_points(ray_observations(spark, sf)).select("track_id", *[milli(F.get("x", F.lit(k))).alias(c) for k, c in enumerate("xyz")])


_PIXEL = "3000 * qx / qz + 2000", "3000 * qy / qz + 1500"
_ERR = f"sqrt(power({_PIXEL[0]} - x, 2) + power({_PIXEL[1]} - y, 2))"


@book.query(
    f"WITH {_RAYS}, er AS (SELECT track_id, obs_img, obs_feat, CASE WHEN qz > 1e-12 THEN {_ERR} END AS e FROM se), gd AS (SELECT * FROM er WHERE e < 1500) "
    f"SELECT track_id, obs_img, obs_feat, {_m('e', 'error')} FROM gd WHERE track_id IN (SELECT track_id FROM gd GROUP BY 1 HAVING count(*) >= 2)"
)
def projected_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Reprojection errors of lifted points below 1,500 pixels, of tracks that keep two observations; points behind a camera never count."""
    obs = ray_observations(spark, sf)
    points = ray_points(obs).select("track_id", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    errors = residuals(obs.withColumnsRenamed({"x": "u", "y": "v"}), points, "track_id", "u", "v", FOCAL, FOCAL, W / 2, H / 2)
    return filter_tracks(errors, "track_id", 1500.0).select("track_id", "obs_img", "obs_feat", milli(F.col("error")).alias("error"))


@book.query(f"WITH {_RAYS} SELECT count(*) AS n, count(*) FILTER (qz > 1e-12) AS ahead, count(*) FILTER (qz > 1e-12 AND {_PIXEL[0]} >= 0 AND {_PIXEL[0]} < 4000 AND {_PIXEL[1]} >= 0 AND {_PIXEL[1]} < 3000) AS inside FROM se")
def projection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many observations have their point ahead of the camera and inside of the image."""
    obs = ray_observations(spark, sf)
    met = obs.join(ray_points(obs).withColumnRenamed("x", "p"), "track_id").withColumn("q", project(F.col("r"), F.col("t"), F.col("p"), F.lit(FOCAL), F.lit(FOCAL), F.lit(W / 2), F.lit(H / 2)))
    inside = F.expr(f"q.z > 1e-12 and q.u >= 0 and q.u < {W} and q.v >= 0 and q.v < {H}")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q.z") > 1e-12).alias("ahead"), F.count_if(inside).alias("inside"))


_ANGLES = f"""{_RAYS}, ry AS (SELECT se.track_id, se.obs_img, se.obs_feat, px - cx AS dx, py - cy AS dy, pz - cz AS dz FROM se JOIN ce ON ce.image_id = se.obs_img),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY obs_img, obs_feat) AS k FROM ry) WHERE k = 1),
an AS (SELECT ry.track_id, max(degrees(acos(greatest(-1, least(1, (ry.dx * r1.dx + ry.dy * r1.dy + ry.dz * r1.dz) / (sqrt(ry.dx * ry.dx + ry.dy * ry.dy + ry.dz * ry.dz) * sqrt(r1.dx * r1.dx + r1.dy * r1.dy + r1.dz * r1.dz) + 1e-12)))))) AS a FROM ry JOIN r1 USING (track_id) GROUP BY 1)"""


@book.query(f"WITH {_ANGLES} SELECT track_id, floor(a * 1e2 + 0.5) / 1e2 AS max_angle FROM an")
def track_ray_angles(spark: SparkSession, sf: str) -> DataFrame:
    """The widest angle of each track's rays to the ray of its first observation."""
    obs = ray_observations(spark, sf)
    a = max_ray_angle(obs, ray_points(obs), "track_id", ["obs_img", "obs_feat"])
    return a.select("track_id", (F.floor(F.col("max_angle") * 1e2 + 0.5) / 1e2).alias("max_angle"))


@book.query(f"WITH {_ANGLES}, n AS (SELECT track_id, count(*) AS views FROM ob GROUP BY 1), e AS (SELECT track_id, avg(least(CASE WHEN qz > 1e-12 THEN {_ERR} ELSE 1e4 END, 1e4)) AS e FROM se GROUP BY 1) SELECT track_id, views FROM n JOIN e USING (track_id) JOIN an USING (track_id) WHERE views >= 3 AND e <= 5000 AND a >= 1")
def point_quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of at least 3 views, with a mean error (at most 10,000 pixels each) of up to 5,000 and rays at least 1 degree apart."""
    obs = ray_observations(spark, sf)
    points = ray_points(obs)
    flat = points.select("track_id", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    e = residuals(obs.withColumnsRenamed({"x": "u", "y": "v"}), flat, "track_id", "u", "v", FOCAL, FOCAL, W / 2, H / 2)
    g = e.groupBy("track_id").agg(F.count(F.lit(1)).alias("views"), F.avg(F.least("error", F.lit(1e4))).alias("mean_error"))
    a = max_ray_angle(obs, points, "track_id", ["obs_img", "obs_feat"])
    return g.join(a, "track_id").filter("views >= 3 and mean_error <= 5000 and max_angle >= 1").select("track_id", "views")


@book.query(
    f"WITH {_RAYS}, uv AS (SELECT -avg(r6) AS u0, -avg(r7) AS u1, -avg(r8) AS u2 FROM ro), up AS (SELECT u0 / n AS u0, u1 / n AS u1, u2 / n AS u2 FROM (SELECT *, sqrt(u0 * u0 + u1 * u1 + u2 * u2) AS n FROM uv)), "
    f"ht AS (SELECT DISTINCT ob.obs_img, ob.track_id, px * u0 + py * u1 + pz * u2 AS h FROM ob JOIN pt USING (track_id), up) SELECT obs_img AS image_id, floor(median(h) * 1e2 + 0.5) / 1e2 AS height FROM ht GROUP BY 1"
)
def ground_height(spark: SparkSession, sf: str) -> DataFrame:
    """The median height of the points that each image observes."""
    obs = ray_observations(spark, sf)
    g = ground_heights(obs, ray_points(obs), up_direction(poses(spark, sf)), "track_id", "obs_img")
    return g.select(F.col("obs_img").alias("image_id"), (F.floor(F.col("height") * 1e2 + 0.5) / 1e2).alias("height"))


@book.query(
    f"WITH {_RAYS}, {MEASURED}, sm AS (SELECT obs_img, track_id FROM (SELECT *, row_number() OVER (PARTITION BY obs_img ORDER BY md5(CAST(track_id AS VARCHAR)), track_id) AS k FROM (SELECT DISTINCT obs_img, track_id FROM ob)) WHERE k <= 100), "
    "pr AS (SELECT i, j FROM mp JOIN ro a ON a.image_id = i JOIN ro b ON b.image_id = j), di AS (SELECT i, j FROM pr UNION ALL SELECT j, i FROM pr), "
    "sh AS (SELECT di.i, di.j, count(pt.track_id) AS n, count(*) FILTER (gz > 1e-12 AND 3000 * gx / gz + 2000 >= 0 AND 3000 * gx / gz + 2000 < 4000 AND 3000 * gy / gz + 1500 >= 0 AND 3000 * gy / gz + 1500 < 3000) AS hit FROM di LEFT JOIN sm ON sm.obs_img = di.i LEFT JOIN pt USING (track_id) JOIN ro ON ro.image_id = di.j, "
    "LATERAL (SELECT r0 * px + r1 * py + r2 * pz + tx AS gx, r3 * px + r4 * py + r5 * pz + ty AS gy, r6 * px + r7 * py + r8 * pz + tz AS gz) GROUP BY 1, 2) "
    "SELECT least(i, j) AS i, greatest(i, j) AS j, floor(min(CASE WHEN n > 0 THEN hit / n ELSE 0 END) * 1e6 + 0.5) / 1e6 AS overlap FROM sh GROUP BY 1, 2"
)
def predicted_view_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of measured pairs as predicted by projecting each camera's points, 100 at most, into the other one."""
    obs = ray_observations(spark, sf)
    pairs = measurements(spark, sf).select("i", "j").distinct()
    cameras = poses(spark, sf).select(F.col("image_id").alias("image"), "r", "t")
    o = obs.select(F.col("obs_img").alias("image"), F.col("track_id").alias("track"))
    p = predicted_overlap(pairs.join(cameras.select(F.col("image").alias("i")), "i", "left_semi").join(cameras.select(F.col("image").alias("j")), "j", "left_semi"), o, ray_points(obs).withColumnRenamed("track_id", "track"), cameras, W, H, FOCAL, most=100)
    return p.select("i", "j", six(F.col("overlap")).alias("overlap"))


def _world(k) -> F.Column:
    """A similarity that depends on a number: a turn about the vertical, a scale and a shift."""
    a = F.radians((k % 36) * 10)
    r = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return similarity(1 + (k % 5) / 4, r, F.array((k % 7).cast("double"), (k % 11).cast("double"), (k % 3).cast("double")))


_MOVED = "SELECT image_id, s * (c * cx - n * cy) + image_id % 7 AS x, s * (n * cx + c * cy) + image_id % 11 AS y, s * cz + image_id % 3 AS z, cx, cy, cz FROM (SELECT *, 1 + (image_id % 5) / 4 AS s, cos(radians((image_id % 36) * 10)) AS c, sin(radians((image_id % 36) * 10)) AS n FROM ce)"


@book.query(f"WITH {_ROT} SELECT image_id, {_m('x', 'x')}, {_m('y', 'y')}, {_m('z', 'z')} FROM ({_MOVED})")
def moved_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Camera centres after the world has been moved by a similarity, from the moved poses."""
    p = poses(spark, sf).withColumn("m", _world(F.col("image_id")))
    r, t = move_pose(F.col("m"), F.col("r"), F.col("t"))
    moved = p.select("image_id", r.alias("r"), t.alias("t"), F.col("m.s").alias("s"))
    # depths scale with the world, so a pose keeps a rotation and its translation carries the scale
    c = moved.select("image_id", centre(F.col("r"), F.col("t")).alias("c"))
    return c.select("image_id", *[milli(F.get("c", F.lit(k))).alias(n) for k, n in enumerate("xyz")])


@book.query(f"WITH {_ROT} SELECT image_id, {_m('x', 'x')}, {_m('y', 'y')}, {_m('z', 'z')}, {_m('cx', 'back_x')}, {_m('cy', 'back_y')}, {_m('cz', 'back_z')} FROM ({_MOVED})")
def similarity_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Centres moved by a similarity, and moved back by its inverse through a composition."""
    p = poses(spark, sf).select("image_id", "c", _world(F.col("image_id")).alias("m"))
    there = let(F.col("m"), lambda m: apply_similarity(m, F.col("c")))
    moved = p.select("image_id", "m", there.alias("x"))
    # (m^-1 after m) after m^-1 is m^-1
    inverse = moved.select("image_id", "x", "m", invert_similarity(F.col("m")).alias("n")).select("image_id", "x", compose_similarity(compose_similarity(F.col("n"), F.col("m")), F.col("n")).alias("n"))
    back = inverse.select("image_id", "x", apply_similarity(F.col("n"), F.col("x")).alias("b"))
    return back.select("image_id", *[milli(F.get("x", F.lit(k))).alias(n) for k, n in enumerate("xyz")], *[milli(F.get("b", F.lit(k))).alias(f"back_{n}") for k, n in enumerate("xyz")])


_EXP = """v AS (SELECT image_id, tx / 100 AS x, ty / 100 AS y, tz / 100 AS z FROM ps), th AS (SELECT *, sqrt(x * x + y * y + z * z) AS h FROM v),
sc AS (SELECT *, CASE WHEN h > 1e-8 THEN sin(h) / h ELSE 1 END AS s, CASE WHEN h > 1e-8 THEN (1 - cos(h)) / (h * h) ELSE 0.5 END AS c FROM th)"""
_EXPS = ("1 - c * (y * y + z * z)", "c * x * y - s * z", "c * x * z + s * y", "c * x * y + s * z", "1 - c * (x * x + z * z)", "c * y * z - s * x", "c * x * z - s * y", "c * y * z + s * x", "1 - c * (x * x + y * y)")


@book.query(f"WITH {_ROT}, {_EXP} SELECT image_id, " + ", ".join(_m(f"{e} + 0.00007", f"r{k}") for k, e in enumerate(_EXPS)) + " FROM sc")
def rotation_exponential(spark: SparkSession, sf: str) -> DataFrame:
    """Rotations of vectors made of the translations."""
    p = poses(spark, sf).select("image_id", rotation_of_vector(F.transform("t", lambda x: x / 100)).alias("r"))
    return p.select("image_id", *[milli(F.get("r", F.lit(k)) + 0.00007).alias(f"r{k}") for k in range(9)])


@book.query(
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS a FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, lead(v) OVER (ORDER BY vec_id) AS nx FROM e) "
    "SELECT vec_id, floor(list_sum(list_transform(v, lambda x: x / n)) * 1e4 + 0.5) / 1e4 AS unit_sum, floor(power(list_sum(list_transform(a, lambda x: power(greatest(x, 1e-6), 3))) / len(a), 1.0 / 3) * 1e4 + 0.5) / 1e4 AS gem, "
    "floor(list_sum(list_transform(a, lambda x: sqrt(x / greatest(list_sum(a), 1e-12)))) * 1e4 + 0.5) / 1e4 AS root_sum, floor(list_inner_product(v, nx) / (n * sqrt(list_sum(list_transform(nx, lambda x: x * x)))) * 1e4 + 0.5) / 1e4 AS cosine FROM n WHERE nx IS NOT NULL"
)
def vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Normalisation, generalised mean, square-root normalisation, and the cosine with the next vector."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = with_index(e, [F.col("vec_id")], "k")
    both = n.join(n.select((F.col("k") - 1).alias("k"), F.col("embedding").alias("nx")), "k")
    four = lambda c: F.floor(c * 1e4 + 0.5) / 1e4
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return both.select("vec_id", four(total(unit("embedding"))).alias("unit_sum"), four(power_mean(size)).alias("gem"), four(total(root_unit(size))).alias("root_sum"), four(cosine("embedding", "nx")).alias("cosine"))


_GRID = """gr AS (SELECT obs_img AS image, CAST(floor(x / 64) AS BIGINT) AS ix, CAST(floor(y / 64) AS BIGINT) AS iy, avg(conf) AS value FROM t WHERE isfinite(x) AND isfinite(y) AND conf IS NOT NULL GROUP BY 1, 2, 3),
qs AS (SELECT obs_img AS image, obs_feat AS q, x / 64 AS gx, y / 64 AS gy FROM t WHERE isfinite(x) AND isfinite(y))"""


@book.query(
    f"WITH {_LATEST}, {_GRID} SELECT qs.image, q, floor((a.value * (1 - fx) * (1 - fy) + b.value * fx * (1 - fy) + c.value * (1 - fx) * fy + d.value * fx * fy) * 1e4 + 0.5) / 1e4 AS value FROM (SELECT *, CAST(floor(gx) AS BIGINT) AS x0, CAST(floor(gy) AS BIGINT) AS y0, gx - floor(gx) AS fx, gy - floor(gy) AS fy FROM qs) qs "
    "JOIN gr a ON a.image = qs.image AND a.ix = x0 AND a.iy = y0 JOIN gr b ON b.image = qs.image AND b.ix = x0 + 1 AND b.iy = y0 JOIN gr c ON c.image = qs.image AND c.ix = x0 AND c.iy = y0 + 1 JOIN gr d ON d.image = qs.image AND d.ix = x0 + 1 AND d.iy = y0 + 1"
)
def grid_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Observations looked up between the means of 64-pixel cells; those next to an empty cell have no value and are left out."""
    t = newest_observations(spark, sf).filter("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) != double('infinity') and abs(y) != double('infinity')")
    grid = t.filter("conf is not null").groupBy(F.col("obs_img").alias("image"), F.floor(F.col("x") / 64).alias("ix"), F.floor(F.col("y") / 64).alias("iy")).agg(F.avg("conf").alias("value"))
    found = bilinear(t.select(F.col("obs_img").alias("image"), F.col("obs_feat").alias("q"), (F.col("x") / 64).alias("gx"), (F.col("y") / 64).alias("gy")), grid)
    return found.filter("value is not null").select("image", "q", (F.floor(F.col("value") * 1e4 + 0.5) / 1e4).alias("value"))


@book.query(
    f"WITH {_ROT}, q AS (SELECT quantile_cont(cz, 0.02) AS lo, quantile_cont(cz, 0.98) AS hi FROM ce), p AS (SELECT image_id, greatest(0, least(1, (cz - lo) / greatest(hi - lo, 1e-9))) AS p FROM ce, q) "
    "SELECT image_id, CAST(floor(30 * (1 - p) + 250 * p + 0.003) AS INTEGER) AS red, CAST(floor(60 * (1 - p) + 80 * p + 0.003) AS INTEGER) AS green, CAST(floor(200 * (1 - p) + 20 * p + 0.003) AS INTEGER) AS blue FROM p"
)
def height_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Colours by height, from the 2nd to the 98th percentile of all cameras."""
    p = materialise(centre_points(spark, sf).select("image_id", "z", F.lit(1).alias("all")), "heights")
    bounds = grouped_quantile(p, "all", "z", 0.02, "lo").join(grouped_quantile(p, "all", "z", 0.98, "hi"), "all").select("lo", "hi")
    at = clipped(F.col("z"), F.col("lo"), F.col("hi"))
    c = p.crossJoin(F.broadcast(bounds)).select("image_id", two_colours(at, (30.003, 60.003, 200.003), (250.003, 80.003, 20.003)).alias("c"))  # one row of bounds
    return c.select("image_id", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("red", "green", "blue"))])


@book.query(
    f"WITH {_PLACES}, s AS (SELECT seq, name, row_number() OVER (PARTITION BY seq ORDER BY name) - 1 AS step, round(lat, 9) AS v FROM pl), m AS (SELECT seq, step, avg(v) OVER (PARTITION BY seq ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS late, "
    "avg(v) OVER (PARTITION BY seq ORDER BY step ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS early FROM s) SELECT seq, min(step) AS step FROM m WHERE step >= 7 AND floor(late * 1e7 + 0.5) > floor(early * 1e7 + 0.5) GROUP BY 1"
)
def stalled_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The first step at which the mean of four values is not below that of the four before, with latitudes as the values of a sequence."""
    p = positions_in_group(places(spark, sf), "seq", [F.col("name")], "step")
    coarse = p.select("seq", "step", F.round("lat", 9).alias("v"))
    return early_stop(coarse, "seq", "step", "v", least_gain=0.0)


@book.query("WITH t AS (SELECT DISTINCT obs_img, obs_feat FROM track_obs WHERE obs_img IS NOT NULL AND obs_feat IS NOT NULL) SELECT obs_img, obs_feat, row_number() OVER (ORDER BY obs_img, obs_feat) - 1 AS key_id FROM t")
def keypoint_store(spark: SparkSession, sf: str) -> DataFrame:
    """Keypoints appended image by image: the number of an image's first one, plus the place in the image."""
    t = materialise(table(spark, sf, "track_obs").select("obs_img", "obs_feat").filter("obs_img is not null and obs_feat is not null").distinct(), "keypoints")
    counts = t.groupBy("obs_img").agg(F.count(F.lit(1)).alias("n"))
    first = running_totals(counts, [F.col("obs_img")], {"upto": F.col("n")}).select("obs_img", (F.col("upto") - F.col("n")).alias("first"))
    placed = positions_in_group(t, "obs_img", [F.col("obs_feat")], "place")
    return lookup_join(placed, first, "obs_img", "inner").select("obs_img", "obs_feat", (F.col("first") + F.col("place")).alias("key_id"))


@book.query(f"WITH {_ROT}, a AS (SELECT cx, cy, cz, row_number() OVER (ORDER BY image_id) - 1 AS k FROM ce) SELECT (SELECT count(*) FROM a) AS points, (SELECT count(*) // 2 FROM a) AS first_points, (SELECT count(*) // 2 FROM a) AS equal, TRUE AS prefix")
def cloud_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one cloud is the beginning of another: equal coordinates at equal places."""
    a = materialise(with_index(centre_points(spark, sf), [F.col("image_id")], "k"), "cloud-a")
    n = a.agg(F.count(F.lit(1)).alias("points"))
    b = a.crossJoin(F.broadcast(n)).filter(F.col("k") < F.floor(F.col("points") / 2)).select("k", "x", "y", "z")  # one row
    same = a.join(b, ["k", "x", "y", "z"]).agg(F.count(F.lit(1)).alias("equal"))
    one = n.crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("first_points")))).crossJoin(F.broadcast(same))
    return one.select("points", "first_points", "equal", (F.col("equal") == F.col("first_points")).alias("prefix"))
