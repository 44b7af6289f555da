"""Fits to what is known: the tables' poses and points are moved, projected or disturbed in a stated way, and must be found again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.pose import angle_between_deg, apply_similarity, centre, invert_similarity, move_pose, multiply, project, rotation_of_vector
from skyweave.operators.adjust import Lens, bundle_adjust, staged_adjustment
from skyweave.operators.epipolar import relative_poses
from skyweave.operators.estimators import ROTATION, flight_offsets, line_fit, mean_rotation, robust_similarity_fit, triangulate
from skyweave.operators.frames import fit_from_cameras, fit_gps_gimbal, merge_by_positions, merge_frames, place_images
from skyweave.operators.keyed import lookup_join
from skyweave.operators.matching import average_rotations, relative_from_absolute, sound_points

from skyweave.plans.geometry import _ROT, _m, milli, poses
from skyweave.plans.scenes import _PIXEL, _RAYS, FOCAL, H, W, _world, ray_observations, ray_points
from skyweave.plans.tables import MEASURED, VIEWS, Book, measurements, table, views
from skyweave.session import materialise

book = Book()

_KNOWN = "SELECT {k}, {n}, floor((1 + ({k} % 5) / 4) * 1e3 + 0.5) / 1e3 AS s, {c} AS r0, {s} AS r3, CAST({k} % 7 AS DOUBLE) AS t0, CAST({k} % 11 AS DOUBLE) AS t1, CAST({k} % 3 AS DOUBLE) AS t2"


def _known(key: str, n: str, source: str) -> str:
    turn = lambda f: f"floor({f}(radians(({key} % 36) * 10)) * 1e3 + 0.50007) / 1e3"
    return _KNOWN.format(k=key, n=n, c=turn("cos"), s=turn("sin")) + f" FROM {source}"


def _shown(m: str) -> list[Column]:
    part = lambda c, k: F.get(f"{m}.{c}", F.lit(k))
    turn = lambda k: F.floor(part("r", k) * 1e3 + 0.50007) / 1e3
    return [milli(F.col(f"{m}.s")).alias("s"), turn(0).alias("r0"), turn(3).alias("r3"), *[milli(part("t", k) + 1e-5).alias(f"t{k}") for k in range(3)]]


@book.query(f"WITH {_ROT}, g AS (SELECT image_id % 3 AS grp, count(*) AS n FROM ce GROUP BY 1) {_known('grp', 'n', 'g')}")
def planted_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarities found from centres and their moved places, of which every eleventh image is far off."""
    p = poses(spark, sf).select("image_id", (F.col("image_id") % 3).alias("grp"), "c").withColumn("m", _world(F.col("grp"))).select("image_id", "grp", "c", apply_similarity(F.col("m"), F.col("c")).alias("d"))
    far = F.when(F.col("image_id") % 11 == 0, 500.0).otherwise(0.0)
    flat = p.select("grp", *[F.get("c", F.lit(k)).alias(f"a{k}") for k in range(3)], (F.get("d", F.lit(0)) + far).alias("b0"), *[F.get("d", F.lit(k)).alias(f"b{k}") for k in (1, 2)])
    n = flat.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    fit = robust_similarity_fit(flat, "grp", ["a0", "a1", "a2"], ["b0", "b1", "b2"], rounds=2)
    m = fit.select("grp", F.struct("s", F.array(*ROTATION).alias("r"), F.array("t0", "t1", "t2").alias("t")).alias("m"))
    return n.join(m, "grp").select("grp", "n", *_shown("m"))


def _two_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras in the world and in a frame that the similarity of their group takes to it; every eleventh camera is turned and shifted."""
    p = poses(spark, sf).select("image_id", (F.col("image_id") % 3).alias("grp"), "r", "t").withColumn("m", _world(F.col("grp")))
    p = p.withColumn("bad", F.when(F.col("image_id") % 11 == 0, 0.5).otherwise(0.0))
    p = p.withColumn("wrong", rotation_of_vector(F.array("bad", F.lit(0.0), F.lit(0.0))))
    # arrays that later steps use are columns of their own, so that each is found once a row
    r, t = move_pose(F.col("m"), F.col("r"), F.col("t"))
    p = p.select("grp", "image_id", "bad", "wrong", F.col("r").alias("rs"), centre(F.col("r"), F.col("t")).alias("cs"), r.alias("r"), t.alias("t"))
    moved = p.select("grp", "image_id", "rs", "cs", multiply(F.col("wrong"), F.col("r")).alias("rd"), centre(F.col("r"), F.col("t")).alias("c"), "bad")
    return materialise(moved.select("grp", "image_id", "rs", "cs", "rd", F.transform("c", lambda x: x + F.col("bad") * 800).alias("cd")), "two-frames")


@book.query(f"WITH {_ROT}, g AS (SELECT image_id % 3 AS grp, count(*) FILTER (image_id % 11 <> 0) AS inliers FROM ce GROUP BY 1) {_known('grp', 'inliers', 'g')}")
def planted_links(spark: SparkSession, sf: str) -> DataFrame:
    """Similarities between two frames from cameras known in both and ratios of depths; cameras that are off are left out."""
    c = _two_frames(spark, sf)
    ratios = c.select("grp", (F.log(1 + (F.col("grp") % 5) / 4) + F.when(F.col("image_id") % 11 == 0, 0.7).otherwise(0.0)).alias("v"))
    fit = fit_from_cameras(c, "grp", ratios)
    return fit.select("grp", "inliers", *_shown("m"))


@book.query(f"WITH {_ROT}, g AS (SELECT image_id % 3 AS grp, count(*) AS n FROM ce GROUP BY 1) {_known('grp', 'n', 'g')}")
def planted_gimbals(spark: SparkSession, sf: str) -> DataFrame:
    """Similarities with the rotation from gimbals and scale and shift from positions."""
    c = _two_frames(spark, sf).select("grp", F.col("rs").alias("r"), F.col("cs").alias("c"), F.col("cd").alias("g"), F.col("rd").alias("rg"))
    return fit_gps_gimbal(c, "grp", rounds=2).select("grp", "n", *_shown("m"))


@book.query(f"WITH {_ROT}, g AS (SELECT image_id % 3 AS grp, CAST(count(*) AS DOUBLE) AS n FROM ce GROUP BY 1) {_known('grp', 'n', 'g')}")
def planted_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters placed by measured positions alone."""
    c = _two_frames(spark, sf)
    members = c.select(F.col("grp").alias("cluster"), F.col("image_id").alias("image"), F.col("rs").alias("r"), F.col("cs").alias("c"))
    found = merge_by_positions(members, c.select(F.col("image_id").alias("image"), F.col("cd").alias("g")), rounds=2)
    return found.select(F.col("cluster").cast("int").alias("grp"), "n", *_shown("m"))


_CLUSTERS = f"""{_ROT}, {VIEWS}, me AS (SELECT DISTINCT vw.batch_id AS cluster, vw.image_id AS image FROM vw JOIN ro ON ro.image_id = vw.image_id WHERE vw.batch_id IS NOT NULL),
lk AS (SELECT DISTINCT a.cluster AS p, b.cluster AS q FROM me a JOIN me b USING (image) WHERE a.cluster <> b.cluster),
rt AS (SELECT cluster FROM me GROUP BY 1 ORDER BY count(*) DESC, cluster LIMIT 1),
rc(cluster) AS (SELECT cluster FROM rt UNION SELECT lk.q FROM rc JOIN lk ON lk.p = rc.cluster)"""


@book.query(f"WITH RECURSIVE {_CLUSTERS} SELECT DISTINCT image AS image_id, floor(cx * 1e2 + 0.5) / 1e2 AS x, floor(cy * 1e2 + 0.5) / 1e2 AS y, floor(cz * 1e2 + 0.5) / 1e2 AS z FROM me JOIN rc USING (cluster) JOIN ce ON ce.image_id = image")
def planted_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Batches as clusters with frames of their own, merged down the tree of the largest overlaps; the images' centres in the world."""
    p = poses(spark, sf).select("image_id", "r", "t")
    v = views(spark, sf).filter("batch_id is not null and image_id is not null").select(F.col("batch_id").alias("cluster"), "image_id").distinct()
    v = v.join(p, "image_id").withColumn("w", invert_similarity(_world(F.col("cluster"))))
    r, t = move_pose(F.col("w"), F.col("r"), F.col("t"))
    members = materialise(v.select("cluster", F.col("image_id").alias("image"), r.alias("r"), centre(r, t).alias("c"), F.col("w.s").alias("s")), "clusters")
    depths = members.select("cluster", "image", F.explode(F.array(F.lit(1), F.lit(2))).alias("pixel"), (10 * F.col("s")).alias("depth"))
    merged = materialise(merge_frames(members, depths), "clusters-merged")
    root = merged.filter("depth = 0").select(_world(F.col("cluster")).alias("world"))  # one row
    placed = place_images(members, merged).crossJoin(F.broadcast(root)).select("image", apply_similarity(F.col("world"), F.col("c")).alias("c"))
    return placed.select(F.col("image").alias("image_id"), *[(F.floor(F.get("c", F.lit(k)) * 1e2 + 0.5) / 1e2).alias(n) for k, n in enumerate("xyz")])


def exact_observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Observations at the exact pixel of their track's point, where that is ahead of the camera, and the points."""
    obs = ray_observations(spark, sf)
    points = ray_points(obs)
    met = lookup_join(obs.drop("x", "y"), points.withColumnRenamed("x", "p"), "track_id", "inner").withColumn("q", project(F.col("r"), F.col("t"), F.col("p"), F.lit(FOCAL), F.lit(FOCAL), F.lit(W / 2), F.lit(H / 2)))
    exact = met.filter(F.col("q.z") > 1).select("track_id", "obs_img", "obs_feat", F.col("q.u").alias("x"), F.col("q.v").alias("y"), "r", "t")
    return materialise(exact, "exact-observations"), points


_WIDE = f"""{_RAYS}, ah AS (SELECT se.track_id, se.obs_img, se.obs_feat, px - cx AS dx, py - cy AS dy, pz - cz AS dz FROM se JOIN ce ON ce.image_id = se.obs_img WHERE qz > 1),
wd AS (SELECT a.track_id, max(degrees(acos(greatest(-1, least(1, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (sqrt(a.dx * a.dx + a.dy * a.dy + a.dz * a.dz) * sqrt(b.dx * b.dx + b.dy * b.dy + b.dz * b.dz) + 1e-12)))))) AS a FROM ah a JOIN ah b ON a.track_id = b.track_id AND (a.obs_img, a.obs_feat) < (b.obs_img, b.obs_feat) GROUP BY 1)"""


@book.query(f"WITH {_WIDE} SELECT track_id, floor(px * 1e2 + 0.5) / 1e2 AS x, floor(py * 1e2 + 0.5) / 1e2 AS y, floor(pz * 1e2 + 0.5) / 1e2 AS z FROM wd JOIN pt USING (track_id) WHERE a >= 1")
def planted_triangulation(spark: SparkSession, sf: str) -> DataFrame:
    """Points found again from their pixels, of tracks with two rays at least 1 degree apart."""
    obs, _ = exact_observations(spark, sf)
    found = materialise(triangulate(obs, "track_id", (F.col("x") - 2000.0) / 3000.0, (F.col("y") - 1500.0) / 3000.0, "r", "t"), "planted-points")
    sound = sound_points(obs, found, "track_id", "x", "y", FOCAL, FOCAL, W / 2, H / 2, 64.0)
    return sound.filter("views >= 2").select("track_id", *[(F.floor(F.col(c) * 1e2 + 0.5) / 1e2).alias(c) for c in "xyz"])


@book.query(f"WITH {_ROT}, {MEASURED} SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS off, TRUE AS aligned FROM mp JOIN ro a ON a.image_id = mp.i JOIN ro b ON b.image_id = mp.j")
def averaged_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """Rotations averaged over measured pairs from a start that is off by up to some degrees, with a few relative rotations that are wrong by 40.

    The relative rotations of the result must be those of the poses within a degree, and the whole must not have turned away from the start.
    """
    p = poses(spark, sf).select("image_id", "r")
    pairs = measurements(spark, sf).select("i", "j").distinct()
    both = pairs.join(p.select(F.col("image_id").alias("i"), F.col("r").alias("ri")), "i").join(p.select(F.col("image_id").alias("j"), F.col("r").alias("rj")), "j")
    true = materialise(both.select("i", "j", relative_from_absolute(F.col("ri"), F.col("rj")).alias("rij")), "true-edges")
    wrong = F.when((F.col("i") * 31 + F.col("j")) % 37 == 0, F.lit(0.7)).otherwise(F.lit(0.0))
    edges = true.select("i", "j", multiply(rotation_of_vector(F.array(F.lit(0.0), F.lit(0.0), wrong)), F.col("rij")).alias("rij"))
    shake = lambda k: F.radians(F.lit(4.0)) * (F.pmod(F.xxhash64("image_id", F.lit(k)), F.lit(1000)) / 500.0 - 1)
    start = materialise(p.select(F.col("image_id").alias("node"), multiply(rotation_of_vector(F.array(shake(1), shake(2), shake(3))), F.col("r")).alias("r")), "shaken")
    found = materialise(average_rotations(edges, start, tolerance_deg=0.1), "averaged")
    f = lambda side, name: found.select(F.col("node").alias(side), F.col("r").alias(name))
    judged = true.join(f("i", "ai"), "i").join(f("j", "aj"), "j").withColumn("e", angle_between_deg(relative_from_absolute(F.col("ai"), F.col("aj")), F.col("rij")))
    turned = found.join(start.withColumnRenamed("r", "was"), "node").agg((F.avg(angle_between_deg(F.col("r"), F.col("was"))) < 6).alias("aligned"))
    return judged.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("e") > 1).alias("off")).crossJoin(F.broadcast(turned))  # one row each


def _disturbed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact observations of tracks with two or more, cameras and points that are a little off."""
    exact, points = exact_observations(spark, sf)
    inside = exact.filter(f"x >= 0 and x < {W} and y >= 0 and y < {H}")
    many = inside.groupBy("track_id").agg(F.countDistinct("obs_img").alias("n")).filter("n >= 2").select("track_id")
    obs = materialise(lookup_join(inside, many, "track_id", "inner").select(F.col("obs_img").alias("image"), F.col("track_id").alias("track"), F.col("x").alias("u"), F.col("y").alias("v")), "disturbed")
    shake = lambda key, k, size: (F.pmod(F.xxhash64(key, F.lit(k)), F.lit(1000)) / 500.0 - 1) * size
    cameras = poses(spark, sf).select(F.col("image_id").alias("image"), multiply(rotation_of_vector(F.array(*[shake("image_id", k, 3e-4) for k in range(3)])), F.col("r")).alias("r"), F.transform("t", lambda x: x).alias("t"))
    moved = points.select(F.col("track_id").alias("track"), F.array(*[F.get("x", F.lit(k)) + shake("track_id", k, 0.02) for k in range(3)]).alias("x"))
    return obs, materialise(cameras, "disturbed-cameras"), materialise(moved.join(obs.select("track").distinct(), "track", "left_semi"), "disturbed-points")


@book.query("SELECT TRUE AS falls, TRUE AS small")
def adjustment_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Bundle adjustment of disturbed cameras and points: the cost never rises, and falls below a tenth."""
    obs, cameras, points = _disturbed(spark, sf)
    _, _, _, history = bundle_adjust(obs, cameras, points, Lens(FOCAL, W / 2, H / 2), rounds=5)
    falls = all(b <= a * (1 + 1e-9) for a, b in zip(history, history[1:], strict=False))
    return spark.createDataFrame([(falls, history[-1] <= 0.1 * history[0])], "falls boolean, small boolean")


@book.query("SELECT TRUE AS within, TRUE AS paired, TRUE AS nothing_new")
def staged_adjustment_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Stages at 16, 8 and 4 pixels: what is left lies within the last limit, in tracks of two or more, and was there before."""
    obs, cameras, points = _disturbed(spark, sf)
    wild = obs.withColumn("u", F.when((F.col("track") + F.col("image")) % 29 == 0, F.col("u") + 300).otherwise(F.col("u")))
    cameras, points, left, lens = staged_adjustment(wild, cameras, points, Lens(FOCAL, W / 2, H / 2), rounds=1)
    met = left.join(cameras, "image").join(points, "track").withColumn("q", project(F.col("r"), F.col("t"), F.col("x"), F.lit(lens.f), F.lit(lens.f), F.lit(lens.cx), F.lit(lens.cy)))
    error = F.sqrt(F.pow(F.col("q.u") - F.col("u"), F.lit(2.0)) + F.pow(F.col("q.v") - F.col("v"), F.lit(2.0)))
    within = met.agg(F.coalesce(F.max(error) < 4, F.lit(True)).alias("within"))
    paired = left.groupBy("track").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.min("n") >= 2, F.lit(True)).alias("paired"))
    new = left.join(wild, ["image", "track", "u", "v"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("nothing_new"))
    return within.crossJoin(F.broadcast(paired)).crossJoin(F.broadcast(new))  # one row each


@book.query(f"WITH {_ROT} SELECT coalesce(camera_id, -1) AS camera_id, CAST(count(*) AS BIGINT) AS n, TRUE AS rotation, TRUE AS best FROM ro GROUP BY 1")
def mean_rotation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of every lens's chordal mean: it is a rotation, and no small turn about an axis brings it nearer to the lens's rotations."""
    p = materialise(poses(spark, sf).select("camera_id", "r"), "mean-poses")
    mean = mean_rotation(p, "camera_id", "r").select("camera_id", "n", F.array(*ROTATION).alias("m"))
    sums = p.groupBy("camera_id").agg(F.array(*[F.sum(F.get("r", F.lit(k))) for k in range(9)]).alias("sum"))
    both = mean.join(sums.withColumnRenamed("camera_id", "c2"), F.col("camera_id").eqNullSafe(F.col("c2")))
    # a turn by a small angle about an axis mixes two rows: its effect on the inner product with the sum, to second order
    row = lambda a, b: sum((F.get("m", F.lit(3 * a + k)) * F.get("sum", F.lit(3 * b + k)) for k in range(3)), F.lit(0.0))
    gain = F.greatest(*[1e-3 * F.abs(row(a, b) - row(b, a)) - 0.5e-6 * (row(a, a) + row(b, b)) for a, b in ((0, 1), (0, 2), (1, 2))])
    own = lambda a, b: sum((F.get("m", F.lit(3 * a + k)) * F.get("m", F.lit(3 * b + k)) for k in range(3)), F.lit(0.0))
    unit = F.greatest(*[F.abs(own(a, b) - float(a == b)) for a in range(3) for b in range(a, 3)]) < 1e-9
    return both.select(F.coalesce("camera_id", F.lit(-1)).alias("camera_id"), F.col("n").cast("long").alias("n"), unit.alias("rotation"), (gain <= 1e-9).alias("best"))


@book.query(f"WITH {_ROT} SELECT coalesce(camera_id, -1) AS camera_id, count(cz) AS n, floor(regr_slope(cz, cx) * 1e4 + 0.5) / 1e4 AS slope, floor(regr_intercept(cz, cx) * 1e2 + 0.5) / 1e2 AS intercept FROM ce GROUP BY 1")
def height_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Heights of each lens's cameras as a line over their first coordinate."""
    p = poses(spark, sf).select(F.coalesce("camera_id", F.lit(-1)).alias("camera_id"), F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(2)).alias("z"))
    f = line_fit(p, "camera_id", F.col("x"), F.col("z"))
    return f.select("camera_id", "n", (F.floor(F.col("slope") * 1e4 + 0.5) / 1e4).alias("slope"), (F.floor(F.col("intercept") * 1e2 + 0.5) / 1e2).alias("intercept"))


_FLIGHTS = "fl AS (SELECT flight, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, flight) AS k FROM gps WHERE flight IS NOT NULL GROUP BY 1)"


@book.query(f"WITH {_FLIGHTS}, o AS (SELECT flight, k, (length(flight) * 7 + ascii(right(flight, 1)) * 3) % 13 AS off FROM fl) SELECT flight, CAST(off - (SELECT off FROM o WHERE k = 1) AS DOUBLE) AS offset_m FROM o")
def planted_flight_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Constant height offsets of flights, found from clusters that all flights share."""
    g = table(spark, sf, "gps").select("flight", "names").filter("flight is not null")
    off = (F.length("flight") * 7 + F.ascii(F.substring("flight", -1, 1)) * 3) % 13
    rows = g.select("flight", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cluster"), off.cast("double").alias("off")).withColumn("v", F.col("off") + 10 * F.col("cluster"))
    return flight_offsets(rows, "cluster", "flight", "v").select("flight", F.round("offset", 0).alias("offset_m"))


_TWO = f"""{_RAYS}, {MEASURED}, vw AS (SELECT DISTINCT obs_img, track_id FROM se WHERE qz > 1),
mt AS (SELECT mp.i, mp.j, vw.track_id FROM mp JOIN vw ON vw.obs_img = mp.i JOIN pt USING (track_id) JOIN ro b ON b.image_id = mp.j JOIN ro a ON a.image_id = mp.i JOIN ce ca ON ca.image_id = mp.i JOIN ce cb ON cb.image_id = mp.j
  WHERE b.r6 * px + b.r7 * py + b.r8 * pz + b.tz > 1 AND power(ca.cx - cb.cx, 2) + power(ca.cy - cb.cy, 2) + power(ca.cz - cb.cz, 2) > 1)"""


@book.query(
    f"WITH {_TWO}, n AS (SELECT i, j, count(*) AS n, count(*) FILTER (track_id % 9 <> 0) AS good FROM mt GROUP BY 1, 2 HAVING count(*) FILTER (track_id % 9 <> 0) >= 30) SELECT i, j, n, floor(degrees(acos(greatest(-1, least(1, ({' + '.join(f'a.r{k} * b.r{k}' for k in range(9))} - 1) / 2)))) * 10 + 0.5) / 10 AS angle "
    "FROM n JOIN ro a ON a.image_id = i JOIN ro b ON b.image_id = j"
)
def two_view_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """The turn between the cameras of measured pairs, from matches of which every ninth is wrong; pairs with 30 right ones and cameras apart."""
    exact, points = exact_observations(spark, sf)
    p = materialise(poses(spark, sf).select("image_id", "r", "t", "c"), "two-view-poses")
    pairs = measurements(spark, sf).select("i", "j").distinct().join(p.select(F.col("image_id").alias("i"), F.col("c").alias("ci")), "i").join(p.select(F.col("image_id").alias("j"), F.col("r").alias("rj"), F.col("t").alias("tj"), F.col("c").alias("cj")), "j")
    apart = sum(((F.get("ci", F.lit(k)) - F.get("cj", F.lit(k))) * (F.get("ci", F.lit(k)) - F.get("cj", F.lit(k))) for k in range(3)), F.lit(0.0))
    first = exact.groupBy(F.col("obs_img").alias("i"), "track_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    met = pairs.filter(apart > 1).select("i", "j", "rj", "tj").join(first, "i").join(points.withColumnRenamed("x", "p"), "track_id")
    met = met.withColumn("q", project(F.col("rj"), F.col("tj"), F.col("p"), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))).filter(F.col("q.z") > 1)
    wrong = F.when(F.col("track_id") % 9 == 0, 0.2 + (F.col("track_id") % 7) / 10).otherwise(0.0)
    rows = met.select((F.shiftleft(F.col("i").cast("long"), 32) + F.col("j")).alias("pair"), ((F.col("x") - W / 2) / FOCAL).alias("x1"), ((F.col("y") - H / 2) / FOCAL).alias("y1"), (F.col("q.u") + wrong).alias("x2"), (F.col("q.v") - wrong).alias("y2"), (F.col("track_id") % 9 != 0).alias("good"))
    rows = materialise(rows, "two-view-matches")
    enough = rows.groupBy("pair").agg(F.count_if("good").alias("good")).filter("good >= 30").select("pair")
    found = relative_poses(lookup_join(rows.drop("good"), enough, "pair", "inner"), "pair", threshold=1e-4)
    same = F.array(*[F.lit(float(k in (0, 4, 8))) for k in range(9)])
    return found.select(F.shiftright("pair", 32).cast("int").alias("i"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("j"), "n", (F.floor(angle_between_deg(F.col("r"), same) * 10 + 0.5) / 10).alias("angle"))
