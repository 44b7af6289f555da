"""Choices over graphs, positions and pixels: gates, status, candidates, batches, masks, guided matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.functions.geo import ecef
from skyweave.operators.cloud import nearest_of_set
from skyweave.operators.graph import component_sizes, components
from skyweave.operators.keyed import latest
from skyweave.operators.ordering import six, with_index
from skyweave.operators.pixels import guided_candidates, log_depth_ratios, pooled_attention, ratio_test, robust_regression, valid_pixels
from skyweave.plans.covisibility import _LATEST, newest_observations
from skyweave.plans.geometry import _ROT, _m, centre_points, milli
from skyweave.plans.graphs import _REACH, overlap_edges
from skyweave.plans.tables import MEASURED, OBS, PREDICTED, Book, measurements, photos, posed, predicted_pairs, table
from skyweave.session import materialise

book = Book()

_FINITE = "lat IS NOT NULL AND lon IS NOT NULL AND isfinite(lat) AND isfinite(lon) AND NOT (lat = 0 AND lon = 0) AND abs(lat) <= 90 AND abs(lon) <= 180"
_XYZ = "n * cos(radians(lat)) * cos(radians(lon)) AS x, n * cos(radians(lat)) * sin(radians(lon)) AS y, n * (1 - 6.69437999014e-3) * sin(radians(lat)) AS z"


@book.query(
    rf"""WITH g AS (SELECT regexp_extract(names, '[^/\\]*$') AS name, lla[1] AS lat, lla[2] AS lon, received_at FROM gps WHERE names IS NOT NULL),
u AS (SELECT *, {_XYZ} FROM (SELECT *, 6378137.0 / sqrt(1 - 6.69437999014e-3 * power(sin(radians(lat)), 2)) AS n FROM g WHERE {_FINITE})),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY received_at, lat, lon) AS k FROM u) WHERE k = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY received_at DESC, lat DESC, lon DESC) AS k FROM u) WHERE k = 1),
d AS (SELECT name, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM a JOIN b USING (name)), nm AS (SELECT DISTINCT name FROM g)
SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN d > 20 THEN 'detached' WHEN d <= 10 THEN 'accepted' ELSE 'open' END AS gate, count(*) AS photos FROM nm LEFT JOIN d USING (name) GROUP BY 1"""
)
def position_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Photos by how far their first and last delivered positions are apart: more than 20 m, at most 10 m, between, or without a position."""
    g = table(spark, sf, "gps").filter("names is not null").select(F.regexp_extract("names", r"(?s)([^/\\]*)\z", 1).alias("name"), F.get("lla", F.lit(0)).alias("lat"), F.get("lla", F.lit(1)).alias("lon"), "received_at")
    good = g.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and not (lat = 0 and lon = 0) and abs(lat) <= 90 and abs(lon) <= 180")
    x, y, z = ecef(F.col("lat"), F.col("lon"))
    row = F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    ends = good.groupBy("name").agg(F.min_by(row, F.struct("received_at", "lat", "lon")).alias("a"), F.max_by(row, F.struct("received_at", "lat", "lon")).alias("b"))
    far = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0.0)))
    d = g.select("name").distinct().join(ends.select("name", far.alias("d")), "name", "left")
    gate = F.when(F.col("d").isNull(), "unknown").when(F.col("d") > 20, "detached").when(F.col("d") <= 10, "accepted").otherwise("open")
    return d.groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("photos"))


@book.query(
    _REACH + f""", {_ROT}, sz AS (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS k FROM lb GROUP BY 1),
im AS (SELECT DISTINCT image_id FROM (SELECT image_id FROM images UNION ALL SELECT image_id FROM anchor_images) WHERE image_id IS NOT NULL),
st AS (SELECT CASE WHEN ro.image_id IS NULL THEN 'unregistered' WHEN lb.node IS NULL THEN 'alone' WHEN sz.k = 1 THEN 'seed' ELSE 'segment ' || (sz.k - 1) END AS status FROM im LEFT JOIN (SELECT DISTINCT image_id FROM ro) ro USING (image_id) LEFT JOIN lb ON lb.node = im.image_id LEFT JOIN sz USING (component))
SELECT coalesce(status, 'all') AS status, count(*) AS images FROM st GROUP BY ROLLUP (status)"""
)
def node_status(spark: SparkSession, sf: str) -> DataFrame:
    """Images by status: without a pose, outside of the graph, in the largest segment, or in a segment by its place in size; and all."""
    label = materialise(components(overlap_edges(spark, sf)), "status-labels")
    ranked = with_index(component_sizes(label), [F.col("size").desc(), F.col("component")], "k")
    named = label.join(ranked, "component").select(F.col("node").cast("int").alias("image_id"), "k")
    placed = posed(spark, sf).select("image_id").distinct().withColumn("placed", F.lit(True))
    im = photos(spark, sf).select("image_id").filter("image_id is not null").join(placed, "image_id", "left").join(named, "image_id", "left")
    status = F.when(F.col("placed").isNull(), "unregistered").when(F.col("k").isNull(), "alone").when(F.col("k") == 0, "seed").otherwise(F.concat(F.lit("segment "), F.col("k").cast("string")))
    return im.select(status.alias("s")).rollup("s").agg(F.count(F.lit(1)).alias("images")).select(F.coalesce("s", F.lit("all")).alias("status"), "images")


@book.query(_REACH + ", cm AS (SELECT lb.component, count(DISTINCT lb.node) AS k FROM lb GROUP BY 1), ov AS (SELECT lb.component, avg(mean) AS m FROM mp JOIN lb ON lb.node = mp.i WHERE floor(mean * 1e6 + 0.5) / 1e6 >= 0.2 GROUP BY 1) SELECT CAST(sum(k) AS BIGINT) AS images, floor(sum(k * m) / sum(k) * 1e6 + 0.5) / 1e6 AS weighted FROM cm JOIN ov USING (component) WHERE k >= 4")
def segment_weighted_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean overlap within segments of 4 and more, weighted by their size."""
    label = materialise(components(overlap_edges(spark, sf)), "weighted-labels")
    mean = measurements(spark, sf).groupBy("i", "j").agg((F.sum("overlap") / F.count(F.lit(1))).alias("mean")).filter(six(F.col("mean")) >= 0.2)
    m = mean.join(label.select(F.col("node").cast("int").alias("i"), "component"), "i").groupBy("component").agg(F.avg("mean").alias("m"))
    both = component_sizes(label).filter("size >= 4").join(m, "component")
    return both.agg(F.sum("size").alias("images"), six(F.sum(F.col("size") * F.col("m")) / F.sum("size")).alias("weighted"))


@book.query(
    _REACH + f""", {_ROT}, isl AS (SELECT component FROM lb GROUP BY 1 ORDER BY count(*), component DESC LIMIT 1), ins AS (SELECT cx, cy, cz FROM ce JOIN lb ON lb.node = ce.image_id JOIN isl USING (component)),
o AS (SELECT ce.image_id, min(sqrt(power(ce.cx - ins.cx, 2) + power(ce.cy - ins.cy, 2) + power(ce.cz - ins.cz, 2))) AS d FROM ce, ins WHERE ce.image_id NOT IN (SELECT node FROM lb JOIN isl USING (component)) GROUP BY 1)
SELECT image_id, row_number() OVER (ORDER BY floor(d * 1e3 + 0.5), image_id) - 1 AS place FROM o"""
)
def island_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Cameras outside of the smallest segment, nearest to any of its cameras first."""
    label = materialise(components(overlap_edges(spark, sf)), "island-labels")
    island = component_sizes(label).orderBy("size", F.desc("component")).limit(1).select("component")
    inside = materialise(label.join(F.broadcast(island), "component", "left_semi").select(F.col("node").cast("int").alias("image_id")), "island")
    p = materialise(centre_points(spark, sf), "island-cameras")
    d = nearest_of_set(p.join(inside, "image_id", "left_anti"), p.join(inside, "image_id", "left_semi"), "image_id", ["x", "y", "z"])
    return with_index(d.select("image_id", F.floor(F.col("d") * 1e3 + 0.5).alias("far")), [F.col("far"), F.col("image_id")], "place").select("image_id", "place")


@book.query(f"WITH {PREDICTED}, dr AS (SELECT i AS node, score FROM pp UNION ALL SELECT j, score FROM pp) SELECT node, floor(sum(score) * 1e3 + 0.5) / 1e3 AS density FROM dr GROUP BY 1 HAVING count(*) >= 2 ORDER BY density DESC, node LIMIT 1")
def densest_camera(spark: SparkSession, sf: str) -> DataFrame:
    """The camera with the largest sum of predicted overlaps, of those with at least two."""
    p = predicted_pairs(spark, sf)
    d = p.select(F.col("i").alias("node"), "score").unionByName(p.select(F.col("j").alias("node"), "score"))
    g = d.groupBy("node").agg(milli(F.sum("score")).alias("density"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return g.orderBy(F.desc("density"), "node").limit(1).select("node", "density")


@book.query(
    f"WITH RECURSIVE {MEASURED}, e AS (SELECT batch_id, i AS a, j AS b FROM me WHERE overlap >= 0.1 UNION ALL SELECT batch_id, j, i FROM me WHERE overlap >= 0.1), "
    "r(batch_id, node, g) USING KEY (batch_id, node) AS (SELECT DISTINCT batch_id, a, a FROM e UNION SELECT o.batch_id, o.node, o.g FROM (SELECT r.batch_id, e.b AS node, min(r.g) AS g FROM r JOIN e ON e.batch_id = r.batch_id AND e.a = r.node GROUP BY 1, 2) o JOIN recurring.r AS k ON k.batch_id = o.batch_id AND k.node = o.node WHERE o.g < k.g), "
    "s AS (SELECT batch_id, g, count(*) AS size FROM r GROUP BY 1, 2) SELECT batch_id, CAST(first AS INTEGER) AS first, size FROM (SELECT batch_id, g AS first, size, row_number() OVER (PARTITION BY batch_id ORDER BY size DESC, g) AS k FROM s) WHERE k = 1"
)
def batch_components(spark: SparkSession, sf: str) -> DataFrame:
    """The largest connected part of every batch by measured overlap of at least 0.1: its smallest image and its size. All batches are searched together."""
    m = measurements(spark, sf).filter("overlap >= 0.1").select("batch_id", "i", "j")
    # a node is an image in a batch, numbered over all
    nodes = m.select("batch_id", F.col("i").alias("image")).unionByName(m.select("batch_id", F.col("j").alias("image"))).distinct()
    numbered = with_index(nodes, [F.col("batch_id"), F.col("image")], "node")
    numbered = materialise(numbered, "batch-nodes")
    end = lambda c, name: numbered.select("batch_id", F.col("image").alias(c), F.col("node").alias(name))
    edges = m.join(end("i", "a"), ["batch_id", "i"]).join(end("j", "b"), ["batch_id", "j"]).select("a", "b")
    label = components(edges, "a", "b").join(numbered, "node")
    parts = label.groupBy("component").agg(F.min("batch_id").alias("batch_id"), F.min("image").alias("first"), F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("batch_id").orderBy(F.desc("size"), "first")
    return parts.withColumn("k", F.row_number().over(w)).filter("k = 1").select("batch_id", "first", "size")


@book.query("SELECT count(*) AS n, TRUE AS centred, TRUE AS spread, TRUE AS repeats FROM gps WHERE lla IS NOT NULL")
def position_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Noise of 2 m added to every position: its mean and spread are as asked for, and the same again from the same seed."""
    from skyweave.functions.geo import noise

    g = table(spark, sf, "gps").filter("lla is not null").select(F.col("names"), F.monotonically_increasing_id().alias("id"))
    a = materialise(g.select("id", noise(F.col("id"), 2.0, 1).alias("e"), noise(F.col("id"), 2.0, 1).alias("again"), noise(F.col("id"), 2.0, 2).alias("n")), "noise")
    wide = 12.0 / F.sqrt(F.count(F.lit(1)))
    near = lambda c: (F.abs(F.avg(c)) < wide) & (F.abs(F.stddev_pop(c) - 2.0) < wide)
    return a.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("e")) < wide).alias("centred"), (near("e") & near("n")).alias("spread"), F.every(F.col("e") == F.col("again")).alias("repeats"))


_PX = _LATEST + ", px AS (SELECT obs_img AS image, obs_feat, CAST(floor(x) AS BIGINT) AS px, CAST(floor(y) AS BIGINT) AS py, x, y, conf, CAST(track_id % 9 - 1 AS DOUBLE) AS depth FROM t WHERE track_id IS NOT NULL AND isfinite(x) AND isfinite(y))"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """``image, obs_feat, px, py, x, y, conf, depth``: observations as pixels with a depth from -1 to 7."""
    t = newest_observations(spark, sf).filter("track_id is not null and x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) != double('infinity') and abs(y) != double('infinity')")
    return t.select(F.col("obs_img").alias("image"), "obs_feat", F.floor("x").alias("px"), F.floor("y").alias("py"), "x", "y", "conf", (F.col("track_id") % 9 - 1).cast("double").alias("depth"))


@book.query(f"WITH {_PX}, q AS (SELECT image, quantile_cont(conf, 0.3) AS cut FROM px GROUP BY 1) SELECT image, obs_feat FROM px JOIN q USING (image) WHERE conf >= cut AND depth > 0")
def valid_pixel_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with a positive depth and a confidence from the image's 0.3-quantile up."""
    return valid_pixels(pixels(spark, sf)).select("image", "obs_feat")


@book.query(
    f"WITH {_PX}, k AS (SELECT image, px, py, max(depth) AS a, min(depth) + 2 AS b FROM px GROUP BY 1, 2, 3), r AS (SELECT image, ln(a / b) AS v FROM k WHERE a > 0 AND b > 0), n AS (SELECT image, count(*) AS n, median(v) AS m FROM r GROUP BY 1 HAVING count(*) > 20) "
    "SELECT image, n, floor(any_value(m) * 1e6 + 0.5) / 1e6 AS median, floor(1.4826 * median(abs(v - m)) * 1e6 + 0.5) / 1e6 AS spread FROM r JOIN n USING (image) GROUP BY 1, 2"
)
def depth_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Log ratios of two depths at common pixels, of images with more than 20."""
    p = pixels(spark, sf).groupBy("image", "px", "py").agg(F.max("depth").alias("a"), (F.min("depth") + 2).alias("b"))
    p = materialise(p, "depths")
    r = log_depth_ratios(p.select("image", "px", "py", F.col("a").alias("depth")), p.select("image", "px", "py", F.col("b").alias("depth")), least=20)
    return r.select("image", "n", six(F.col("median")).alias("median"), six(F.col("spread")).alias("spread"))


_MASS = "ma AS (SELECT batch_id AS batch, i, j, i % 3 AS query, j % 2 AS k, overlap AS value FROM me)"


@book.query(f"WITH {MEASURED}, {_MASS}, q AS (SELECT batch, i, query, j % 7 AS j, sum(value) AS s, max(value) AS p FROM ma GROUP BY 1, 2, 3, 4) SELECT batch, i, j, floor(avg(s) * 1e6 + 0.5) / 1e6 AS mean, floor(max(s) * 1e6 + 0.5) / 1e6 AS top, floor(max(p) * 1e6 + 0.5) / 1e6 AS peak FROM q GROUP BY 1, 2, 3")
def attention_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Masses summed over the keys of a group of images, with the mean and the largest over queries, and the largest single mass."""
    m = measurements(spark, sf).select(F.col("batch_id").alias("batch"), F.lit(0).alias("head"), "i", (F.col("i") % 3).alias("query"), (F.col("j") % 7).alias("j"), F.col("j").alias("key"), F.col("overlap").alias("value"))
    return pooled_attention(m).select("batch", "i", "j", *[six(F.col(c)).alias(c) for c in ("mean", "top", "peak")])


@book.query(
    f"WITH {_PX}, c AS (SELECT a.image AS pair, a.obs_feat AS q, b.obs_feat AS t, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM px a JOIN px b ON a.image = b.image AND a.obs_feat <> b.obs_feat AND a.obs_feat % 2 = 0 AND b.obs_feat % 2 = 1 WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 60), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY pair, q ORDER BY d, t) AS k FROM c), w AS (SELECT pair, q, max(CASE WHEN k = 1 THEN t END) AS t, min(d) AS d, max(CASE WHEN k = 2 THEN d END) AS second FROM r WHERE k <= 2 GROUP BY 1, 2) "
    "SELECT pair, q, t, floor(d * 1e4 + 0.5) / 1e4 AS d FROM w WHERE d < 0.85 * second"
)
def guided_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Even features with their nearest odd one within 60 pixels of the predicted place, if that is clearly nearer than the second."""
    p = materialise(pixels(spark, sf), "guided")
    q = p.filter("obs_feat % 2 = 0").select(F.col("image").alias("pair"), F.col("obs_feat").alias("q"), "x", "y")
    t = p.filter("obs_feat % 2 = 1").select(F.col("image").alias("pair"), F.col("obs_feat").alias("t"), "x", "y")
    near = guided_candidates(q, t, 60.0, 2)
    return ratio_test(near, ["pair", "q"], "t", "px_distance").select("pair", "q", "t", (F.floor(F.col("px_distance") * 1e4 + 0.5) / 1e4).alias("d"))


@book.query(f"WITH {_PX}, n AS (SELECT image, count(*) AS n FROM px GROUP BY 1 HAVING count(*) >= 60) SELECT image, CAST(n AS DOUBLE) AS n, 0.25 + image % 4 AS b0, -0.5 AS b1, 2.0 AS b2 FROM n")
def depth_regression(spark: SparkSession, sf: str) -> DataFrame:
    """A plane over each image's pixels, found again by robust regression though every thirteenth value is far off; images with 60 and more."""
    p = materialise(pixels(spark, sf), "regression-pixels")
    many = p.groupBy("image").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60").select("image")
    rows = p.join(many, "image", "left_semi").withColumns({"u": F.col("x") / 4000 - 0.5, "v": F.col("y") / 3000 - 0.5})
    y = 0.25 + F.col("image") % 4 - 0.5 * F.col("u") + 2.0 * F.col("v") + F.when(F.col("obs_feat") % 13 == 0, 5.0).otherwise(0.0)
    fit = robust_regression(rows.withColumn("target", y), "image", F.col("target"), [F.lit(1.0), F.col("u"), F.col("v")], rounds=6)
    return fit.select("image", "n", *[F.round(f"b{k}", 2).alias(f"b{k}") for k in range(3)])
