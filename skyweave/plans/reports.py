"""Composite queries: summaries of graphs, choices between scores, residuals, footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.functions.pose import rotation_of_gimbal
from skyweave.operators.covis import shared_counts
from skyweave.operators.estimators import fit_residuals, robust_similarity_fit
from skyweave.operators.graph import component_sizes, components, hops
from skyweave.operators.matching import filter_tracks, footprint_overlap, residuals
from skyweave.operators.metrics import row_metrics
from skyweave.operators.ordering import grouped_quantile, six, with_index
from skyweave.operators.pairs import accumulate, row_lift
from skyweave.operators.spatial import near_pairs
from skyweave.plans.evaluation import JUDGED, judged_pairs
from skyweave.plans.geometry import _ECEF, _GIMBALS, _LOCAL, _XYZ, enu_places, gimbals, milli, posed_observations, poses, track_points
from skyweave.plans.graph_edges import _LIFT
from skyweave.plans.graphs import _HOPS, _REACH, _SEEN, anchors, overlap_edges, seen_edges
from skyweave.plans.photos import photo_positions
from skyweave.plans.sequences import places
from skyweave.plans.tables import MEASURED, OBS, POSED, PREDICTED, SHARED, Book, measurements, observations, predicted_pairs, predictions
from skyweave.session import materialise

book = Book()


@book.query(_REACH + ", sz AS (SELECT component, count(*) AS size, min(node) AS first, max(node) AS last FROM lb GROUP BY 1) SELECT row_number() OVER (ORDER BY size DESC, component) - 1 AS segment, size, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM sz")
def segment_table(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the view graph, largest first, with their range of ids."""
    sizes = components(overlap_edges(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last"))
    return with_index(sizes, [F.col("size").desc(), F.col("component")], "segment").select("segment", "size", "first", "last")


@book.query(
    _REACH + ", sz AS (SELECT component, count(*) AS size FROM lb GROUP BY 1), dg AS (SELECT src, count(*) AS d FROM be GROUP BY 1) SELECT (SELECT count(*) FROM ed) AS edges, (SELECT sum(size) FROM sz)::BIGINT AS nodes, (SELECT count(*) FROM sz) AS components, "
    "floor((SELECT max(size) / sum(size) FROM sz) * 1e6 + 0.5) / 1e6 AS largest_share, (SELECT median(d) FROM dg) AS median_degree"
)
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    edges = materialise(overlap_edges(spark, sf), "summary")
    sizes = component_sizes(components(edges)).agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"), six(F.max("size") / F.sum("size")).alias("largest_share"))
    both = edges.select(F.col("i").alias("src")).unionByName(edges.select(F.col("j").alias("src")))
    degree = grouped_quantile(both.groupBy("src").agg(F.count(F.lit(1)).alias("d")).withColumn("g", F.lit(1)), "g", "d", 0.5, "median_degree").select("median_degree")
    count = edges.agg(F.count(F.lit(1)).alias("edges"))
    return count.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(degree))  # one row each


@book.query(
    f"WITH RECURSIVE {_SEEN}, {PREDICTED}, {MEASURED}, {_HOPS}, x AS (SELECT abs(score - mean) AS e, h.d AS d FROM pp JOIN mp USING (i, j) LEFT JOIN h ON h.node = i) "
    "SELECT CASE WHEN d IS NULL THEN 'none' WHEN d >= 3 THEN '3+' ELSE CAST(d AS VARCHAR) END AS hop_class, count(*) AS n, floor(avg(e) * 1e6 + 0.5) / 1e6 AS mae FROM x GROUP BY 1"
)
def error_by_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Mean error of predicted overlap by the number of steps from an anchor."""
    h = hops(seen_edges(spark, sf), anchors(spark, sf)).select(F.col("node").alias("i"), "hops")
    m = accumulate(measurements(spark, sf), "overlap").join(predicted_pairs(spark, sf), ["i", "j"]).select("i", F.abs(F.col("score") - F.col("mean")).alias("e"))
    name = F.when(F.col("hops").isNull(), "none").when(F.col("hops") >= 3, "3+").otherwise(F.col("hops").cast("string"))
    return m.join(h, "i", "left").groupBy(name.alias("hop_class")).agg(F.count(F.lit(1)).alias("n"), six(F.avg("e")).alias("mae"))


@book.query(f"WITH {_LIFT}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY share DESC, dst) AS up, row_number() OVER (PARTITION BY src ORDER BY share, dst) AS down FROM li) SELECT src, dst, up <= 6 AS strong, floor(share * 1e6 + 0.5) / 1e6 AS share FROM r WHERE up <= 6 OR down <= 3")
def two_ended_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The six strongest and three weakest entries of every row."""
    lifted = row_lift(predictions(spark, sf), "src", "dst", "score")
    up, down = Window.partitionBy("src").orderBy(F.col("share").desc(), "dst"), Window.partitionBy("src").orderBy("share", "dst")
    # two cuts, each limited before its shuffle, instead of two ranks over whole rows
    top = lifted.withColumn("r", F.row_number().over(up)).filter("r <= 6").select("src", "dst", "share", F.lit(True).alias("strong"))
    low = lifted.withColumn("r", F.row_number().over(down)).filter("r <= 3").select("src", "dst", "share", F.lit(False).alias("strong"))
    return top.unionByName(low).groupBy("src", "dst").agg(F.max("strong").alias("strong"), six(F.max("share")).alias("share"))


_HEADS = f"""{PREDICTED}, {MEASURED}, {SHARED},
hd AS (SELECT batch_id, i, j, overlap >= 0.1 AS label, coalesce(pp.score, 0) AS predicted, coalesce(s.shared, 0) AS points FROM me LEFT JOIN pp USING (i, j) LEFT JOIN s USING (i, j)),
lg AS (SELECT batch_id, 'predicted' AS head, i, j, label, CAST(predicted AS DOUBLE) AS score FROM hd UNION ALL SELECT batch_id, 'points', i, j, label, CAST(points AS DOUBLE) FROM hd),
rk AS (SELECT *, row_number() OVER w AS k, sum(CAST(label AS INTEGER)) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, count(*) FILTER (label) OVER (PARTITION BY batch_id, head) AS pos, count(*) OVER (PARTITION BY batch_id, head) AS n FROM lg WINDOW w AS (PARTITION BY batch_id, head ORDER BY score DESC, i, j)),
ap AS (SELECT batch_id, head, avg(tp / k) FILTER (label) AS ap FROM rk WHERE pos > 0 AND pos < n GROUP BY 1, 2),
tt AS (SELECT head, sum(ap) AS s, count(*) AS c FROM ap GROUP BY 1)"""


def _batch_ap(spark: SparkSession, sf: str) -> DataFrame:
    m = measurements(spark, sf).join(predicted_pairs(spark, sf), ["i", "j"], "left").join(shared_counts(observations(spark, sf)), ["i", "j"], "left")
    heads = F.explode(F.array(F.struct(F.lit("predicted").alias("head"), F.coalesce("score", F.lit(0.0)).alias("s")), F.struct(F.lit("points").alias("head"), F.coalesce(F.col("shared").cast("double"), F.lit(0.0)).alias("s"))))
    long = m.select("batch_id", F.struct("i", "j").alias("pair"), (F.col("overlap") >= 0.1).alias("label"), heads.alias("h")).select(F.struct("batch_id", "h.head").alias("g"), "pair", "label", F.col("h.s").alias("score"))
    return row_metrics(long, "g", "pair", "score", "label").select("g.batch_id", "g.head", "ap")


@book.query(f"WITH {_HEADS} SELECT head, c AS batches, floor(s / c * 1e6 + 0.5) / 1e6 AS mean_ap FROM tt")
def batch_ap(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision within batches, averaged, for two scores: predicted overlap and shared points."""
    return _batch_ap(spark, sf).groupBy("head").agg(F.count(F.lit(1)).alias("batches"), six(F.avg("ap")).alias("mean_ap"))


@book.query(f"WITH {_HEADS} SELECT batch_id, arg_max(head, (floor((s - ap) / greatest(c - 1, 1) * 1e6 + 0.5), head)) AS chosen FROM ap JOIN tt USING (head) GROUP BY 1")
def leave_one_out_choice(spark: SparkSession, sf: str) -> DataFrame:
    """For every batch the score that is best on all other batches."""
    ap = materialise(_batch_ap(spark, sf), "batch-ap")
    sums = ap.groupBy("head").agg(F.sum("ap").alias("s"), F.count(F.lit(1)).alias("c"))  # one row per score
    others = ap.join(F.broadcast(sums), "head").withColumn("m", F.floor((F.col("s") - F.col("ap")) / F.greatest(F.col("c") - 1, F.lit(1)) * 1e6 + 0.5))
    return others.groupBy("batch_id").agg(F.max_by("head", F.struct("m", "head")).alias("chosen"))


@book.query(f"WITH {JUDGED} SELECT count(*) AS n, floor(avg(CASE WHEN label THEN score END) * 1e6 + 0.5) / 1e6 AS positives, floor(avg(CASE WHEN NOT label THEN score END) * 1e6 + 0.5) / 1e6 AS negatives FROM ju")
def score_separation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean predicted score of positive and negative pairs."""
    return judged_pairs(spark, sf).agg(F.count(F.lit(1)).alias("n"), six(F.avg(F.when(F.col("label"), F.col("score")))).alias("positives"), six(F.avg(F.when(~F.col("label"), F.col("score")))).alias("negatives"))


@book.query()
def reprojection_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Observations that lie within 64 pixels of their triangulated point, of the tracks that :func:`track_points` keeps."""
    obs = posed_observations(spark, sf)
    errors = residuals(obs, track_points(obs), "track_id", "x", "y", 3000.0, 3000.0, 2000.0, 1500.0)
    return filter_tracks(errors, "track_id", 64.0).select("track_id", "obs_img", "obs_feat", six(F.col("error")).alias("error"))


@book.query()
def alignment_errors(spark: SparkSession, sf: str) -> DataFrame:
    """How far the aligned positions of a sequence are from its camera centres: n, median, rms, share within 5 units."""
    c = poses(spark, sf).select("name", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(3)])
    both = materialise(enu_places(spark, sf).join(c, "name"), "alignment")
    src, dst = ["e", "n", "u"], ["c0", "c1", "c2"]
    fits = robust_similarity_fit(both, "seq", src, dst, rounds=2)
    e = materialise(fit_residuals(both, "seq", src, dst, fits), "alignment-errors")
    median = grouped_quantile(e, "seq", "residual", 0.5, "median")
    sums = e.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), six(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).alias("rms"), six(F.avg((F.col("residual") < 5).cast("double"))).alias("within_5"))
    return sums.join(median, "seq").select("seq", "n", six(F.col("median")).alias("median"), "rms", "within_5")


_FOOTPRINTS = (
    f"WITH {_LOCAL}, {_GIMBALS}, al AS (SELECT name, alt FROM (SELECT regexp_extract(names, '[^/\\\\]*$') AS name, lla[3] AS alt, row_number() OVER (PARTITION BY regexp_extract(names, '[^/\\\\]*$') ORDER BY received_at DESC NULLS LAST, lla[1] DESC NULLS LAST, lla[2] DESC NULLS LAST, lla[3] DESC NULLS LAST) AS k FROM gps WHERE names IS NOT NULL) WHERE k = 1 AND alt > 1 AND NOT isnan(alt)), "
    f"cm AS (SELECT name, e AS cx, n AS cy, alt AS cz, gr.* EXCLUDE (name) FROM en JOIN al USING (name) JOIN gr USING (name)), "
    f"xe AS (SELECT name, lat, {_XYZ.format(n='(' + _ECEF.format(la='lat') + ')', la='lat', lo='lon', p='')} FROM pl), "
    "nr AS (SELECT a.name, b.name AS other FROM xe a JOIN xe b ON a.name <> b.name AND abs(a.lat - b.lat) < 0.001 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 15), "
    "gd AS (SELECT ((k + 0.5) / 24 * 4000 - 2000) / 3000 AS a, ((l + 0.5) / 24 * 3000 - 1500) / 3000 AS b FROM (SELECT unnest(generate_series(0, 23)) AS k), (SELECT unnest(generate_series(0, 23)) AS l)), "
    "ra AS (SELECT name, cx, cy, cz, r0 * a + r3 * b + r6 AS dx, r1 * a + r4 * b + r7 AS dy, r2 * a + r5 * b + r8 AS dz FROM cm, gd), "
    "gp AS (SELECT name, dz < -1e-9 AS hit, CASE WHEN dz < -1e-9 THEN cx - cz / dz * dx END AS gx, CASE WHEN dz < -1e-9 THEN cy - cz / dz * dy END AS gy FROM ra), "
    "pj AS (SELECT nr.name, nr.other, hit, o.r0 * (gx - o.cx) + o.r1 * (gy - o.cy) + o.r2 * (0 - o.cz) AS p0, o.r3 * (gx - o.cx) + o.r4 * (gy - o.cy) + o.r5 * (0 - o.cz) AS p1, o.r6 * (gx - o.cx) + o.r7 * (gy - o.cy) + o.r8 * (0 - o.cz) AS p2 FROM nr JOIN gp ON gp.name = nr.name JOIN cm o ON o.name = nr.other), "
    "sh AS (SELECT name, other, count(*) FILTER (hit AND p2 > 1e-9 AND p0 * 3000 / p2 + 2000 >= 0 AND p0 * 3000 / p2 + 2000 < 4000 AND p1 * 3000 / p2 + 1500 >= 0 AND p1 * 3000 / p2 + 1500 < 3000) / count(*) AS s FROM pj GROUP BY 1, 2) "
    "SELECT least(name, other) AS i, greatest(name, other) AS j, floor(min(s) * 1e6 + 0.5) / 1e6 AS overlap FROM sh GROUP BY 1, 2"
)


@book.query(_FOOTPRINTS)
def ground_footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Ground overlap of photos at most 15 m apart, from position, height and gimbal."""
    alt = photo_positions(spark, sf).filter("alt is not null and not isnan(alt) and alt > 1").select("name", "alt")
    cameras = enu_places(spark, sf).join(alt, "name").join(gimbals(spark, sf), "name")
    cameras = cameras.select("name", rotation_of_gimbal(F.col("yaw"), F.col("pitch")).alias("r"), F.array("e", "n", "alt").alias("c"))
    cameras = materialise(cameras, "footprints")
    near = near_pairs(places(spark, sf), "name", "lat", "lon", 15.0).select(F.col("key_a").alias("i"), F.col("key_b").alias("j"))
    return footprint_overlap(cameras, near, 4000, 3000, 3000.0).select("i", "j", six(F.col("overlap")).alias("overlap"))


@book.query(f"WITH {POSED} SELECT image_id, CAST((row_number() OVER (ORDER BY md5(CAST(image_id AS VARCHAR)), image_id) - 1) // 64 AS BIGINT) AS batch FROM ps")
def random_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Images dealt to batches of 64 in the order of a hash: the same in every run."""
    p = poses(spark, sf).select("image_id")
    return with_index(p, [F.md5(F.col("image_id").cast("string")), F.col("image_id")]).select("image_id", F.floor(F.col("idx") / 64).alias("batch"))


@book.query(f"WITH {OBS} SELECT p AS track_id FROM (SELECT DISTINCT p FROM o) ORDER BY md5(CAST(p AS VARCHAR)), p LIMIT 1000")
def sampled_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of 1,000 tracks, the same in every run."""
    t = observations(spark, sf).select(F.col("point_id").alias("track_id")).distinct()
    return t.orderBy(F.md5(F.col("track_id").cast("string")), "track_id").limit(1000)
