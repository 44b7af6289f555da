"""How well predicted overlap agrees with measured overlap and with shared points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.pose import angle_between_deg, rotation_of_quaternion
from skyweave.operators.covis import shared_counts
from skyweave.operators.metrics import average_ranks, binary_metrics, cdf_area, pr_curve, row_metrics, spearman, spread_stats
from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import grouped_quantile, six
from skyweave.operators.pairs import accumulate
from skyweave.plans.tables import MEASURED, POSED, PREDICTED, SHARED, VIEWS, Book, measurements, observations, posed, predicted_pairs, predictions, views
from skyweave.session import materialise

book = Book()


def judged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``i, j, score, measured, label``: predicted score against mean measured overlap of at least 0.1."""
    m = accumulate(measurements(spark, sf), "overlap").select("i", "j", F.col("mean").alias("measured"))
    return predicted_pairs(spark, sf).join(m, ["i", "j"]).withColumn("label", F.col("measured") >= 0.1)


JUDGED = f"{PREDICTED}, {MEASURED}, ju AS (SELECT i, j, score, mean AS measured, mean >= 0.1 AS label FROM pp JOIN mp USING (i, j))"
_CURVE = JUDGED + """,
ps AS (SELECT score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM ju GROUP BY 1),
tt AS (SELECT sum(pos) AS p, sum(neg) AS n FROM ps),
cu AS (SELECT score, pos, neg, p, n, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM ps, tt),
cv AS (SELECT *, tp / (tp + fp) AS precision, tp / greatest(p, 1) AS recall, fp / greatest(n, 1) AS fpr FROM cu)"""


@book.query(f"WITH {JUDGED}, r AS (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM ju) SELECT DISTINCT floor(score * 1e6 + 0.5) / 1e6 AS score, CAST(rank AS DOUBLE) AS rank FROM r")
def avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    return average_ranks(judged_pairs(spark, sf), "score").select(six(F.col("score")).alias("score"), "rank")


@book.query(
    f"WITH {JUDGED}, q AS (SELECT score, floor(measured * 1e6 + 0.5) AS measured FROM ju), r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY measured) + (count(*) OVER (PARTITION BY measured) - 1) / 2.0 AS b FROM q) "
    "SELECT count(*) AS n, floor(corr(a, b) * 1e6 + 0.5) / 1e6 AS rho FROM r"
)
def spearman_predicted_measured(spark: SparkSession, sf: str) -> DataFrame:
    whole = judged_pairs(spark, sf).withColumn("measured", F.floor(F.col("measured") * 1e6 + 0.5))
    return spearman(whole, "score", "measured").select("n", six(F.col("rho")).alias("rho"))


@book.query(f"WITH {_CURVE} SELECT floor(score * 1e6 + 0.5) / 1e6 AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, floor(precision * 1e6 + 0.5) / 1e6 AS precision, floor(recall * 1e6 + 0.5) / 1e6 AS recall, floor(fpr * 1e6 + 0.5) / 1e6 AS fpr FROM cv")
def precision_recall_curve(spark: SparkSession, sf: str) -> DataFrame:
    c = pr_curve(judged_pairs(spark, sf), "score", "label")
    return c.select(six(F.col("score")).alias("score"), F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), *[six(F.col(x)).alias(x) for x in ("precision", "recall", "fpr")])


@book.query(
    f"WITH {_CURVE}, f AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM cv), b AS (SELECT * FROM f ORDER BY f1 DESC, score DESC LIMIT 1) SELECT "
    "floor(sum(pos / greatest(p, 1) * precision) * 1e6 + 0.5) / 1e6 AS average_precision, floor(sum(neg / greatest(n, 1) * (2 * recall - pos / greatest(p, 1)) / 2) * 1e6 + 0.5) / 1e6 AS roc_auc, "
    "floor(max(f1) * 1e6 + 0.5) / 1e6 AS best_f1, (SELECT floor(score * 1e6 + 0.5) / 1e6 FROM b) AS best_f1_threshold, (SELECT floor(precision * 1e6 + 0.5) / 1e6 FROM b) AS best_f1_precision, (SELECT floor(recall * 1e6 + 0.5) / 1e6 FROM b) AS best_f1_recall, "
    "CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives, floor(coalesce(max(precision) FILTER (recall >= 0.9), 0) * 1e6 + 0.5) / 1e6 AS precision_at_recall_090, "
    "floor(coalesce(max(recall) FILTER (precision >= 0.98), 0) * 1e6 + 0.5) / 1e6 AS recall_at_precision_098 FROM f"
)
def overlap_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = binary_metrics(judged_pairs(spark, sf), "score", "label")
    return m.select(*[(F.col(c).cast("long") if c in ("positives", "negatives") else six(F.col(c))).alias(c) for c in m.columns])


def judged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``src, dst, score, label``: directed predictions; positive where the images share at least 3 points."""
    s = shared_counts(observations(spark, sf)).filter("shared >= 3")
    both = s.select(F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(s.select(F.col("j").alias("src"), F.col("i").alias("dst")))
    return predictions(spark, sf).join(both.withColumn("hit", F.lit(True)), ["src", "dst"], "left").withColumn("label", F.col("hit").isNotNull())


_ROWS = f"""{PREDICTED}, {SHARED}, dd AS (SELECT i AS src, j AS dst FROM s WHERE shared >= 3 UNION ALL SELECT j, i FROM s WHERE shared >= 3),
jr AS (SELECT pr.src, pr.dst, pr.score, dd.src IS NOT NULL AS label FROM pr LEFT JOIN dd ON pr.src = dd.src AND pr.dst = dd.dst),
jn AS (SELECT src, count(*) FILTER (label) AS positives, count(*) AS n FROM jr GROUP BY 1 HAVING count(*) FILTER (label) > 0 AND count(*) FILTER (label) < count(*)),
jk AS (SELECT jr.*, positives, n, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k, sum(CAST(label AS INTEGER)) OVER (PARTITION BY src ORDER BY score DESC, dst ROWS UNBOUNDED PRECEDING) AS tp FROM jr JOIN jn USING (src)),
rm AS (SELECT src, max(positives) AS positives, max(n) AS n, avg(tp / k) FILTER (label) AS ap, sum(CASE WHEN k <= positives AND label THEN 1 ELSE 0 END) / max(positives) AS rp FROM jk GROUP BY 1)"""


@book.query(f"WITH {_ROWS} SELECT src, CAST(positives AS BIGINT) AS positives, n, floor(ap * 1e6 + 0.5) / 1e6 AS ap, floor(rp * 1e6 + 0.5) / 1e6 AS r_precision FROM rm")
def row_ap(spark: SparkSession, sf: str) -> DataFrame:
    m = row_metrics(judged_rows(spark, sf), "src", "dst", "score", "label")
    return m.select("src", F.col("positives").cast("long").alias("positives"), "n", six(F.col("ap")).alias("ap"), six(F.col("r_precision")).alias("r_precision"))


@book.query(f"WITH {_ROWS} SELECT count(*) AS rows, floor(avg(ap) * 1e6 + 0.5) / 1e6 AS mean_ap, floor(avg(rp) * 1e6 + 0.5) / 1e6 AS mean_r_precision FROM rm")
def row_ap_mean(spark: SparkSession, sf: str) -> DataFrame:
    m = row_metrics(judged_rows(spark, sf), "src", "dst", "score", "label")
    return m.agg(F.count(F.lit(1)).alias("rows"), six(F.avg("ap")).alias("mean_ap"), six(F.avg("r_precision")).alias("mean_r_precision"))


_TOP6 = ", t6 AS (SELECT src, dst, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS kk FROM jr) WHERE kk <= 6)"


@book.query(
    f"WITH {_ROWS}{_TOP6} SELECT count(*) AS picks, count(*) FILTER (label) AS hits, floor(count(*) FILTER (label) / count(*) * 1e6 + 0.5) / 1e6 AS precision, "
    "floor((SELECT count(DISTINCT (least(src, dst), greatest(src, dst))) FROM t6 WHERE label) / (SELECT count(*) FROM s WHERE shared >= 3) * 1e6 + 0.5) / 1e6 AS recall FROM t6"
)
def graph_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Top-6 picks against the graph of shared points: precision of the picks, recall of the union graph's edges."""
    from skyweave.operators.pairs import top_k, unordered

    rows = judged_rows(spark, sf)
    picks = top_k(rows, "src", "dst", "score", 6).join(rows.select("src", "dst", "label"), ["src", "dst"])
    found = unordered(picks.filter("label"), "src", "dst").select("i", "j").distinct().agg(F.count(F.lit(1)).alias("found"))
    true = shared_counts(observations(spark, sf)).filter("shared >= 3").agg(F.count(F.lit(1)).alias("true"))
    sums = picks.agg(F.count(F.lit(1)).alias("picks"), F.count_if("label").alias("hits"))
    one = sums.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(true))  # one row each
    return one.select("picks", "hits", six(F.col("hits") / F.col("picks")).alias("precision"), six(F.col("found") / F.col("true")).alias("recall"))


@book.query(f"WITH {JUDGED} SELECT count(*) FILTER (score >= 0.15 AND NOT label) AS false_positives, count(*) FILTER (score < 0.15 AND label) AS false_negatives, count(*) AS pairs FROM ju")
def disagreement_counts(spark: SparkSession, sf: str) -> DataFrame:
    return judged_pairs(spark, sf).agg(F.count_if(F.expr("score >= 0.15 and not label")).alias("false_positives"), F.count_if(F.expr("score < 0.15 and label")).alias("false_negatives"), F.count(F.lit(1)).alias("pairs"))


@book.query(f"WITH {JUDGED} SELECT CASE WHEN measured >= 0.3 THEN 'high' WHEN measured >= 0.1 THEN 'some' ELSE 'low' END AS level, count(*) AS n, floor(avg(abs(score - measured)) * 1e6 + 0.5) / 1e6 AS mae FROM ju GROUP BY 1")
def error_by_level(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute error of predictions by measured level."""
    level = F.when(F.col("measured") >= 0.3, "high").when(F.col("measured") >= 0.1, "some").otherwise("low").alias("level")
    return judged_pairs(spark, sf).groupBy(level).agg(F.count(F.lit(1)).alias("n"), six(F.avg(F.abs(F.col("score") - F.col("measured")))).alias("mae"))


@book.query(
    f"WITH {VIEWS} SELECT kind, count(cam_conf) AS n, floor(avg(cam_conf) * 1e6 + 0.5) / 1e6 AS mean, floor(median(cam_conf) * 1e6 + 0.5) / 1e6 AS median, floor(stddev_pop(cam_conf) * 1e6 + 0.5) / 1e6 AS std, "
    "floor(var_pop(cam_conf) * 1e6 + 0.5) / 1e6 AS var, floor(quantile_cont(cam_conf, 0.9) * 1e6 + 0.5) / 1e6 AS p90 FROM vw GROUP BY 1"
)
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = spread_stats(views(spark, sf).select("kind", "cam_conf"), "kind", "cam_conf")
    return s.select("kind", "n", *[six(F.col(c)).alias(c) for c in ("mean", "median", "std", "var", "p90")])


@book.query(f"WITH {VIEWS}, m AS (SELECT kind, median(cam_conf) AS med FROM vw GROUP BY 1) SELECT kind, floor(max(med) * 1e6 + 0.5) / 1e6 AS median, floor(median(abs(cam_conf - med)) * 1e6 + 0.5) / 1e6 AS mad FROM (SELECT vw.kind, cam_conf, med FROM vw JOIN m ON vw.kind IS NOT DISTINCT FROM m.kind) GROUP BY 1")
def mad_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Median and median absolute deviation of the views' confidence by kind."""
    v = views(spark, sf).select(F.struct("kind").alias("k"), "cam_conf")  # a missing kind is one too
    m = materialise(grouped_quantile(v, "k", "cam_conf", 0.5, "med"), "mad")
    off = lookup_join(v, m, "k", "inner").withColumn("off", F.abs(F.col("cam_conf") - F.col("med")))
    mad = grouped_quantile(off, "k", "off", 0.5, "mad")
    return m.join(mad, "k").select("k.kind", six(F.col("med")).alias("median"), six(F.col("mad")).alias("mad"))


@book.query(f"WITH {MEASURED} SELECT batch_id, count(*) AS n, floor(quantile_cont(overlap, 0.1) * 1e6 + 0.5) / 1e6 AS p10, floor(quantile_cont(overlap, 0.5) * 1e6 + 0.5) / 1e6 AS p50, floor(quantile_cont(overlap, 0.9) * 1e6 + 0.5) / 1e6 AS p90 FROM me GROUP BY 1")
def overlap_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    m = materialise(measurements(spark, sf).select("batch_id", "overlap"), "overlaps")
    g = m.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    for q, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")):
        g = g.join(grouped_quantile(m, "batch_id", "overlap", q, name), "batch_id")
    return g.select("batch_id", "n", *[six(F.col(name)).alias(name) for name in ("p10", "p50", "p90")])


@book.query(f"WITH {MEASURED}, {PREDICTED}, b AS (SELECT batch_id, corr(score, overlap) AS c, count(*) AS n FROM me JOIN pp USING (i, j) GROUP BY 1 HAVING count(*) >= 10 AND stddev_pop(score) > 1e-9 AND stddev_pop(overlap) > 1e-9) SELECT count(*) AS batches, floor(avg(c) * 1e4 + 0.5) / 1e4 AS mean_corr FROM b")
def batch_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of predicted and measured overlap within batches, averaged over batches."""
    m = measurements(spark, sf).join(predicted_pairs(spark, sf), ["i", "j"])
    g = m.groupBy("batch_id").agg(F.corr("score", "overlap").alias("c"), F.count(F.lit(1)).alias("n"), F.stddev_pop("score").alias("a"), F.stddev_pop("overlap").alias("b")).filter("n >= 10 and a > 1e-9 and b > 1e-9")
    return g.agg(F.count(F.lit(1)).alias("batches"), (F.floor(F.avg("c") * 1e4 + 0.5) / 1e4).alias("mean_corr"))


_QUAT = "abs(a.qw * b.qw + a.qx * b.qx + a.qy * b.qy + a.qz * b.qz) / sqrt((a.qw ** 2 + a.qx ** 2 + a.qy ** 2 + a.qz ** 2) * (b.qw ** 2 + b.qx ** 2 + b.qy ** 2 + b.qz ** 2))"
_ERRORS = f"{POSED}, {MEASURED}, er AS (SELECT mp.i, mp.j, degrees(2 * acos(least(1.0, {_QUAT}))) AS e FROM mp JOIN ps a ON a.image_id = i JOIN ps b ON b.image_id = j)"


def rotation_differences(spark: SparkSession, sf: str) -> DataFrame:
    """``i, j, e``: degrees between the rotations of measured pairs."""
    r = posed(spark, sf).select("image_id", rotation_of_quaternion(F.col("qw"), F.col("qx"), F.col("qy"), F.col("qz")).alias("r"))
    pairs = measurements(spark, sf).select("i", "j").distinct()
    both = pairs.join(r.select(F.col("image_id").alias("i"), F.col("r").alias("ri")), "i").join(r.select(F.col("image_id").alias("j"), F.col("r").alias("rj")), "j")
    return both.select("i", "j", angle_between_deg(F.col("ri"), F.col("rj")).alias("e"))


@book.query(f"WITH {_ERRORS} SELECT i, j, floor(e * 1e3 + 0.5) / 1e3 AS e FROM er")
def relative_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return rotation_differences(spark, sf).select("i", "j", (F.floor(F.col("e") * 1e3 + 0.5) / 1e3).alias("e"))


@book.query(f"WITH {_ERRORS}, x AS (SELECT unnest(generate_series(0, 999)) * 90.0 / 999 AS x) SELECT (SELECT count(*) FROM er) AS n, floor(avg(c) * 1e4 + 0.5) / 1e4 AS auc FROM (SELECT x, count(*) FILTER (e <= x) / count(*) AS c FROM x, er GROUP BY 1)")
def pose_auc_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the distribution of rotation differences up to 90 degrees, at 1,000 points."""
    return cdf_area(rotation_differences(spark, sf), "e", 90.0).select("n", (F.floor(F.col("auc") * 1e4 + 0.5) / 1e4).alias("auc"))


@book.query(f"WITH {_ERRORS} SELECT count(*) AS n, floor(count(*) FILTER (e < 5) / count(*) * 1e4 + 0.5) / 1e4 AS at_5, floor(count(*) FILTER (e < 15) / count(*) * 1e4 + 0.5) / 1e4 AS at_15, floor(median(e) * 1e3 + 0.5) / 1e3 AS median FROM er")
def rotation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of pairs below 5 and 15 degrees and the median."""
    e = materialise(rotation_differences(spark, sf).select("e"), "rotation-differences")
    median = grouped_quantile(e.withColumn("g", F.lit(1)), "g", "e", 0.5, "m").select("m")
    share = lambda t: (F.floor(F.count_if(F.col("e") < t) / F.count(F.lit(1)) * 1e4 + 0.5) / 1e4).alias(f"at_{t}")
    both = e.agg(F.count(F.lit(1)).alias("n"), share(5), share(15)).join(F.broadcast(median), how="left")  # one row each
    return both.select("n", "at_5", "at_15", (F.floor(F.col("m") * 1e3 + 0.5) / 1e3).alias("median"))
