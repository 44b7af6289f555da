"""Pair measurements, edges of the view graph and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators.ordering import grouped_quantile, six
from skyweave.operators.pairs import accumulate, conflicting, matching_edges, members_together, met_among, mutual_graph, outside, row_lift, symmetric_min, top_k, union_graph, unordered
from skyweave.plans.tables import MEASURED, PREDICTED, VIEWS, Book, measurements, predicted_pairs, predictions, table, views
from skyweave.session import materialise

book = Book()


@book.query(f"WITH {MEASURED} SELECT i, j, n, floor(mean * 1e6 + 0.5) / 1e6 AS mean FROM mp")
def pair_mean_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    return accumulate(measurements(spark, sf), "overlap").select("i", "j", "n", six(F.col("mean")).alias("mean"))


@book.query(f"WITH {MEASURED} SELECT i, j, floor(top * 1e6 + 0.5) / 1e6 AS top FROM mp")
def pair_max_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    return accumulate(measurements(spark, sf), "overlap").select("i", "j", six(F.col("top")).alias("top"))


@book.query(f"WITH {PREDICTED} SELECT src, dst, floor(score * 1e6 + 0.5) / 1e6 AS score FROM pr")
def latest_wins_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select("src", "dst", six(F.col("score")).alias("score"))


@book.query(f"WITH {PREDICTED} SELECT least(src, dst) AS i, greatest(src, dst) AS j, floor(CASE WHEN count(*) = 2 THEN min(score) ELSE 0 END * 1e6 + 0.5) / 1e6 AS score FROM pr GROUP BY 1, 2")
def symmetric_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return symmetric_min(predictions(spark, sf), "src", "dst", "score").select("i", "j", six(F.col("score").cast("double")).alias("score"))


_TOP6 = PREDICTED + ", t AS (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM pr), t6 AS (SELECT * FROM t WHERE rank <= 6), u AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM t6)"


@book.query(f"WITH {_TOP6} SELECT src, dst, CAST(rank AS INTEGER) AS rank FROM t6")
def edges_topk(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(predictions(spark, sf), "src", "dst", "score", 6).select("src", "dst", "rank")


@book.query(f"WITH {_TOP6} SELECT i, j FROM u")
def edges_union(spark: SparkSession, sf: str) -> DataFrame:
    return union_graph(top_k(predictions(spark, sf), "src", "dst", "score", 6))


@book.query(f"WITH {_TOP6} SELECT a.src AS i, a.dst AS j FROM t6 a JOIN t6 b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def edges_mutual(spark: SparkSession, sf: str) -> DataFrame:
    return mutual_graph(top_k(predictions(spark, sf), "src", "dst", "score", 6))


def best_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``i, j, score``: the larger of predicted and mean measured overlap."""
    m = accumulate(measurements(spark, sf), "overlap").select("i", "j", F.col("mean").alias("score"))
    return predicted_pairs(spark, sf).unionByName(m).groupBy("i", "j").agg(F.max("score").alias("score"))


_BEST = f"{PREDICTED}, {MEASURED}, bs AS (SELECT i, j, max(score) AS score FROM (SELECT i, j, score FROM pp UNION ALL SELECT i, j, mean FROM mp) GROUP BY 1, 2)"
_BRIDGES = "br AS (SELECT DISTINCT least(image_i, image_j) AS i, greatest(image_i, image_j) AS j FROM batch_pairs JOIN batch_members USING (batch_id) WHERE kind = 'link' AND image_i <> image_j)"


@book.query(
    f"WITH {_BEST}, {_BRIDGES}, d AS (SELECT i AS src, j AS dst, score FROM bs UNION ALL SELECT j, i, score FROM bs), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) k FROM d) "
    "SELECT least(src, dst) AS i, greatest(src, dst) AS j FROM r WHERE k <= 20 AND score >= 0.05 UNION SELECT i, j FROM br"
)
def matching_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Top 20 per image by the better score, at least 0.05, and the pairs of linking batches whatever their score."""
    linking = table(spark, sf, "batch_members").filter("kind = 'link'").select("batch_id").distinct()
    bridges = unordered(table(spark, sf, "batch_pairs").join(linking, "batch_id", "left_semi"), "image_i", "image_j").select("i", "j")
    return matching_edges(best_scores(spark, sf), bridges)


_TOGETHER = VIEWS + ", vm AS (SELECT DISTINCT batch_id AS g, image_id AS m FROM vw WHERE batch_id IS NOT NULL AND image_id IS NOT NULL), tg AS (SELECT a.m AS i, b.m AS j, count(*) AS groups FROM vm a JOIN vm b ON a.g = b.g AND a.m < b.m GROUP BY 1, 2)"


@book.query(f"WITH {_TOGETHER} SELECT i, j, groups FROM tg")
def batch_self_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """In how many batches two images were processed together."""
    return members_together(views(spark, sf), "batch_id", "image_id")


@book.query(f"WITH {_TOGETHER}, {MEASURED} SELECT i, j FROM tg WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.i = tg.i AND mp.j = tg.j)")
def unevaluated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of images that met in a batch and have no usable measurement."""
    met = members_together(views(spark, sf), "batch_id", "image_id")
    return outside(met, measurements(spark, sf)).select("i", "j")


@book.query(
    f"WITH {PREDICTED}, ca AS (SELECT DISTINCT least(image_id, other_id) AS i, greatest(image_id, other_id) AS j FROM camera_connections WHERE image_id <> other_id) "
    "SELECT i, j FROM ca WHERE NOT EXISTS (SELECT 1 FROM pp WHERE pp.i = ca.i AND pp.j = ca.j)"
)
def unscored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs, here all that were ever listed, that have no usable score in either direction."""
    candidates = unordered(table(spark, sf, "camera_connections"), "image_id", "other_id").select("i", "j").distinct()
    return outside(candidates, predicted_pairs(spark, sf))


@book.query(f"WITH {_TOGETHER}, {PREDICTED} SELECT i, j FROM pp WHERE score >= 0.15 AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.i = pp.i AND tg.j = pp.j)")
def missing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that are predicted to overlap and were never processed together."""
    promising = predicted_pairs(spark, sf).filter("score >= 0.15")
    return outside(promising, met_among(promising, views(spark, sf), "batch_id", "image_id")).select("i", "j")


@book.query(f"WITH {MEASURED}, {PREDICTED} SELECT i, j FROM mp JOIN pp USING (i, j) WHERE (mean >= 0.2 AND score < 0.05) OR (mean < 0.05 AND score >= 0.3)")
def inconsistent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    both = accumulate(measurements(spark, sf), "overlap").join(predicted_pairs(spark, sf), ["i", "j"])
    return both.filter(conflicting(F.col("mean"), F.col("score"))).select("i", "j")


_LIFT = PREDICTED + ", rs AS (SELECT src, sum(score) AS s, count(*) AS n FROM pr GROUP BY 1), li AS (SELECT src, dst, score / greatest(s, 1e-12) AS share, score / greatest(s, 1e-12) * n AS lift FROM pr JOIN rs USING (src))"


@book.query(f"WITH {_LIFT} SELECT src, dst, floor(share * 1e6 + 0.5) / 1e6 AS share, floor(lift * 1e6 + 0.5) / 1e6 AS lift FROM li")
def row_normalise_lift(spark: SparkSession, sf: str) -> DataFrame:
    return row_lift(predictions(spark, sf), "src", "dst", "score").select("src", "dst", six(F.col("share")).alias("share"), six(F.col("lift")).alias("lift"))


@book.query(f"WITH {_LIFT}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY share DESC, dst) k FROM li) SELECT src, floor(sum(share) * 1e6 + 0.5) / 1e6 AS share FROM r WHERE k <= 3 GROUP BY 1")
def topk_share(spark: SparkSession, sf: str) -> DataFrame:
    """The part of a row that its three largest entries hold."""
    lifted = row_lift(predictions(spark, sf), "src", "dst", "score")
    return top_k(lifted, "src", "dst", "share", 3).groupBy("src").agg(six(F.sum("score")).alias("share"))


@book.query(f"WITH {_LIFT} SELECT least(src, dst) AS i, greatest(src, dst) AS j, floor(max(lift) * 1e6 + 0.5) / 1e6 AS lift FROM li GROUP BY 1, 2")
def candidate_lift(spark: SparkSession, sf: str) -> DataFrame:
    """The larger lift of both directions."""
    lifted = unordered(row_lift(predictions(spark, sf), "src", "dst", "score"), "src", "dst")
    return lifted.groupBy("i", "j").agg(six(F.max("lift")).alias("lift"))


@book.query(f"WITH {VIEWS} SELECT batch_id, count(cam_conf) AS n, floor(median(cam_conf) * 1e6 + 0.5) / 1e6 AS health, median(cam_conf) >= 5 AS healthy FROM vw WHERE batch_id IS NOT NULL GROUP BY 1 HAVING count(cam_conf) > 0")
def health_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Batches by the median confidence of their views."""
    v = materialise(views(spark, sf).filter("batch_id is not null and cam_conf is not null").select("batch_id", "cam_conf"), "health")
    g = v.groupBy("batch_id").agg(F.count("cam_conf").alias("n")).join(grouped_quantile(v, "batch_id", "cam_conf", 0.5, "m"), "batch_id")
    return g.select("batch_id", "n", six(F.col("m")).alias("health"), (F.col("m") >= 5).alias("healthy"))


@book.query(f"WITH {VIEWS} SELECT image_id, arg_min(member_id, batch_id * 1000000 + pos) AS member_id FROM vw WHERE image_id IS NOT NULL AND batch_id IS NOT NULL AND descriptors IS NOT NULL GROUP BY 1")
def first_descriptor(spark: SparkSession, sf: str) -> DataFrame:
    """The first batch that gives a descriptor of an image wins."""
    usable = views(spark, sf).filter("image_id is not null and batch_id is not null and descriptors is not null")
    return usable.groupBy("image_id").agg(F.min_by("member_id", F.col("batch_id") * 1000000 + F.col("pos")).alias("member_id"))


@book.query(f"WITH {VIEWS} SELECT image_id, batch_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pos, batch_id, member_id) k FROM vw WHERE image_id IS NOT NULL AND batch_id IS NOT NULL) WHERE k = 1")
def place_min_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Each image takes its place from the batch in which it stands nearest to the first view."""
    from skyweave.operators.graph import place_by_rank

    return place_by_rank(views(spark, sf).filter("image_id is not null and batch_id is not null"), "image_id", ["pos", "batch_id", "member_id"]).select("image_id", "batch_id", "pos")


@book.query(f"WITH {VIEWS} SELECT kind, count(DISTINCT batch_id) AS batches, count(*) AS views, floor(avg(cam_conf) * 1e6 + 0.5) / 1e6 AS mean_conf FROM vw GROUP BY ROLLUP (kind)")
def kind_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Batches and views by kind, with the total."""
    return views(spark, sf).rollup("kind").agg(F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("views"), six(F.avg("cam_conf")).alias("mean_conf"))
