"""Graph traversal over the measured pairs and the feature matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators.budget import track_budget
from skyweave.operators.covis import normalise, points_per_image, shared_counts
from skyweave.operators.graph import balls, build_tracks, component_sizes, components, farthest_seeds_cover, hop_pairs, hops, max_product_paths, spanning_forest, walk_back
from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import running_totals, six
from skyweave.operators.pairs import accumulate
from skyweave.plans.tables import MEASURED, OBS, SHARED, Book, measurements, observations, table
from skyweave.session import materialise

book = Book()


def overlap_edges(spark: SparkSession, sf: str, least: float = 0.2) -> DataFrame:
    """``i, j, weight``: pairs with a mean measured overlap of at least ``least``, rounded to 6 decimals."""
    return accumulate(measurements(spark, sf), "overlap").select("i", "j", six(F.col("mean")).alias("weight")).filter(F.col("weight") >= least)


_EDGES = MEASURED + ", ed AS (SELECT i, j FROM mp WHERE floor(mean * 1e6 + 0.5) / 1e6 >= 0.2), be AS (SELECT i AS src, j AS dst FROM ed UNION ALL SELECT j, i FROM ed)"
_REACH = f"WITH RECURSIVE {_EDGES}, r(node, g) AS (SELECT DISTINCT src, src FROM be UNION SELECT be.dst, r.g FROM r JOIN be ON be.src = r.node WHERE r.g < be.dst), lb AS (SELECT node, min(g) AS component FROM r GROUP BY 1)"


@book.query(_REACH + " SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM lb")
def view_components(spark: SparkSession, sf: str) -> DataFrame:
    return components(overlap_edges(spark, sf))


@book.query(_REACH + " SELECT CAST(component AS BIGINT) AS component, count(*) AS size FROM lb GROUP BY 1")
def island_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return component_sizes(components(overlap_edges(spark, sf)))


def near_anchors(spark: SparkSession, sf: str, hops_: int = 2) -> DataFrame:
    """``ball, node``: what every image reaches in ``hops_`` steps of the overlap graph."""
    edges = overlap_edges(spark, sf)
    nodes = edges.select(F.col("i").alias("node")).unionByName(edges.select(F.col("j").alias("node")))
    return hop_pairs(edges, nodes, max_hops=hops_).select(F.col("source").alias("ball"), "node")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "anchor_images").select(F.col("image_id").alias("node")).distinct()


_SEEN = SHARED + ", be AS (SELECT i AS src, j AS dst FROM s WHERE shared >= 3 UNION ALL SELECT j, i FROM s WHERE shared >= 3)"


def seen_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``i, j, weight``: pairs that share at least 3 points; overlap as weight, rounded."""
    obs = observations(spark, sf)
    shared = shared_counts(obs).filter("shared >= 3")
    return normalise(shared, points_per_image(obs), "overlap").select("i", "j", six(F.col("score")).alias("weight"))


#: steps from the nearest anchor, to the end of every chain
_HOPS = "h(node, d) USING KEY (node) AS (SELECT image_id, 0 FROM (SELECT DISTINCT image_id FROM anchor_images) UNION SELECT be.dst, min(h.d) + 1 FROM h JOIN be ON be.src = h.node LEFT JOIN recurring.h AS k ON k.node = be.dst WHERE k.node IS NULL GROUP BY be.dst)"


@book.query(f"WITH RECURSIVE {_SEEN}, {_HOPS} SELECT CAST(node AS BIGINT) AS node, d AS hops FROM h")
def hop_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from the nearest anchor."""
    return hops(seen_edges(spark, sf), anchors(spark, sf))


_PAIRS = "hp(source, node, d) USING KEY (source, node) AS (SELECT DISTINCT image_id, image_id, 0 FROM anchor_images UNION SELECT hp.source, be.dst, min(hp.d) + 1 FROM hp JOIN be ON be.src = hp.node LEFT JOIN recurring.hp AS k ON k.source = hp.source AND k.node = be.dst WHERE k.node IS NULL GROUP BY hp.source, be.dst)"


@book.query(f"WITH RECURSIVE {_SEEN}, {_PAIRS} SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS node, d AS hops FROM hp")
def hops_from_each_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from every single anchor to every image that it reaches."""
    return hop_pairs(seen_edges(spark, sf), anchors(spark, sf))


@book.query(
    f"WITH RECURSIVE {_EDGES}, bl AS (SELECT DISTINCT a.src AS ball, b.dst AS node FROM be a JOIN be b ON b.src = a.dst UNION SELECT src, dst FROM be UNION SELECT src, src FROM be), "
    "nd AS (SELECT count(DISTINCT src) AS nodes FROM be) SELECT nodes, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS rising_gains, CAST(0 AS BIGINT) AS wrong_gains, (SELECT max(n) FROM (SELECT count(*) AS n FROM bl GROUP BY ball)) AS first_gain FROM nd"
)
def cover_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The greedy cover of the overlap graph by balls of two steps: all nodes covered, gains as counted and never rising, the largest ball first."""
    sets = materialise(near_anchors(spark, sf), "cover-sets")
    taken = materialise(farthest_seeds_cover(sets), "cover-found")
    covered = sets.join(taken, "ball").groupBy("node").agg(F.min(F.struct("round", "ball")).alias("by"))
    counted = covered.groupBy(F.col("by.ball").alias("ball")).agg(F.count(F.lit(1)).alias("counted"))
    wrong = taken.join(counted, "ball", "left").agg(F.count_if(~F.col("gain").eqNullSafe(F.col("counted"))).alias("wrong_gains"))
    after = taken.select((F.col("round") - 1).alias("round"), F.col("gain").alias("next"))
    rising = taken.join(after, "round").agg(F.count_if(F.col("next") > F.col("gain")).alias("rising_gains"))
    nodes = sets.select("node").distinct()
    open_ = nodes.join(covered, "node", "left_anti").agg(F.count(F.lit(1)).alias("uncovered"))
    first = taken.filter("round = 0").agg(F.max("gain").alias("first_gain"))
    one = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    for part in (open_, rising, wrong, first):
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one


#: weighted edges both ways, and the strongest paths by the same rounds as the operator: all nodes that changed offer paths to their neighbours
_PATHS = f"""{SHARED}, we AS (SELECT i, j, floor(shared / least(a.n, b.n) * 1e6 + 0.5) / 1e6 AS w FROM s JOIN n a ON a.m = i JOIN n b ON b.m = j WHERE shared >= 3),
bw AS (SELECT i AS src, j AS dst, w FROM we UNION ALL SELECT j, i, w FROM we),
pa(node, weight, source, parent, hops) USING KEY (node) AS (
  SELECT DISTINCT image_id, CAST(1 AS DOUBLE), image_id, CAST(NULL AS INTEGER), 0 FROM anchor_images
  UNION
  SELECT o.node, o.b.weight, o.b.source, o.b.parent, o.b.hops FROM (
    SELECT dst AS node, arg_max({{'weight': weight * w, 'source': source, 'parent': src, 'hops': hops + 1}}, (weight * w, -(hops + 1), -source, -src)) AS b
    FROM pa JOIN bw ON bw.src = pa.node WHERE weight * w >= 0.01 GROUP BY 1) o
  LEFT JOIN recurring.pa AS k ON k.node = o.node WHERE k.node IS NULL OR o.b.weight > k.weight)"""


def _strongest(spark: SparkSession, sf: str) -> DataFrame:
    return max_product_paths(seen_edges(spark, sf), anchors(spark, sf), "weight", min_weight=0.01)


@book.query(f"WITH RECURSIVE {_PATHS} SELECT CAST(node AS BIGINT) AS node, weight, CAST(source AS BIGINT) AS source, CAST(coalesce(parent, -1) AS BIGINT) AS parent, hops FROM pa")
def strongest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest path from any anchor to every image that one reaches with a product of at least 0.01; anchors have the parent -1."""
    return _strongest(spark, sf).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


@book.query(f"WITH RECURSIVE {_PATHS}, wk(target, step, node, parent) AS (SELECT node, hops, node, parent FROM pa UNION ALL SELECT wk.target, wk.step - 1, pa.node, pa.parent FROM wk JOIN pa ON pa.node = wk.parent) SELECT CAST(target AS BIGINT) AS target, step, CAST(node AS BIGINT) AS node FROM wk")
def path_walkback(spark: SparkSession, sf: str) -> DataFrame:
    """The images along the strongest path to each image."""
    paths = materialise(_strongest(spark, sf), "paths-found")
    return walk_back(paths, paths.select("node"))


#: an edge is in the forest if it is the weakest of no circle: the best weakest edge of all paths between its ends is itself
_FOREST = f"""WITH RECURSIVE {_EDGES}, wt AS (SELECT i, j, floor(mean * 1e6 + 0.5) / 1e6 AS weight, row_number() OVER (ORDER BY floor(mean * 1e6 + 0.5) / 1e6, -i, -j) AS r FROM mp WHERE floor(mean * 1e6 + 0.5) / 1e6 >= 0.2),
bt AS (SELECT i AS src, j AS dst, r FROM wt UNION ALL SELECT j, i, r FROM wt),
bn(a, b, r) USING KEY (a, b) AS (
  SELECT src, dst, r FROM bt
  UNION
  SELECT o.a, o.b, o.r FROM (SELECT bn.a, bt.dst AS b, max(least(bn.r, bt.r)) AS r FROM bn JOIN bt ON bt.src = bn.b WHERE bn.a <> bt.dst GROUP BY 1, 2) o
  LEFT JOIN recurring.bn AS k ON k.a = o.a AND k.b = o.b WHERE k.a IS NULL OR o.r > k.r)
SELECT CAST(wt.i AS BIGINT) AS i, CAST(wt.j AS BIGINT) AS j, weight FROM wt JOIN bn ON bn.a = wt.i AND bn.b = wt.j WHERE bn.r = wt.r"""


@book.query(_FOREST)
def overlap_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum spanning forest of the measured overlap."""
    return spanning_forest(overlap_edges(spark, sf), "weight")


_FM = """WITH RECURSIVE e AS (SELECT DISTINCT x, y FROM (SELECT obs_img_a::BIGINT * 4294967296 + obs_feat_a AS x, obs_img_b::BIGINT * 4294967296 + obs_feat_b AS y FROM feature_matches
  WHERE verified AND score >= 0.5 AND NOT isnan(score) AND obs_img_a IS NOT NULL AND obs_feat_a IS NOT NULL AND obs_img_b IS NOT NULL AND obs_feat_b IS NOT NULL) WHERE x <> y),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, g) AS (SELECT DISTINCT x, x FROM b UNION SELECT b.y, r.g FROM r JOIN b ON b.x = r.node WHERE r.g < b.y),
c AS (SELECT node, min(g) AS g FROM r GROUP BY 1), d AS (SELECT g, node // 4294967296 AS img, node % 4294967296 AS feat FROM c),
k AS (SELECT g FROM d GROUP BY 1 HAVING count(*) >= 2 AND count(*) = count(DISTINCT img))
SELECT g AS track_id, CAST(img AS INTEGER) AS image_id, CAST(feat AS INTEGER) AS feat_id FROM d WHERE g IN (SELECT g FROM k)"""


@book.query(_FM)
def tracks_from_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks from verified matches with a score of at least 0.5; tracks with two features of an image are dropped."""
    m = table(spark, sf, "feature_matches").filter("verified and score >= 0.5 and not isnan(score)")
    return build_tracks(m, "obs_img_a", "obs_feat_a", "obs_img_b", "obs_feat_b")


_BALLS = f"""WITH RECURSIVE {_EDGES}, ba(source, node, layer, place) USING KEY (source, node) AS (
  SELECT DISTINCT src, src, 0, 0 FROM be
  UNION
  SELECT f.source, f.node, f.layer, CAST(f.held + f.r - 1 AS INTEGER) FROM (
    SELECT l.*, h.held, row_number() OVER (PARTITION BY l.source ORDER BY links DESC, l.node) AS r FROM (
      SELECT ba.source, be.dst AS node, max(ba.layer) + 1 AS layer, count(*) AS links FROM ba JOIN be ON be.src = ba.node GROUP BY 1, 2) l
    JOIN (SELECT source, count(*) AS held FROM recurring.ba GROUP BY 1) h ON h.source = l.source
    LEFT JOIN recurring.ba AS k ON k.source = l.source AND k.node = l.node WHERE k.node IS NULL) f
  WHERE f.r <= 24 - f.held)
SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS node, layer, place FROM ba"""


@book.query(_BALLS)
def image_balls(spark: SparkSession, sf: str) -> DataFrame:
    """The 24 images around every image of the overlap graph."""
    edges = overlap_edges(spark, sf)
    nodes = edges.select(F.col("i").alias("node")).unionByName(edges.select(F.col("j").alias("node")))
    return balls(edges, nodes, 24)


@book.query(f"WITH {OBS} SELECT count(DISTINCT p) AS tracks, CAST(0 AS BIGINT) AS wrongly_kept, CAST(0 AS BIGINT) AS wrongly_left_out FROM o")
def budget_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What makes a choice the greedy one: a track is kept if, and only if, fewer than 100 kept tracks before it are in one of its images."""
    obs = materialise(observations(spark, sf), "audit-obs")
    kept = materialise(track_budget(obs, "point_id", "image_id", 100).select("point_id").distinct().withColumn("kept", F.lit(1)), "audit-kept")
    length = obs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))
    rows = obs.join(length, "point_id").join(kept, "point_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    run = running_totals(rows, [F.col("image_id"), F.col("n").desc(), F.col("point_id")], {"upto": F.col("kept")})
    run = materialise(run, "audit-run")
    first = run.groupBy("image_id").agg(F.min(F.col("upto") - F.col("kept")).alias("before"))
    low = F.col("upto") - F.col("kept") - F.col("before") < 100
    judged = lookup_join(run, first, "image_id", "inner").groupBy("point_id").agg(F.max(low).alias("due"), F.max("kept").alias("kept"))
    return judged.agg(F.count(F.lit(1)).alias("tracks"), F.count_if((F.col("kept") == 1) & ~F.col("due")).alias("wrongly_kept"), F.count_if((F.col("kept") == 0) & F.col("due")).alias("wrongly_left_out"))


@book.query()
def budgeted_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The observations of the tracks that are kept when every image needs 100 of them."""
    return track_budget(observations(spark, sf), "point_id", "image_id", 100)
