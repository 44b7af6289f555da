"""Queries over the capture order of the photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators.ordering import grouped_quantile, running_totals, six, with_index
from skyweave.operators.sequences import consecutive_runs, run_means, steps, sweep_windows
from skyweave.plans.photos import photo_positions
from skyweave.plans.tables import OBS, Book, observations, table

book = Book()


def names(spark: SparkSession, sf: str) -> DataFrame:
    """``name, seq, frame``: every image name once; the sequence is what stands before the last underscore."""
    n = table(spark, sf, "images").select("name").unionByName(table(spark, sf, "anchor_images").select("name")).filter("name is not null").distinct()
    return n.select("name", F.regexp_extract("name", r"^(.*)_", 1).alias("seq"), F.expr(r"try_cast(regexp_extract(name, '_([0-9]+)[.][^.]*$', 1) as int)").alias("frame"))


_NAMES = r"""nm AS (SELECT name, regexp_extract(name, '^(.*)_', 1) AS seq, TRY_CAST(regexp_extract(name, '_([0-9]+)[.][^.]*$', 1) AS INTEGER) AS frame
  FROM (SELECT name FROM images UNION SELECT name FROM anchor_images) WHERE name IS NOT NULL)"""


@book.query(f"WITH {_NAMES} SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM nm")
def name_order(spark: SparkSession, sf: str) -> DataFrame:
    """Images numbered from 0 in the order of their names."""
    return with_index(names(spark, sf).select("name"), [F.col("name")])


@book.query(f"WITH {_NAMES}, x AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM nm) SELECT name, CASE WHEN idx % 8 = 0 THEN 'test' ELSE 'train' END AS part FROM x")
def split_every_8th(spark: SparkSession, sf: str) -> DataFrame:
    return name_order(spark, sf).select("name", F.when(F.col("idx") % 8 == 0, "test").otherwise("train").alias("part"))


@book.query(
    f"WITH {_NAMES}, x AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM nm WHERE frame % 5 <> 0), p AS (SELECT name, idx % 8 = 0 AS t, row_number() OVER (PARTITION BY idx % 8 = 0 ORDER BY name) - 1 AS k FROM x) "
    "SELECT name, CASE WHEN t THEN 8 * k ELSE 8 * (k // 7) + 1 + k % 7 END AS slot FROM p"
)
def interleave_test_slots(spark: SparkSession, sf: str) -> DataFrame:
    """One test image and seven training images in turn, after some images have been dropped."""
    kept = with_index(names(spark, sf).filter("frame % 5 != 0").select("name"), [F.col("name")]).withColumn("t", F.col("idx") % 8 == 0)
    run = running_totals(kept, [F.col("name")], {"tests": F.col("t").cast("long"), "trains": (~F.col("t")).cast("long")})
    k = F.col("trains") - 1
    return run.select("name", F.when(F.col("t"), 8 * (F.col("tests") - 1)).otherwise(8 * F.floor(k / 7) + 1 + k % 7).alias("slot"))


@book.query(
    f"WITH {_NAMES}, x AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY name) - 1 AS pos, count(*) OVER (PARTITION BY seq) AS n FROM nm), f AS (SELECT *, greatest(CAST(floor((n - 8) / 4) AS BIGINT) + 1, 0) AS fl FROM x), "
    "w AS (SELECT seq, name, pos, fl, n, unnest(generate_series(0, fl)) AS w FROM f), b AS (SELECT *, CASE WHEN w = fl THEN greatest(n - 8, 0) ELSE 4 * w END AS start FROM w WHERE w < fl OR fl = 0 OR (fl - 1) * 4 + 8 < n) "
    "SELECT seq, name, w AS window, pos - start AS slot FROM b WHERE pos >= start AND pos < start + 8"
)
def sweep_windows_of_8(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding windows of 8 photos every 4, with a last one aligned to the end."""
    return sweep_windows(names(spark, sf), "seq", [F.col("name")]).select("seq", "name", "window", "slot")


@book.query(f"WITH {_NAMES}, x AS (SELECT DISTINCT seq, frame FROM nm WHERE frame IS NOT NULL), r AS (SELECT *, frame - row_number() OVER (PARTITION BY seq ORDER BY frame) AS run FROM x) SELECT seq, CAST(min(frame) AS BIGINT) AS first, CAST(max(frame) AS BIGINT) AS last, count(*) AS n FROM r GROUP BY seq, run")
def frame_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive frame numbers in every sequence."""
    return consecutive_runs(names(spark, sf), "seq", "frame")


_PLACES = r"""g AS (SELECT regexp_extract(names, '[^/\\]*$') AS name, lla[1] AS lat, lla[2] AS lon, received_at FROM gps WHERE names IS NOT NULL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY received_at DESC NULLS LAST, lat DESC NULLS LAST, lon DESC NULLS LAST) k FROM g) WHERE k = 1),
pl AS (SELECT name, regexp_extract(name, '^(.*)_', 1) AS seq, lat, lon FROM l WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0) AND abs(lat) <= 90 AND abs(lon) <= 180)"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    p = photo_positions(spark, sf).filter("lat is not null and lon is not null")
    return p.select("name", F.regexp_extract("name", r"^(.*)_", 1).alias("seq"), "lat", "lon")


_STEP = "111320 * sqrt(power(lat - prev_lat, 2) + power((lon - prev_lon) * cos(radians(lat)), 2))"


@book.query(
    f"WITH {_PLACES}, s AS (SELECT *, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon FROM pl WINDOW w AS (PARTITION BY seq ORDER BY name)) "
    f"SELECT seq, floor(median({_STEP}) * 1e3 + 0.5) / 1e3 AS spacing FROM s WHERE prev_lat IS NOT NULL GROUP BY 1"
)
def consecutive_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """Median distance in metres between consecutive photos of a sequence."""
    s = steps(places(spark, sf), "seq", [F.col("name")], ["lat", "lon"]).withColumn("d", F.expr(_STEP))
    return grouped_quantile(s, "seq", "d", 0.5).select("seq", (F.floor(F.col("q") * 1e3 + 0.5) / 1e3).alias("spacing"))


@book.query(
    f"WITH {_PLACES}, m AS (SELECT seq, avg(lat) AS a, avg(lon) AS o FROM pl GROUP BY 1), d AS (SELECT seq, name, 111320 * sqrt(power(lat - a, 2) + power((lon - o) * cos(radians(lat)), 2)) AS d FROM pl JOIN m USING (seq)), "
    "r AS (SELECT seq, avg(d) OVER w AS m, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY seq ORDER BY name ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT seq, floor(min(m) * 1e3 + 0.5) / 1e3 AS nearest FROM r WHERE n = 3 GROUP BY 1"
)
def run_of_three_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The three consecutive photos that are nearest to the middle of their sequence: their mean distance."""
    p = places(spark, sf)
    middle = p.groupBy("seq").agg(F.avg("lat").alias("a"), F.avg("lon").alias("o"))
    d = p.join(middle, "seq").withColumn("d", F.expr("111320 * sqrt(power(lat - a, 2) + power((lon - o) * cos(radians(lat)), 2))")).select("seq", "name", "d")
    return run_means(d, "seq", [F.col("name")], "d").groupBy("seq").agg((F.floor(F.min("mean") * 1e3 + 0.5) / 1e3).alias("nearest"))


@book.query("SELECT flight, dense_rank() OVER (ORDER BY flight) - 1 AS label, n FROM (SELECT flight, count(*) AS n FROM gps WHERE flight IS NOT NULL GROUP BY 1)")
def flight_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Flights numbered in sort order."""
    flights = table(spark, sf, "gps").filter("flight is not null").groupBy("flight").agg(F.count(F.lit(1)).alias("n"))
    return with_index(flights, [F.col("flight")], "label").select("flight", "label", "n")


@book.query(f"WITH {OBS}, c AS (SELECT m AS image_id, count(*) AS n FROM o GROUP BY 1) SELECT image_id, n, CAST(sum(n) OVER (ORDER BY image_id) - n AS BIGINT) AS first FROM c")
def prefix_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each image's points begin in one numbering over all images."""
    c = observations(spark, sf).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(c, [F.col("image_id")], {"upto": F.col("n")}).select("image_id", "n", (F.col("upto") - F.col("n")).cast("long").alias("first"))


@book.query(f"WITH {OBS}, c AS (SELECT m AS image_id, count(*) AS n FROM o GROUP BY 1) SELECT image_id, n FROM c ORDER BY n DESC, image_id LIMIT 100")
def busiest_images(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 images with most points: a report."""
    return observations(spark, sf).groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "image_id").limit(100)


@book.query("SELECT image_id, camera_id, count(*) AS n FROM images WHERE image_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images that were delivered more than once."""
    return table(spark, sf, "images").filter("image_id is not null").groupBy("image_id", "camera_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@book.query("SELECT image_id, name FROM (SELECT image_id, name FROM images UNION SELECT image_id, name FROM anchor_images) WHERE image_id IN (SELECT obs_img FROM track_obs INTERSECT SELECT image_id FROM batch_members)")
def images_in_both(spark: SparkSession, sf: str) -> DataFrame:
    """Images that are observed and were processed in a batch."""
    both = table(spark, sf, "track_obs").select(F.col("obs_img").alias("image_id")).intersect(table(spark, sf, "batch_members").select("image_id"))
    named = table(spark, sf, "images").select("image_id", "name").union(table(spark, sf, "anchor_images").select("image_id", "name")).distinct()
    return named.join(both, "image_id", "left_semi")
