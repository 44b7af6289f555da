"""Queries through files and streams: what is written and read again, or streamed, must equal the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators.ordering import six
from skyweave.plans.tables import POSED, Book, posed, table
from skyweave.session import scratch_path
from skyweave.sources.colmap import read_images, write_images
from skyweave.streaming.accumulators import accumulate_pairs, accumulate_windows, accumulated_pairs, accumulated_windows, file_stream, latest_of, upsert_latest

book = Book()


_SIX = ", ".join(f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz"))


@book.query(f"WITH {POSED} SELECT image_id, {_SIX}, camera_id, name FROM ps WHERE camera_id IS NOT NULL AND name IS NOT NULL")
def images_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Posed images written as a text model and read again."""
    path = scratch_path(spark, "images-txt")
    write_images(posed(spark, sf).filter("image_id is not null and camera_id is not null and name is not null"), path)
    return read_images(spark, path).select("image_id", *[six(F.col(c)).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], "camera_id", "name")


@book.query("SELECT least(image_i, image_j) AS i, greatest(image_i, image_j) AS j, count(*) AS n, floor(sum(CAST(overlap AS DOUBLE)) * 1e4 + 0.5) / 1e4 AS total FROM batch_pairs WHERE image_i <> image_j AND overlap IS NOT NULL AND NOT isnan(overlap) GROUP BY 1, 2")
def stream_pair_sums(spark: SparkSession, sf: str) -> DataFrame:
    """All delivered measurements as a stream into pair accumulators."""
    out = scratch_path(spark, "stream-pairs")
    accumulate_pairs(file_stream(spark, f"{sf}/batch_pairs.parquet"), "image_i", "image_j", "overlap", out, out + "-state").awaitTermination()
    return accumulated_pairs(spark, out).select("i", "j", "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"))


@book.query(
    "WITH w AS (SELECT event_type, value, unnest([CAST(floor(epoch(ts) / 86400) AS BIGINT) - 1, CAST(floor(epoch(ts) / 86400) AS BIGINT)]) AS day FROM events) "
    "SELECT day, event_type AS kind, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM w GROUP BY 1, 2"
)
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events in windows of two days that slide by one, streamed."""
    out = scratch_path(spark, "stream-windows")
    events = file_stream(spark, f"{sf}/events.parquet")
    accumulate_windows(events, "ts", "2 days", "1 day", "event_type", "value", out, out + "-state").awaitTermination()
    w = accumulated_windows(spark, out)
    return w.select(F.floor(F.unix_timestamp("start") / 86400).cast("long").alias("day"), "kind", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"))


@book.query(
    "SELECT image_id, other_id, CASE WHEN NOT isfinite(score) THEN NULL WHEN abs(score) < 1e9 THEN floor(CAST(score AS DOUBLE) * 1e6 + 0.5) / 1e6 ELSE CAST(score AS DOUBLE) END AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, other_id ORDER BY updated_at DESC NULLS LAST, score DESC NULLS LAST) k "
    "FROM camera_connections WHERE image_id <> other_id) WHERE k = 1"
)
def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Entries written again, streamed: the latest wins; if its score is not finite, the score is missing."""
    out = scratch_path(spark, "stream-upserts")
    rows = file_stream(spark, f"{sf}/camera_connections.parquet").filter("image_id != other_id")
    upsert_latest(rows, ["image_id", "other_id"], "updated_at", ["score"], out, out + "-state").awaitTermination()
    newest = latest_of(spark, out, ["image_id", "other_id"], "updated_at", ["score"])
    score, size = F.col("score").cast("double"), F.abs("score")
    return newest.select("image_id", "other_id", F.when(size < 1e9, six(score)).when(~F.isnan("score") & (size != float("inf")), score).alias("score"))  # a float of 1e9 has no decimals


@book.query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2) GROUP BY 1")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user, closed by six hours without an event."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@book.query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """A number from the JSON properties, summed by kind."""
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
