"""Streams into mergeable accumulators.

Every micro-batch is reduced to partial sums and written under its batch number, so a batch that is repeated after a
failure replaces itself. Reading merges the partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyweave.operators.pairs import unordered


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under ``path`` (or of that one file), with the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def _run(stream: DataFrame, reduce, out: str, checkpoint: str) -> StreamingQuery:
    def keep(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulate_pairs(stream: DataFrame, a: str, b: str, value: str, out: str, checkpoint: str) -> StreamingQuery:
    """Sum, count and maximum per unordered pair; missing values do not count."""

    def reduce(batch: DataFrame) -> DataFrame:
        v = F.col(value).cast("double")
        rows = unordered(batch.filter(v.isNotNull() & ~F.isnan(v)), a, b)
        return rows.groupBy("i", "j").agg(F.sum(v).alias("total"), F.count(v).alias("n"), F.max(v).alias("top"))

    return _run(stream, reduce, out, checkpoint)


def accumulated_pairs(spark: SparkSession, out: str) -> DataFrame:
    parts = spark.read.schema("i int, j int, total double, n bigint, top double").parquet(f"{out}/batch=*")
    merged = parts.groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top"))
    return merged.withColumn("mean", F.col("total") / F.col("n"))


def accumulate_windows(stream: DataFrame, at: str, width: str, slide: str, kind: str, value: str, out: str, checkpoint: str) -> StreamingQuery:
    """Counts and sums per sliding window and kind, however late the rows come."""

    def reduce(batch: DataFrame) -> DataFrame:
        w = F.window(F.col(at).cast("timestamp"), width, slide)
        return batch.groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")

    return _run(stream, reduce, out, checkpoint)


def accumulated_windows(spark: SparkSession, out: str) -> DataFrame:
    parts = spark.read.schema("start timestamp, kind string, n bigint, total double").parquet(f"{out}/batch=*")
    return parts.groupBy("start", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def upsert_latest(stream: DataFrame, keys: list[str], at: str, values: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """The latest row of every key, per micro-batch; :func:`latest_of` merges the batches."""
    from skyweave.operators.keyed import latest

    return _run(stream, lambda batch: latest(batch.select(*keys, at, *values), keys, at, values), out, checkpoint)


def latest_of(spark: SparkSession, out: str, keys: list[str], at: str, values: list[str]) -> DataFrame:
    from skyweave.operators.keyed import latest

    return latest(spark.read.parquet(f"{out}/batch=*"), keys, at, values)


def closed_windows(stream: DataFrame, at: str, late: str, width: str, kind: str) -> DataFrame:
    """A streaming aggregate with a watermark: a window is final once rows are later than ``late`` past its end."""
    rows = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return rows.groupBy(F.window("__at", width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
