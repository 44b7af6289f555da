"""Versioned snapshots of several tables: a later round is visible only once all of its tables are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_round(spark: SparkSession, path: str, number: int, tables: dict[str, DataFrame]) -> None:
    """Writes the tables of a round and then, last, its entry in the manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/round={number}/{name}")
    spark.createDataFrame([(number, sorted(tables))], "round int, tables array<string>").coalesce(1).write.mode("append").json(f"{path}/manifest")


def latest_round(spark: SparkSession, path: str) -> int | None:
    """The last complete round, or None."""
    try:
        found = spark.read.schema("round int, tables array<string>").json(f"{path}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return found.agg(F.max("round")).first()[0]


def load_round(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a round (default: the last complete one)."""
    number = latest_round(spark, path) if number is None else number
    if number is None:
        raise FileNotFoundError(f"{path} has no complete round")
    entry = spark.read.schema("round int, tables array<string>").json(f"{path}/manifest").filter(F.col("round") == number).first()
    if entry is None:
        raise FileNotFoundError(f"{path} has no complete round {number}")
    return {name: spark.read.parquet(f"{path}/round={number}/{name}") for name in entry.tables}


def same_images(saved: DataFrame, now: DataFrame, name: str) -> bool:
    """Whether a saved round may be resumed: its images are those of now, in number and name."""
    a, b = saved.select(name).filter(F.col(name).isNotNull()), now.select(name).filter(F.col(name).isNotNull())
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
