"""Capture sequences: windows, runs and spacing of ordered rows. A sequence may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.operators.ordering import positions_in_group


def sweep_windows(df: DataFrame, group: str, order: list[Column], size: int = 8, stride: int = 4) -> DataFrame:
    """``df`` once per window that holds the row, with ``window`` (from 0) and ``slot``.

    Windows of ``size`` start every ``stride`` rows as long as they fit; a last one is aligned to the end if rows are left over.
    A shorter sequence is one window.
    """
    placed = positions_in_group(df, group, order)
    full = F.greatest(F.floor((F.col("size") - size) / stride) + 1, F.lit(0))
    first = F.greatest(F.ceil((F.col("pos") - (size - 1)) / stride), F.lit(0))
    last = F.least(F.floor(F.col("pos") / stride), full - 1)
    regular = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    begin = F.greatest(F.col("size") - size, F.lit(0))
    left_over = (full == 0) | ((full - 1) * stride + size < F.col("size"))
    tail = F.when(left_over & (F.col("pos") >= begin), F.array(full)).otherwise(F.array().cast("array<bigint>"))
    out = placed.withColumn("__begin", begin).withColumn("__full", full).withColumn("window", F.explode(F.concat(regular, tail)))
    start = F.when(F.col("window") == F.col("__full"), F.col("__begin")).otherwise(F.col("window") * stride)
    return out.withColumn("slot", F.col("pos") - start).drop("__begin", "__full", "pos", "size")


def consecutive_runs(df: DataFrame, group: str, number: str) -> DataFrame:
    """``group, first, last, n``: maximal runs of consecutive numbers; repeated numbers count once."""
    d = df.select(group, F.col(number).cast("long").alias("x")).filter("x is not null").distinct()
    runs = positions_in_group(d, group, [F.col("x")]).withColumn("run", F.col("x") - F.col("pos"))
    return runs.groupBy(group, "run").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def steps(df: DataFrame, group: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Each row with the given columns of the row before it in its group, as ``prev_<column>``; first rows are left out.

    Rows meet their predecessor by place, in a shuffle over places rather than over groups.
    """
    placed = positions_in_group(df, group, order)
    here = placed.select(F.struct(group, "pos").alias("__at"), *[F.col(c) for c in df.columns])
    before = placed.select(F.struct(group, (F.col("pos") + 1).alias("pos")).alias("__at"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return here.join(before, "__at").drop("__at")


def run_means(df: DataFrame, group: str, order: list[Column], value: str, width: int = 3) -> DataFrame:
    """``group, start, mean``: mean of every ``width`` consecutive rows, by the place of the first."""
    placed = positions_in_group(df, group, order)
    starts = F.explode(F.sequence(F.greatest(F.col("pos") - (width - 1), F.lit(0)), F.col("pos")))
    spread = placed.select(group, F.col(value).alias("v"), starts.alias("start"))
    return spread.groupBy(group, "start").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == width).drop("n")
