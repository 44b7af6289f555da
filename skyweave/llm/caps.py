"""Capping the records of dominant contributors, by count or by share.

A share limit is solved by water-filling: with contributors sorted by count, the k largest are cut to a
common level c and all others stay whole, where c is the largest level that is at most ``max_share`` of
what is then left. Each contributor then keeps its best records up to the level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.keyed import lookup_join
from skyweave.session import materialise, shuffle_width

#: Up to this level a contributor's rows are ranked after every map partition has been cut to the level.
#: Above it, contributors are ranked across range partitions, so that no task holds one contributor whole.
DIRECT_LEVEL = 1000


def water_level(counts: DataFrame, count: str = "n", *, max_count: int | None = None, max_share: float | None = None) -> int:
    """The largest common level L for which ``min(n, L)`` of every contributor meets both limits.

    ``counts`` has one row per contributor. The work is done on the histogram of counts; n different counts need at
    least n(n+1)/2 records, so R records have at most sqrt(2R) of them. A contributor of which the share
    cannot be met by any level of at least 1 (fewer than 1/max_share contributors) keeps one record.
    Without contributors, or without limits, the level is the largest count (0 for none).
    """
    if max_count is not None and max_count < 1:
        raise ValueError("max_count must be at least 1")
    if max_share is not None and not 0 < max_share <= 1:
        raise ValueError("max_share must be above 0 and at most 1")
    histogram = counts.groupBy(F.col(count).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("contributors"))
    down = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum(F.col("n") * F.col("contributors")).over(Window.partitionBy()) - F.sum(F.col("n") * F.col("contributors")).over(down)
    filled = histogram.select("n", F.sum("contributors").over(down).alias("cut"), below.alias("whole"), F.lead("n", 1, 0).over(Window.orderBy(F.col("n").desc())).alias("next"))
    top = filled.agg(F.max("n")).first()[0] or 0
    level = top if max_count is None else min(top, max_count)
    if max_share is not None and top:
        s = F.lit(float(max_share))
        # with `cut` contributors at level c and `whole` records below: c <= s * (cut * c + whole)
        free = s * F.col("cut") >= 1
        solved = F.when(free, F.col("n")).otherwise(F.least(F.col("n").cast("double"), s * F.col("whole") / (1 - s * F.col("cut"))))
        c = filled.select(F.floor(solved + F.lit(1e-9)).alias("c"), "next").filter("c >= next").agg(F.max("c")).first()[0]
        level = min(level, max(1, int(c or 0)))
    return int(level)


def _rank_direct(rows: DataFrame, order: list, level: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("rank") <= level + 1)
    return ranked.withColumn("capped", F.max("rank").over(Window.partitionBy("g")) > level).filter(F.col("rank") <= level)


def _rank_ranged(rows: DataFrame, order: list, level: int, counts: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    placed = rows.repartitionByRange(shuffle_width(spark), F.col("g").asc_nulls_first(), *order).withColumn("pid", F.spark_partition_id())
    placed = materialise(placed, "caps-ranged")
    sizes = placed.groupBy("g", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.struct("g", "pid").alias("gp"), before.alias("before"))
    local = placed.withColumn("local", F.row_number().over(Window.partitionBy("g", "pid").orderBy(*order))).withColumn("gp", F.struct("g", "pid"))
    local = materialise(local, "caps-local")
    # one row of offsets per contributor and partition carries the contributor's total along
    total = counts.select(F.struct("g").alias("gk"), (F.col("n") > level).alias("capped"))
    offsets = lookup_join(offsets.withColumn("gk", F.struct("gp.g")), total, "gk", "inner").select("gp", "before", "capped")
    ranked = lookup_join(local, materialise(offsets, "caps-offsets"), "gp", "inner").withColumn("rank", (F.col("before") + F.col("local")).cast("int"))
    return ranked.filter(F.col("rank") <= level).drop("gp", "pid", "local", "before")


def cap_contributors(
    df: DataFrame,
    contributor: str,
    quality: str,
    ties: Sequence[str],
    *,
    max_count: int | None = None,
    max_share: float | None = None,
    direct_level: int = DIRECT_LEVEL,
) -> DataFrame:
    """Cut every contributor to the water level, keeping its best records.

    Returns ``contributor, quality, *ties, rank, capped, level``: the kept records with their rank in the
    contributor, whether the contributor lost records, and the level; other columns of ``df`` are left out.

    * order: highest ``quality`` first, missing quality (NULL or NaN) last, then smaller ``ties``, NULL
      last; of rows that are equal in all of them as many are kept as the level allows;
    * a NULL contributor counts as one contributor; empty input gives an empty result.
    """
    if max_count is None and max_share is None:
        raise ValueError("give max_count or max_share")
    names = [f"t{i}" for i in range(len(ties))]
    rows = df.select(F.col(contributor).alias("g"), F.col(quality).alias("q"), *[F.col(c).alias(x) for c, x in zip(ties, names, strict=True)])
    if dict(rows.dtypes)["q"] in ("float", "double"):
        rows = rows.withColumn("q", F.when(~F.isnan("q"), F.col("q")))
    rows = materialise(rows, "caps-rows")
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    level = water_level(counts, max_count=max_count, max_share=max_share)
    order = [F.col("q").desc_nulls_last(), *[F.col(x).asc_nulls_last() for x in names]]
    kept = _rank_direct(rows, order, level) if level <= direct_level else _rank_ranged(rows, order, level, counts)
    return kept.select(F.col("g").alias(contributor), F.col("q").alias(quality), *[F.col(x).alias(c) for c, x in zip(ties, names, strict=True)], "rank", "capped", F.lit(level).alias("level"))
