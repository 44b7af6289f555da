"""Positions and running totals over a global order, without a window over one partition.

Rows are range-partitioned by the order, summed locally and written once. The sums of the partitions before it
(one row per partition) are then added to each partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.operators.keyed import lookup_join
from skyweave.session import materialise, shuffle_width


def _local_totals(names: Sequence[str], columns: Sequence[str]):
    """Running sums within one sorted partition, carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(len(columns) + k) for k in range(len(names))]
            totals = []
            for k, v in enumerate(values):
                total = np.cumsum(np.asarray(v)) + carried[k]
                carried[k] = total[-1]
                totals.append(pa.array(total))
            part = batch.column(len(columns) + len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *totals, *values, part], [*columns, *names, *[f"__v_{n}" for n in names], "__part"])

    return run


def _ranged_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Rows in range partitions of the order, written with ``__part`` and the running totals within it; ``__v_`` columns are what was summed."""
    names = list(totals)
    ranged = df.withColumns({f"__v_{n}": F.coalesce(e, F.lit(0)) for n, e in totals.items()})
    ranged = ranged.withColumns({f"__v_{n}": F.col(f"__v_{n}").cast("long") for n in names})
    ranged = ranged.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    fields = [*df.schema.fields, *[T.StructField(n, T.LongType()) for n in [*names, *[f"__v_{n}" for n in names]]], T.StructField("__part", T.IntegerType())]
    return materialise(ranged.mapInArrow(_local_totals(names, df.columns), T.StructType(fields)), "ordering")


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running totals in the given order, which must tell all rows apart.

    ``totals`` maps new column names to the whole numbers that are summed; a NULL adds nothing. Rows are shuffled once.
    """
    names = list(totals)
    summed = _ranged_totals(df, order, totals)
    sums = summed.groupBy("__part").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("__part", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names])
    out = summed.join(F.broadcast(offsets), "__part").withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in names})
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *names)


def with_index(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Rows numbered from 0 in a global order that tells all rows apart."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def six(c: Column) -> Column:
    """Rounded to 6 decimals so that both engines agree on quotients and sums."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def positions_in_group(df: DataFrame, group: str, order: Sequence[Column], name: str = "pos", size: str = "size") -> DataFrame:
    """Rows with their 0-based place in the group and the group's size, however large a group is.

    The global order (group, then ``order``) must tell all rows apart; a NULL group is a group of its own.
    """
    numbered = with_index(df, [F.col(group).asc_nulls_first(), *order], "__g")
    sizes = numbered.groupBy(group).agg(F.min("__g").alias("__first"), F.count(F.lit(1)).alias(size))
    key = F.struct(F.col(group))
    placed = lookup_join(numbered.withColumn("__k", key), sizes.select(key.alias("__k"), "__first", size), "__k", "inner")
    return placed.withColumn(name, F.col("__g") - F.col("__first")).drop("__k", "__g", "__first")


def grouped_quantile(df: DataFrame, group: str, value: str, q: float, name: str = "q") -> DataFrame:
    """The exact quantile (linear between ranks) of every group; missing values do not count.

    Values are counted first, so equal ones travel once, and ordered across partitions: no task holds a whole group. A group's ranks are
    looked for in the totals of its partitions; then only the parts that hold them are read again, each no larger than a partition.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    per = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    run = _ranged_totals(per, [F.col("g").asc_nulls_first(), F.col("v")], {"upto": F.col("n")})
    own = Window.partitionBy("g")  # as many rows as the group has partitions
    parts = run.groupBy("g", "__part").agg(F.sum("n").alias("held"), F.min(F.col("upto") - F.col("n")).alias("start"))
    parts = parts.withColumns({"size": F.sum("held").over(own), "after": F.sum("held").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))})
    at = (F.col("size") - 1) * F.lit(float(q))
    low_rank, high_rank = F.floor(at) + 1, F.ceil(at) + 1
    holds = lambda rank, high, n: (rank > high - n) & (rank <= high)
    before = (F.col("after") - F.col("held") - F.col("start")).alias("before")
    named = parts.filter(holds(low_rank, F.col("after"), F.col("held")) | holds(high_rank, F.col("after"), F.col("held"))).select(F.struct("g", "__part").alias("k"), "size", before)
    both = run.select("g", "v", "n", "upto", F.struct("g", "__part").alias("k")).join(named, "k")
    low, high = (holds(rank, F.col("upto") + F.col("before"), F.col("n")) for rank in (low_rank, high_rank))
    ends = both.filter(low | high).groupBy("g").agg(
        F.min(F.when(low, F.col("v"))).alias("a"), F.max(F.when(high, F.col("v"))).alias("b"), F.max(at - F.floor(at)).alias("part")
    )
    return ends.select(F.col("g").alias(group), (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(name))
