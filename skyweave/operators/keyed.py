"""Row selection and joins on keys that may be badly skewed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skyweave.session import materialise


def present(c: Column) -> Column:
    """Neither NULL nor NaN (for float columns)."""
    return c.isNotNull() & ~F.isnan(c)


def latest(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the latest ``at`` of every key.

    A row without a timestamp is older than any other. Rows of equal key and time are told apart by
    ``ties`` (greatest value first, NULL last), so the choice is the same in every run. Rows of which a
    key column is NULL form a key of their own. Spark cuts every map partition to one row per key before
    the shuffle, so a hot key costs one row per partition.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties])
    return df.withColumn("__latest", F.row_number().over(w)).filter(F.col("__latest") == 1).drop("__latest")


#: At most this many keys are treated as heavy: each holds more than 1/HEAVY_KEYS of the rows.
HEAVY_KEYS = 20_000
#: A key with fewer rows than this is never heavy.
HEAVY_ROWS = 100_000


@dataclass(frozen=True)
class Heavy:
    """The keys with many rows, written (None: there are none), and whether they have all the rows."""

    keys: DataFrame | None = None
    all: bool = False


def heavy_keys(left: DataFrame, key: str, rows: int | None = None) -> Heavy:
    """The keys with more than 1/HEAVY_KEYS of the rows, at most HEAVY_KEYS by counting. They bound the keys of any part of the rows as well."""
    rows = left.count() if rows is None else rows
    least = max(HEAVY_ROWS, rows // HEAVY_KEYS)
    if rows <= least:
        return Heavy()
    seen, large = Observation(), F.col("__n") > least
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).observe(seen, F.sum("__n").alias("rows"), F.coalesce(F.sum(F.when(large, F.col("__n"))), F.lit(0)).alias("heavy"))
    keys = materialise(sizes.filter(large).select(key, F.lit(True).alias("__heavy")), "heavy-keys")
    return Heavy(keys, seen.get["heavy"] == seen.get["rows"]) if seen.get["heavy"] else Heavy()


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int | None = None, heavy: Heavy | None = None) -> DataFrame:
    """Join ``left`` (many rows per key, possibly a third of all on one) with ``right`` (one row per key).

    Keys with more than 1/HEAVY_KEYS of the left rows are, by counting, at most HEAVY_KEYS; only their
    right rows are broadcast. All other keys are joined by a shuffle in which no key is large.
    ``rows`` is the number of left rows if known; else it is counted. Heavy keys are written once: the plan names ``left`` twice
    where some keys are heavy, else once, so that lookups on lookups stay small plans. ``heavy`` has them where they are known, from ``left`` or
    from rows that it is a part of.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    heavy = heavy_keys(left, key, rows) if heavy is None else heavy
    if heavy.keys is None:
        return left.join(right, key, how)
    heavy_right = right.join(F.broadcast(heavy.keys.select(key)), key, "left_semi")
    if heavy.all:
        return left.join(F.broadcast(heavy_right), key, how)
    marked = left.join(F.broadcast(heavy.keys), key, "left")
    many = marked.filter("__heavy").drop("__heavy")
    light = marked.filter("__heavy is null").drop("__heavy")
    return many.join(F.broadcast(heavy_right), key, how).unionByName(light.join(right, key, how))
