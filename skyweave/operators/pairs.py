"""Pair measurements: accumulation, selection of edges, set operations on pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.covis import shared_counts
from skyweave.operators.keyed import present
from skyweave.session import materialise


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``i`` < ``j``; rows of an image with itself or without an image are left out."""
    return df.filter((F.col(a) != F.col(b))).withColumns({"i": F.least(a, b), "j": F.greatest(a, b)})


def accumulate(pairs: DataFrame, value: str) -> DataFrame:
    """``i, j, total, n, mean, top``: all measurements of a pair; missing ones do not count."""
    v = F.col(value).cast("double")
    return (
        pairs.filter(present(F.col(value)))
        .groupBy("i", "j")
        .agg(F.sum(v).alias("total"), F.count(v).alias("n"), F.max(v).alias("top"))
        .withColumn("mean", F.col("total") / F.col("n"))
    )


def merge_accumulated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two partial accumulators as one; this is what a stream or a later batch adds."""
    both = a.select("i", "j", "total", "n", "top").unionByName(b.select("i", "j", "total", "n", "top"))
    merged = both.groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top"))
    return merged.withColumn("mean", F.col("total") / F.col("n"))


def symmetric_min(directed: DataFrame, src: str, dst: str, value: str) -> DataFrame:
    """``i, j, score``: the smaller of both directions; 0 if only one is known. One row per direction is expected."""
    p = unordered(directed.filter(present(F.col(value))), src, dst)
    both = F.count(F.lit(1)) == 2
    return p.groupBy("i", "j").agg(F.when(both, F.min(value)).otherwise(F.lit(0)).alias("score"))


def top_k(directed: DataFrame, src: str, dst: str, score: str, k: int) -> DataFrame:
    """``src, dst, score, rank``: the k best targets of every source; itself and missing scores left out.

    Equal scores go by smaller target. Spark cuts each partition to k rows per source before the shuffle.
    """
    usable = directed.filter(present(F.col(score)) & (F.col(src) != F.col(dst)))
    w = Window.partitionBy(src).orderBy(F.col(score).desc(), F.col(dst))
    return usable.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(score).alias("score"), "rank")


def union_graph(picks: DataFrame) -> DataFrame:
    """``i, j``: edges chosen from either side."""
    return unordered(picks, "src", "dst").select("i", "j").distinct()


def mutual_graph(picks: DataFrame) -> DataFrame:
    """``i, j``: edges chosen from both sides."""
    return unordered(picks.select("src", "dst").distinct(), "src", "dst").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("i", "j")


def matching_edges(scores: DataFrame, bridges: DataFrame, k: int = 20, least: float = 0.05) -> DataFrame:
    """``i, j``: pairs among an image's top k with at least ``least``, and all bridges whatever their score.

    ``scores`` has ``i, j, score``; both directions are ranked.
    """
    directed = scores.select(F.col("i").alias("src"), F.col("j").alias("dst"), "score").unionByName(scores.select(F.col("j").alias("src"), F.col("i").alias("dst"), "score"))
    picked = top_k(directed, "src", "dst", "score", k).filter(F.col("score") >= least)
    return union_graph(picked).unionByName(bridges.select("i", "j")).distinct()


def row_lift(directed: DataFrame, src: str, dst: str, value: str) -> DataFrame:
    """``src, dst, share, lift``: value over its row's sum without the diagonal, and times the row's other entries."""
    rows = directed.filter(present(F.col(value)) & (F.col(src) != F.col(dst)))
    sums = rows.groupBy(src).agg(F.sum(F.col(value).cast("double")).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    share = F.col(value).cast("double") / F.greatest("__sum", F.lit(1e-12))
    return rows.join(sums, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), share.alias("share"), (share * F.col("__n")).alias("lift"))


def outside(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate pairs that are not known yet."""
    return candidates.join(known.select("i", "j"), ["i", "j"], "left_anti")


def members_together(members: DataFrame, group: str, member: str) -> DataFrame:
    """``i, j, groups``: in how many groups two members meet. Very large groups are cut into blocks (see :func:`shared_counts`)."""
    return shared_counts(members, group, member).withColumnRenamed("shared", "groups")


def met_among(pairs: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """Those of the pairs ``i, j`` that meet in some group: the pairs are looked up in the groups, not all pairs of a group listed."""
    m = materialise(members.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g is not null and m is not null").distinct(), "members")
    asked = pairs.select("i", "j").distinct()
    first = asked.join(m.select(F.col("m").alias("i"), "g"), "i")
    return first.join(m.select(F.col("m").alias("j"), "g"), ["j", "g"], "left_semi").select("i", "j").distinct()


def conflicting(measured: Column, predicted: Column) -> Column:
    """Measured and predicted overlap contradict each other."""
    return ((measured >= 0.2) & (predicted < 0.05)) | ((measured < 0.05) & (predicted >= 0.3))
