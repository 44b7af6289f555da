"""Ranking and classification metrics of scored pairs.

Curves are built from one row per distinct score, so ties collapse and the running totals go over the
distinct scores only. Global orders are range-partitioned (see :mod:`skyweave.operators.ordering`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import grouped_quantile, running_totals
from skyweave.session import materialise


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``value`` with ``name``, one row per distinct value: the mean of the 1-based ranks of its rows."""
    per = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = running_totals(per, [F.col(value)], {"upto": F.col("n")})
    return upto.select(value, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ``n, rho``, the correlation of average ranks over rows in which both values are present."""
    both = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    ranked = both.join(average_ranks(both, "a", "ra"), "a").join(average_ranks(both, "b", "rb"), "b")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """``score, tp, fp, precision, recall, fpr``, one row per distinct score taken as the threshold."""
    per = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("int")).alias("pos"), F.sum(1 - F.col(label).cast("int")).alias("neg"))
    totals = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    run = running_totals(per, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    return run.crossJoin(F.broadcast(totals)).select(  # one row of totals
        "score", "tp", "fp", "pos", "neg",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.greatest("P", F.lit(1))).alias("recall"),
        (F.col("fp") / F.greatest("N", F.lit(1))).alias("fpr"),
    )


def binary_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: average precision, ROC area, best F1 with its threshold, and the two operating points.

    The steps of the curve need no neighbouring row: the recall before a threshold is recall minus its own positives.
    """
    c = pr_curve(df, score, label)
    sums = c.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    c = c.crossJoin(F.broadcast(sums))  # one row
    dr, df_ = F.col("pos") / F.greatest("positives", F.lit(1)), F.col("neg") / F.greatest("negatives", F.lit(1))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    best = F.max_by(F.struct("score", "precision", "recall"), F.struct(f1, F.col("score")))
    return c.agg(
        F.sum(dr * F.col("precision")).alias("average_precision"),
        F.sum(df_ * (2 * F.col("recall") - dr) / 2).alias("roc_auc"),
        F.max(f1).alias("best_f1"),
        best["score"].alias("best_f1_threshold"),
        best["precision"].alias("best_f1_precision"),
        best["recall"].alias("best_f1_recall"),
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.coalesce(F.max(F.when(F.col("recall") >= 0.9, F.col("precision"))), F.lit(0.0)).alias("precision_at_recall_090"),
        F.coalesce(F.max(F.when(F.col("precision") >= 0.98, F.col("recall"))), F.lit(0.0)).alias("recall_at_precision_098"),
    )


def row_metrics(df: DataFrame, group: str, item: str, score: str, label: str) -> DataFrame:
    """``group, positives, n, ap, r_precision``: per row of a score matrix, ties by smaller item.

    Rows of which none or all are positive are left out. Ranks and hits are running totals over the global order less those
    before the group, so a row with a third of all entries is ranked by many tasks.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(score).alias("score"), F.col(label).cast("int").alias("y"))
    run = running_totals(rows, [F.col("g").asc_nulls_first(), F.col("score").desc(), F.col("item")], {"k": F.lit(1).cast("long"), "tp": F.col("y").cast("long")})
    run = materialise(run, "row-metrics")
    sized = run.groupBy("g").agg(F.sum("y").alias("positives"), F.count(F.lit(1)).alias("n"), (F.min("k") - 1).alias("k0"), F.min(F.col("tp") - F.col("y")).alias("t0")).filter("positives > 0 and positives < n")
    ranked = lookup_join(run.withColumn("at", F.struct("g")), sized.select(F.struct("g").alias("at"), "positives", "n", "k0", "t0"), "at", "inner").withColumn("place", F.col("k") - F.col("k0"))
    found = ranked.groupBy("g").agg(
        F.max("positives").alias("positives"),
        F.max("n").alias("n"),
        F.avg(F.when(F.col("y") == 1, (F.col("tp") - F.col("t0")) / F.col("place"))).alias("ap"),
        (F.sum(F.when(F.col("place") <= F.col("positives"), F.col("y")).otherwise(0)) / F.max("positives")).alias("r_precision"),
    )
    return found.withColumnRenamed("g", group)


def cdf_area(df: DataFrame, error: str, top: float, points: int = 1000) -> DataFrame:
    """One row ``n, auc``: the mean of the error's distribution function at evenly spaced points from 0 to ``top``.

    Each error is counted once, with the number of points that it does not exceed.
    """
    step = top / (points - 1)
    first = F.greatest(F.lit(0), F.ceil(F.col(error) / F.lit(step) - F.lit(1e-9)))
    reached = F.greatest(F.lit(0), F.lit(points) - first)
    return df.agg(F.count(error).alias("n"), (F.sum(reached) / F.count(error) / F.lit(points)).alias("auc"))


def spread_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, mean, median, std, var, p90`` (population deviation and variance), however large a group is; NULL is a group too."""
    v = F.col(value)
    sums = df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"))
    side = lambda q, name: grouped_quantile(df, group, value, q, name).withColumnRenamed(group, f"__{name}")
    m, p = side(0.5, "median"), side(0.9, "p90")
    both = sums.join(m, sums[group].eqNullSafe(m["__median"]), "left").join(p, sums[group].eqNullSafe(p["__p90"]), "left")
    return both.select(group, "n", "mean", "median", "std", "var", "p90")
