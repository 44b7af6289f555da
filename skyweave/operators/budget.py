"""Track budgets per image: a greedy choice over all tracks, decided for many tracks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import running_totals
from skyweave.session import forget, materialise


def track_budget(obs: DataFrame, track: str, image: str, budget: int) -> DataFrame:
    """``track, image``: the observations of the tracks that are kept.

    Tracks are taken longest first, equal lengths by smaller id; a track is kept while any of its images is seen by
    fewer than ``budget`` tracks kept before it. The result is that of the one-by-one choice, but a round decides every
    track for which it no longer depends on undecided ones: kept if some image stays below the budget even with
    all undecided tracks before it, left out if the kept ones before it fill all of its images. The first
    undecided track is always decided. Counts run over range partitions, so no task holds a whole image.

    Rows without a track or an image are left out, repeated rows count once, empty input gives an empty result.
    """
    if budget < 1:
        raise ValueError("budget must be at least 1")
    rows = materialise(obs.select(F.col(track).alias("t"), F.col(image).alias("m")).filter("t is not null and m is not null").distinct(), "budget-rows")
    lengths = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    live = materialise(lookup_join(rows, lengths, "t", "inner").withColumn("kept", F.lit(False)), "budget")
    kept, open_ = F.col("kept").cast("long"), (~F.col("kept")).cast("long")
    while True:
        run = materialise(running_totals(live, [F.col("m"), F.col("n").desc(), F.col("t")], {"full": kept, "open": open_}), "budget-totals")
        first = run.groupBy("m").agg(F.min(F.col("full") - kept).alias("full0"), F.min(F.col("open") - open_).alias("open0"))
        placed = lookup_join(run.filter("not kept"), first, "m", "inner")
        before, maybe = F.col("full") - F.col("full0"), F.col("open") - F.col("open0") - 1
        judged = placed.groupBy("t").agg(F.max(before + maybe < budget).alias("safe"), F.min(before >= budget).alias("filled"))
        judged = materialise(judged.filter("safe or filled"), "budget-judged")
        if judged.isEmpty():
            return live.filter("kept").select(F.col("t").alias(track), F.col("m").alias(image))
        after = lookup_join(live, judged, "t", "left").filter("filled is null or not filled")
        after = materialise(after.select("t", "m", "n", (F.col("kept") | F.coalesce("safe", F.lit(False))).alias("kept")), "budget")
        forget(live)
        forget(run)
        live = after
