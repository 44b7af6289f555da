"""Similarities between frames from cameras that are known in both, and the merge of many frames into one.

All fits of a call run together, one group per link or cluster; a group contributes sums and quantiles, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skyweave.functions.pose import add, angle_between_deg, apply_similarity, compose_similarity, multiply, rotate, similarity, times, transpose
from skyweave.operators.covis import shared_counts
from skyweave.operators.estimators import ROTATION, mean_rotation, similarity_fit
from skyweave.operators.graph import both_ways, place_by_rank, rooted, spanning_forest
from skyweave.operators.keyed import heavy_keys, lookup_join
from skyweave.operators.ordering import grouped_quantile
from skyweave.session import forget, materialise, materialise_counted


def _distance(a: Column, b: Column) -> Column:
    d = [F.get(a, F.lit(k)) - F.get(b, F.lit(k)) for k in range(3)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _medians(link: str, *parts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """``link`` and the median of every value of every part, which are groups of one quantile; NULL for a value that a link has nowhere."""
    names = [name for _, values in parts for name in values]
    long = None
    for rows, values in parts:
        each = F.explode(F.array(*[F.struct(F.lit(names.index(name)).alias("which"), v.alias("v")) for name, v in values.items()]))
        some = rows.select(F.col(link).alias("link"), each.alias("a")).select(F.struct("link", "a.which").alias("g"), F.col("a.v").alias("v"))
        long = some if long is None else long.unionByName(some)
    q = grouped_quantile(long, "g", "v", 0.5, "v")
    return q.groupBy(F.col("g.link").alias(link)).agg(*[F.max(F.when(F.col("g.which") == k, F.col("v"))).alias(name) for k, name in enumerate(names)])


def fit_from_cameras(cameras: DataFrame, link: str, ratios: DataFrame | None = None, max_deg: float = 5.0, max_off: float | None = None) -> DataFrame:
    """``link, n, inliers, m, rotation_deg, off, spread``: the similarity that takes frame ``src`` to frame ``dst`` for every link.

    ``cameras`` has ``link`` and of every camera known in both frames ``rd, cd`` and ``rs, cs``: world-to-camera rotation and centre in
    dst and src. ``ratios`` has ``link, v``: logarithms of depth in dst over depth in src at common pixels.

    Rotation: chordal mean of Rd^T Rs. Scale: exp of the median ratio; without ratios, that of the centres' similarity (1 for fewer than 3
    cameras). Shift: median of cd - s R cs. Cameras off by more than ``max_deg``, or by more than ``max_off`` (default: three times the median
    distance), are left out of a second fit, unless all would be. ``rotation_deg`` and ``off`` are medians, ``spread`` that of the ratios.
    """
    rows, count = materialise_counted(cameras.select(F.col(link).alias("l"), "cd", "cs", multiply(transpose(F.col("rd")), F.col("rs")).alias("turn")).filter("l is not null"), "frames-cameras")
    heavy = heavy_keys(rows, "l", count)
    met = lambda some, right: lookup_join(some, right, "l", "inner", heavy=heavy)
    if ratios is not None:
        r, count = materialise_counted(ratios.select(F.col(link).alias("l"), "v"), "frames-ratios")
        middle = materialise(grouped_quantile(r, "l", "v", 0.5, "v50"), "frames-scale")
        scale = middle.select("l", F.exp("v50").alias("s"), F.lit(None).cast("double").alias("spread"))
        beside = (lookup_join(r, middle, "l", "inner", count), {"spread": F.abs(F.col("v") - F.col("v50"))})
    kept = rows
    for last in (False, True):
        turn = mean_rotation(kept, "l", "turn").select("l", F.array(*ROTATION).alias("R"))
        if ratios is None:
            flat = kept.select("l", *[F.get("cs", F.lit(k)).alias(f"a{k}") for k in range(3)], *[F.get("cd", F.lit(k)).alias(f"b{k}") for k in range(3)])
            fit = similarity_fit(flat, "l", ["a0", "a1", "a2"], ["b0", "b1", "b2"])
            scale = fit.select("l", F.when(F.isnan("s") | (F.col("n") < 3), F.lit(1.0)).otherwise(F.col("s")).alias("s"), F.lit(None).cast("double").alias("spread"))
        first = materialise(turn.join(scale, "l", "left").select("l", "R", F.coalesce("s", F.lit(1.0)).alias("s"), "spread"), "frames-turn")
        near = met(kept, first.drop("spread")).withColumn("moved", times(rotate(F.col("R"), F.col("cs")), F.col("s")))
        axes = {f"t{k}": F.get("cd", F.lit(k)) - F.get("moved", F.lit(k)) for k in range(3)}
        # the ratios' spread is found along with the first shift
        told = ratios is not None and not last
        shift = _medians("l", (near, axes), *([beside] if told else [])).filter(" or ".join(f"{t} is not null" for t in axes))
        fitted = (first.drop("spread") if told else first).join(shift, "l").select("l", similarity(F.col("s"), F.col("R"), F.array(*axes)).alias("m"), "spread")
        fitted = materialise(fitted, "frames-fit")
        if told:
            scale = fitted.select("l", "m.s", "spread")
            forget(r)
        judged = met(rows, fitted.drop("spread")).select(*(["l"] if last else rows.columns), angle_between_deg(F.col("turn"), F.col("m.r")).alias("deg"), _distance(apply_similarity(F.col("m"), F.col("cs")), F.col("cd")).alias("far"))
        judged = materialise(judged, "frames-judged")
        if last:
            forget(rows)
            forget(kept)
        middles = {"off": F.col("far")} | ({"rotation_deg": F.col("deg")} if last else {})
        median = materialise(_medians("l", (judged, middles)).filter(" and ".join(f"{c} is not null" for c in middles)), "frames-off")
        limit = F.lit(max_off) if max_off is not None else 3 * F.greatest("off", F.lit(1e-9))
        good = (F.col("deg") <= max_deg) & (F.col("far") <= limit)
        some = met(judged, median).groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("inliers"), *[F.first(c).alias(c) for c in middles])
        if not last:
            some = materialise(some.select("l", "off", (F.col("inliers") == 0).alias("none")), "frames-some")
            kept = materialise(met(judged, some).filter(good | F.col("none")).select(*rows.columns), "frames-kept")
            forget(judged)
    out = fitted.join(some, "l")
    return out.select(F.col("l").alias(link), "n", "inliers", "m", "rotation_deg", "off", "spread")


def fit_gps_gimbal(cameras: DataFrame, group: str, keep: float = 0.8, rounds: int = 5) -> DataFrame:
    """``group, n, m``: the similarity into the world of positions, with its rotation from the gimbals alone.

    ``cameras`` has ``group``, ``r, c`` (rotation and centre in the group's frame), ``g`` (measured position) and ``rg`` (world-to-camera
    rotation by the gimbal). The rotation is the chordal mean of rg^T r; scale and shift are then fitted to the positions with it fixed. Both are
    fitted again to the ``keep`` share with the smallest residuals, ``rounds`` times.
    """
    rows = materialise(cameras.select(F.col(group).alias("l"), "c", "g", multiply(transpose(F.col("rg")), F.col("r")).alias("turn")), "gimbal-rows")
    kept = rows
    for _ in range(rounds):
        turn = materialise(mean_rotation(kept, "l", "turn").select("l", F.array(*ROTATION).alias("R")), "gimbal-turn")
        judged = materialise(lookup_join(rows, turn, "l", "inner").withColumn("e", angle_between_deg(F.col("turn"), F.col("R"))), "gimbal-judged")
        cut = grouped_quantile(judged, "l", "e", keep, "cut")
        kept = materialise(lookup_join(judged, cut, "l", "inner").filter(F.col("e") <= F.col("cut")).drop("e", "cut", "R"), "gimbal-kept")
    turned = materialise(lookup_join(rows, turn, "l", "inner").select("l", "R", rotate(F.col("R"), F.col("c")).alias("p"), "g"), "gimbal-turned")
    kept = turned
    for _ in range(rounds):
        flat = kept.select("l", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(3)], *[F.get("g", F.lit(k)).alias(f"g{k}") for k in range(3)])
        mean = materialise(flat.groupBy("l").agg(*[F.avg(f"{c}{k}").alias(f"m{c}{k}") for c in "pg" for k in range(3)]), "gimbal-means")
        near = lookup_join(flat, mean, "l", "inner")
        d = lambda c, k: F.col(f"{c}{k}") - F.col(f"m{c}{k}")
        sums = near.groupBy("l").agg(F.sum(sum((d("p", k) * d("g", k) for k in range(3)), F.lit(0.0))).alias("pg"), F.sum(sum((d("p", k) * d("p", k) for k in range(3)), F.lit(0.0))).alias("pp"))
        s = F.col("pg") / F.greatest("pp", F.lit(1e-12))
        fit = materialise(sums.join(mean, "l").select("l", s.alias("s"), F.array(*[F.col(f"mg{k}") - s * F.col(f"mp{k}") for k in range(3)]).alias("t")), "gimbal-fit")
        judged = materialise(lookup_join(turned, fit, "l", "inner").withColumn("e", _distance(add(times(F.col("p"), F.col("s")), F.col("t")), F.col("g"))), "gimbal-judged")
        cut = grouped_quantile(judged, "l", "e", keep, "cut")
        kept = materialise(lookup_join(judged, cut, "l", "inner").filter(F.col("e") <= F.col("cut")).select("l", "R", "p", "g"), "gimbal-kept")
    n = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    return fit.join(turn, "l").join(n, "l").select(F.col("l").alias(group), "n", similarity(F.col("s"), F.col("R"), F.col("t")).alias("m"))


def merge_frames(members: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """``cluster, m, depth``: the similarity of every cluster into the frame of the largest one, along the tree of the largest overlaps.

    ``members`` has ``cluster, image, r, c`` (rotation and centre in the cluster's frame) with one row per cluster and image; ``ratios`` has
    ``cluster, image, pixel, depth``. Clusters are joined by the maximum spanning tree of their common images, equal ones by smaller ids; each
    link is fitted from its common cameras, and the fits are composed down the tree, in as many rounds as the depth has binary digits. Clusters out
    of reach are absent. The root, depth 0, has most images, then the smallest id.
    """
    m = materialise(members.select(F.col("cluster").cast("long").alias("cluster"), "image", "r", "c"), "merge-members")
    overlap = shared_counts(m, "image", "cluster")
    tree = materialise(both_ways(spanning_forest(overlap, "shared"), "i", "j"), "merge-tree")
    link = F.struct(F.col("src").alias("p"), F.col("dst").alias("q"))
    side = lambda name, r, c: m.select(F.col("cluster").alias(name), "image", F.col("r").alias(r), F.col("c").alias(c))
    both = tree.join(side("src", "rd", "cd"), "src").join(side("dst", "rs", "cs"), ["dst", "image"]).select(link.alias("link"), "rd", "cd", "rs", "cs")
    logs = None
    if ratios is not None:
        d = ratios.select(F.col("cluster").cast("long").alias("cluster"), "image", "pixel", "depth").filter("depth > 0")
        met = tree.join(d.withColumnsRenamed({"cluster": "src", "depth": "dd"}), "src").join(d.withColumnsRenamed({"cluster": "dst", "depth": "ds"}), ["dst", "image", "pixel"])
        logs = met.select(link.alias("link"), F.log(F.col("dd") / F.col("ds")).alias("v"))
    fits = materialise(fit_from_cameras(both, "link", logs).select(F.col("link.p").alias("src"), F.col("link.q").alias("dst"), F.col("m").alias("fit")), "merge-fits")
    same = similarity(F.lit(1.0), F.array(*[F.lit(float(k in (0, 4, 8))) for k in range(9)]), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    root = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(1)
    root = materialise(root.select("cluster"), "merge-root")
    first = root.first()  # one row
    parents = materialise(rooted(tree, first and first.cluster), "merge-parents")
    down = parents.select(F.col("parent").alias("src"), F.col("node").alias("dst")).join(fits, ["src", "dst"])
    # up: the cluster above whose frame m leads to, ``depth`` links up; NULL for the root
    whole = root.select("cluster", F.lit(None).cast("long").alias("up"), same.alias("m"), F.lit(0).alias("depth"))
    state, going = materialise_counted(whole.unionByName(down.select(F.col("dst").alias("cluster"), F.col("src").alias("up"), F.col("fit").alias("m"), F.lit(1).alias("depth"))), "merge")
    while going:
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("m").alias("above"), F.col("depth").alias("more"))
        moved = lookup_join(state.filter("up is not null"), above, "up", "inner", going)
        moved = moved.select("cluster", F.col("next").alias("up"), compose_similarity(F.col("above"), F.col("m")).alias("m"), (F.col("depth") + F.col("more")).alias("depth"))
        seen = Observation()
        after = materialise(state.filter("up is null").unionByName(moved).observe(seen, F.count_if(F.col("up").isNotNull()).alias("going")), "merge")
        forget(state)
        state, going = after, seen.get["going"]
    return state.select("cluster", "m", "depth")


def place_images(members: DataFrame, merged: DataFrame) -> DataFrame:
    """``image, cluster, c``: every image's centre in the common frame, from the cluster nearest to the root (then the smallest id) that holds it."""
    rows = lookup_join(members.select(F.col("cluster").cast("long").alias("cluster"), "image", "c"), merged, "cluster", "inner")
    return place_by_rank(rows, "image", ["depth", "cluster"]).select("image", "cluster", apply_similarity(F.col("m"), F.col("c")).alias("c"))


def merge_by_positions(members: DataFrame, positions: DataFrame, least_spread: float = 0.1, rounds: int = 5) -> DataFrame:
    """``cluster, n, collinear, m``: the similarity of every cluster straight into the frame of measured positions, without a chain of links.

    ``members`` as in :func:`merge_frames`; ``positions`` has ``image, g`` and, if known, ``rg`` (rotation by the gimbal). A cluster whose
    positions lie nearly on a line (second singular value below ``least_spread`` of the first) takes its rotation from the gimbals;
    without gimbals it has no ``m`` and is left to a neighbour. Other clusters take the trimmed least-squares similarity. Fewer than 3 images give no row.
    """
    from skyweave.operators.estimators import robust_similarity_fit

    rows = members.select(F.col("cluster").cast("long").alias("cluster"), "image", "r", "c").join(positions, "image")
    rows = materialise(rows, "positions-members")
    flat = rows.select("cluster", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(3)], *[F.get("g", F.lit(k)).alias(f"g{k}") for k in range(3)])
    spread = _spread(flat, "cluster", ["g0", "g1", "g2"])
    fits = robust_similarity_fit(flat, "cluster", ["c0", "c1", "c2"], ["g0", "g1", "g2"], rounds=rounds)
    free = fits.select("cluster", similarity(F.col("s"), F.array(*ROTATION), F.array("t0", "t1", "t2")).alias("free"))
    out = spread.withColumn("collinear", F.col("second") < least_spread * F.col("first")).join(free, "cluster", "left").filter("n >= 3")
    if "rg" in positions.columns:
        turned = fit_gps_gimbal(rows.filter("rg is not null"), "cluster", rounds=rounds).select("cluster", F.col("m").alias("turned"))
        out = out.join(turned, "cluster", "left")
    else:
        out = out.withColumn("turned", F.lit(None).cast(free.schema["free"].dataType))
    return out.select("cluster", "n", "collinear", F.when(F.col("collinear"), F.col("turned")).otherwise(F.col("free")).alias("m"))


def _spread(flat: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``group, n, first, second``: the two largest singular values of the centred positions of a group, from its moments."""
    import numpy as np

    from skyweave.operators.estimators import _batched

    mean = materialise(flat.groupBy(group).agg(*[F.avg(c).alias(f"m_{c}") for c in columns]), "spread-means")
    near = lookup_join(flat, mean, group, "inner")
    d = [F.col(c) - F.col(f"m_{c}") for c in columns]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = near.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(d[i] * d[j]).alias(f"s{i}{j}") for i, j in pairs])

    def solve(x: np.ndarray) -> np.ndarray:
        m = np.zeros((len(x), 3, 3))
        for k, (i, j) in enumerate(pairs):
            m[:, i, j] = m[:, j, i] = x[:, 1 + k]
        v = np.sqrt(np.maximum(np.linalg.eigvalsh(np.nan_to_num(m)), 0))
        return np.column_stack([x[:, 0], v[:, 2], v[:, 1]])

    return _batched(sums, [group], ["n", *[f"s{i}{j}" for i, j in pairs]], ["n", "first", "second"], solve)
