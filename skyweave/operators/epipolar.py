"""Relative poses of many image pairs from their matches, with wrong matches among them.

Hypotheses come from a bounded sample of a pair's matches and are judged there; the best few are counted over all of its matches, and
the winner is fitted again to all of its inliers, by sums that Spark adds up. So a pair may hold any number of matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.estimators import _batched
from skyweave.operators.keyed import lookup_join
from skyweave.session import materialise

_XY = ("x1", "y1", "x2", "y2")


def _rows(x: np.ndarray) -> np.ndarray:
    """The factors of the nine entries of E in x2' E x1 = 0."""
    a, b = np.column_stack([x[:, :2], np.ones(len(x))]), np.column_stack([x[:, 2:], np.ones(len(x))])
    return (b[:, :, None] * a[:, None, :]).reshape(-1, 9)


def _essential(e: np.ndarray) -> np.ndarray:
    """The nearest matrices with singular values 1, 1, 0."""
    u, _, vt = np.linalg.svd(e)
    return u @ (np.array([1.0, 1.0, 0.0])[:, None] * vt)


def _sampson(e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared first-order distances of every match (columns) from every matrix (rows)."""
    a, b = np.column_stack([x[:, :2], np.ones(len(x))]), np.column_stack([x[:, 2:], np.ones(len(x))])
    ea, eb = np.einsum("hij,nj->hni", e, a), np.einsum("hji,nj->hni", e, b)
    top = np.einsum("ni,hni->hn", b, ea) ** 2
    return top / np.maximum(ea[:, :, 0] ** 2 + ea[:, :, 1] ** 2 + eb[:, :, 0] ** 2 + eb[:, :, 1] ** 2, 1e-18)


def _hypotheses(threshold: float, tries: int, best: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        x = np.column_stack([np.asarray(table.column(c)) for c in _XY])
        found = np.zeros((0, 3, 3))
        if len(x) >= 8:
            rng = np.random.default_rng(seed)
            picks = np.argsort(rng.random((tries, len(x))), axis=1)[:, :8]
            a = _rows(x)[picks.ravel()].reshape(tries, 8, 9)
            e = _essential(np.linalg.svd(a, full_matrices=True)[2][:, 8].reshape(-1, 3, 3))
            score = (_sampson(e, x) <= threshold**2).sum(1)
            found = e[np.argsort(-score, kind="stable")[:best]]
        return pa.table({"pair": table.column("pair").slice(0, 1), "es": pa.array([found.reshape(-1).tolist()], pa.list_(pa.float64()))})

    return run


def _grouped(pair: pa.Array, values: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    codes = pair.dictionary_encode()
    total = np.zeros((len(codes.dictionary), values.shape[1]))
    np.add.at(total, np.asarray(codes.indices), values)
    return codes.dictionary, total


def _matrices(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _depth_signs(rt: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether both depths of a match are positive, for its four candidate poses (match, candidate)."""
    r, t = rt[:, :, :9].reshape(len(x), 4, 3, 3), rt[:, :, 9:]
    a, b = np.column_stack([x[:, :2], np.ones(len(x))]), np.column_stack([x[:, 2:], np.ones(len(x))])
    ra = np.einsum("ncij,nj->nci", r, a)
    # d2 b = d1 ra + t: least squares over the two depths
    aa, ab, bb = (ra**2).sum(2), np.einsum("nci,ni->nc", ra, b), (b**2).sum(1)[:, None]
    at, bt = (ra * t).sum(2), np.einsum("nci,ni->nc", t, b)
    det = np.maximum(aa * bb - ab**2, 1e-18)
    return ((ab * bt - bb * at) / det > 0) & ((aa * bt - ab * at) / det > 0)


def relative_poses(matches: DataFrame, pair: str, *, threshold: float, least: int = 15, tries: int = 200, best: int = 5, sample_rows: int = 400, seed: int = 3) -> DataFrame:
    """``pair, n, inliers, r, t``: rotation and direction of the shift from the first camera to the second, x2 ~ R x1 + t.

    ``matches`` has ``pair`` (a number or text) and normalised image coordinates ``x1, y1, x2, y2``; rows with a missing one are left out. ``threshold`` is the
    largest first-order distance of an inlier. Hypotheses of eight matches are drawn from at most ``sample_rows`` matches of a pair, the first
    by MD5; the ``best`` of ``tries`` are counted over all matches. Pairs with fewer than 8 matches or ``least`` inliers are absent.
    """
    rows = matches.select(F.col(pair).alias("pair"), *[F.col(c).cast("double").alias(c) for c in _XY])
    rows = materialise(rows.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in _XY)), "epipolar-rows")
    kind = dict(rows.dtypes)["pair"]
    w = Window.partitionBy("pair").orderBy(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in _XY])), *_XY)
    sample = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= sample_rows).drop("k")
    guesses = materialise(sample.groupBy("pair").applyInArrow(_hypotheses(threshold, tries, best, seed), f"pair {kind}, es array<double>").filter(F.size("es") == 9 * best), "epipolar-guesses")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.asarray(batch.column(c)) for c in _XY])
                e = _matrices(batch.column("es"), 9 * best).reshape(-1, best, 3, 3)
                good = np.column_stack([_each(e[:, k], x) <= threshold**2 for k in range(best)]).astype(float)
                keys, total = _grouped(batch.column("pair"), good)
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(total[:, k]) for k in range(best)]], ["pair", *[f"c{k}" for k in range(best)]])

    met = lookup_join(rows, guesses, "pair", "inner")
    counts = met.mapInArrow(count, f"pair {kind}, " + ", ".join(f"c{k} double" for k in range(best))).groupBy("pair").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(best)])
    top = F.greatest(*[F.struct(F.col(f"c{k}").alias("c"), F.lit(-k).alias("k")) for k in range(best)])
    chosen = counts.select("pair", top.alias("top")).join(guesses, "pair").select("pair", F.slice("es", -9 * F.col("top.k") + 1, 9).alias("es"))
    kept = materialise(_inliers(lookup_join(rows, materialise(chosen, "epipolar-chosen"), "pair", "inner"), kind, threshold), "epipolar-inliers")

    # the winner again from all of its inliers
    upper = [(i, j) for i in range(9) for j in range(i, 9)]
    one = F.lit(1.0)
    a, b = [F.col("x1"), F.col("y1"), one], [F.col("x2"), F.col("y2"), one]
    factor = [b[i] * a[j] for i in range(3) for j in range(3)]
    sums = kept.groupBy("pair").agg(F.count(F.lit(1)).cast("double").alias("inliers"), *[F.sum(factor[i] * factor[j]).alias(f"s{i}_{j}") for i, j in upper]).filter(F.col("inliers") >= max(least, 8))

    def solve(x: np.ndarray) -> np.ndarray:
        m = np.zeros((len(x), 9, 9))
        for k, (i, j) in enumerate(upper):
            m[:, i, j] = m[:, j, i] = x[:, 1 + k]
        e = np.linalg.eigh(m)[1][:, :, 0].reshape(-1, 3, 3)
        u, _, vt = np.linalg.svd(e)
        u *= np.where(np.linalg.det(u) < 0, -1.0, 1.0)[:, None, None]
        vt *= np.where(np.linalg.det(vt) < 0, -1.0, 1.0)[:, None, None]
        q = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
        turns, t = (u @ q @ vt, u @ q.T @ vt), u[:, :, 2]
        return np.column_stack([x[:, 0], *[np.column_stack([r.reshape(-1, 9), s * t]) for r in turns for s in (1, -1)]])

    names = [f"p{k}" for k in range(48)]
    poses = materialise(_batched(sums, ["pair"], ["inliers", *[f"s{i}_{j}" for i, j in upper]], ["inliers", *names], solve).select("pair", "inliers", F.array(*names).alias("es")), "epipolar-poses")

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.asarray(batch.column(c)) for c in _XY])
                keys, total = _grouped(batch.column("pair"), _depth_signs(_matrices(batch.column("es"), 48).reshape(-1, 4, 12), x).astype(float))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(total[:, k]) for k in range(4)]], ["pair", *[f"c{k}" for k in range(4)]])

    seen = lookup_join(kept, poses.select("pair", "es"), "pair", "inner").mapInArrow(ahead, f"pair {kind}, c0 double, c1 double, c2 double, c3 double").groupBy("pair").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)])
    front = F.greatest(*[F.struct(F.col(f"c{k}").alias("c"), F.lit(-k).alias("k")) for k in range(4)])
    pose = seen.select("pair", front.alias("f")).join(poses, "pair").select("pair", "inliers", F.slice("es", -12 * F.col("f.k") + 1, 9).alias("r"), F.slice("es", -12 * F.col("f.k") + 10, 3).alias("t"))
    n = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return pose.join(n, "pair").select(F.col("pair").alias(pair), "n", F.col("inliers").cast("long").alias("inliers"), "r", "t")


def _each(e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared first-order distance of every match from its own matrix."""
    a, b = np.column_stack([x[:, :2], np.ones(len(x))]), np.column_stack([x[:, 2:], np.ones(len(x))])
    ea, eb = np.einsum("nij,nj->ni", e, a), np.einsum("nji,nj->ni", e, b)
    return (b * ea).sum(1) ** 2 / np.maximum(ea[:, 0] ** 2 + ea[:, 1] ** 2 + eb[:, 0] ** 2 + eb[:, 1] ** 2, 1e-18)


def _inliers(rows: DataFrame, kind: str, threshold: float) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.asarray(batch.column(c)) for c in _XY])
                good = _each(_matrices(batch.column("es"), 9).reshape(-1, 3, 3), x) <= threshold**2
                yield batch.select(["pair", *_XY]).filter(pa.array(good))

    return rows.mapInArrow(keep, f"pair {kind}, x1 double, y1 double, x2 double, y2 double")
