"""Bundle adjustment by alternating robust Gauss-Newton steps of points, poses and shared intrinsics.

With poses fixed, points are independent 3 x 3 systems; with points fixed, poses are independent 6 x 6 systems. Every observation adds
its part to one system; parts are summed per Arrow batch, then by Spark, and the systems of many points or cameras
are solved at once. Memory is linear in the observations, no task holds a camera or a track whole. Steps carry a
damping term, and observations behind the camera have no weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.operators.estimators import _batched
from skyweave.operators.keyed import lookup_join
from skyweave.operators.matching import filter_tracks, residuals
from skyweave.session import forget, materialise


@dataclass(frozen=True)
class Lens:
    f: float
    cx: float
    cy: float


def _stack(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten()).reshape(-1, width)


def _linearise(batch: pa.RecordBatch, lens: Lens, huber: float):
    """Residuals, camera coordinates, Jacobian by camera coordinates, and weights of a batch of observations."""
    r, t, x = _stack(batch, "r", 9).reshape(-1, 3, 3), _stack(batch, "t", 3), _stack(batch, "x", 3)
    uv = np.column_stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("u", "v")])
    c = np.einsum("nij,nj->ni", r, x) + t
    z = np.where(c[:, 2] > 1e-9, c[:, 2], np.nan)
    e = np.column_stack([lens.f * c[:, 0] / z + lens.cx, lens.f * c[:, 1] / z + lens.cy]) - uv
    size = np.sqrt((e**2).sum(1))
    ok = np.isfinite(size)
    w = np.where(ok, np.where(size > huber, huber / np.maximum(size, 1e-12), 1.0), 0.0)
    jc = np.zeros((len(e), 2, 3))
    jc[:, 0, 0] = jc[:, 1, 1] = lens.f / z
    jc[:, 0, 2], jc[:, 1, 2] = -lens.f * c[:, 0] / z**2, -lens.f * c[:, 1] / z**2
    e, jc, c = np.where(ok[:, None], e, 0), np.where(ok[:, None, None], jc, 0), np.where(ok[:, None], c, 0)
    cost = np.where(ok, np.where(size > huber, 2 * huber * size - huber**2, size**2), 0.0)
    return e, c, r, jc, w, cost, ok


def _summed(key: str, kind: str, lens: Lens, huber: float, n: int, jacobian):
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    names = [f"h{i}_{j}" for i, j in upper] + [f"g{i}" for i in range(n)] + ["cost", "good"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            e, c, r, jc, w, cost, ok = _linearise(batch, lens, huber)
            jac = jacobian(c, r, jc)
            hess = np.einsum("n,nki,nkj->nij", w, jac, jac)
            grad = np.einsum("n,nki,nk->ni", w, jac, e)
            rows = np.column_stack([*[hess[:, i, j] for i, j in upper], grad, cost, ok])
            codes = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
            total = np.zeros((len(codes.dictionary), rows.shape[1]))
            np.add.at(total, np.asarray(codes.indices), rows)
            yield pa.RecordBatch.from_arrays([codes.dictionary, *[pa.array(total[:, k]) for k in range(total.shape[1])]], [key, *names])

    return run, f"`{key}` {kind}, " + ", ".join(f"{x} double" for x in names), names


def _normal(x: np.ndarray, n: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    h = np.zeros((len(x), n, n))
    k = 0
    for i in range(n):
        for j in range(i, n):
            h[:, i, j] = h[:, j, i] = x[:, k]
            k += 1
    d = np.arange(n)
    h[:, d, d] += damping * h[:, d, d] + 1e-9
    return h, x[:, k : k + n]


def _steps(rows: DataFrame, key: str, lens: Lens, huber: float, n: int, jacobian, damping: float) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    run, schema, names = _summed(key, kind, lens, huber, n, jacobian)
    sums = rows.select(key, "u", "v", "r", "t", "x").mapInArrow(run, schema).groupBy(key).agg(*[F.sum(c).alias(c) for c in names])

    def solve(x: np.ndarray) -> np.ndarray:
        h, g = _normal(x, n, damping)
        step = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        enough = 2 * x[:, -1] >= n
        return np.column_stack([np.where(enough[:, None], step, 0.0), x[:, -2], x[:, -1]])

    return _batched(sums, [key], names, [*[f"d{k}" for k in range(n)], "cost", "good"], solve)


def joined(obs: DataFrame, cameras: DataFrame, points: DataFrame) -> DataFrame:
    """``image, track, u, v, r, t, x``: observations with their camera and point."""
    with_camera = lookup_join(obs.select("image", "track", "u", "v"), cameras.select("image", "r", "t"), "image", "inner")
    return lookup_join(with_camera, points.select("track", "x"), "track", "inner")


def refine_points(obs: DataFrame, cameras: DataFrame, points: DataFrame, lens: Lens, huber: float = 4.0, damping: float = 1e-3) -> DataFrame:
    """``track, x`` after one step; points with fewer than two usable observations stay."""
    steps = _steps(joined(obs, cameras, points), "track", lens, huber, 3, lambda c, r, jc: np.einsum("nki,nij->nkj", jc, r), damping)
    both = points.join(steps.withColumn("d", F.array("d0", "d1", "d2")).select("track", "d"), "track", "left")
    return both.select("track", F.when(F.col("d").isNull(), F.col("x")).otherwise(F.zip_with("x", "d", lambda a, b: a + b)).alias("x"))


def _turned(d: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    w, tau = d[:, :3], d[:, 3:]
    th = np.sqrt((w**2).sum(1))[:, None, None]
    k = np.zeros((len(w), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 0], k[:, 1, 2], k[:, 2, 0], k[:, 2, 1] = -w[:, 2], w[:, 1], w[:, 2], -w[:, 0], -w[:, 1], w[:, 0]
    s = np.where(th > 1e-8, np.sin(th) / np.maximum(th, 1e-12), 1.0)
    q = np.where(th > 1e-8, (1 - np.cos(th)) / np.maximum(th, 1e-12) ** 2, 0.5)
    e = np.eye(3) + s * k + q * k @ k
    return np.column_stack([(e @ r.reshape(-1, 3, 3)).reshape(-1, 9), np.einsum("nij,nj->ni", e, t) + tau])


def refine_poses(obs: DataFrame, cameras: DataFrame, points: DataFrame, lens: Lens, huber: float = 4.0, damping: float = 1e-3) -> DataFrame:
    """``image, r, t`` after one step; cameras with fewer than three usable observations stay."""

    def jacobian(c: np.ndarray, r: np.ndarray, jc: np.ndarray) -> np.ndarray:
        cross = np.zeros((len(c), 3, 3))  # d(w x c) / dw = -[c]x
        cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 0] = c[:, 2], -c[:, 1], -c[:, 2]
        cross[:, 1, 2], cross[:, 2, 0], cross[:, 2, 1] = c[:, 0], c[:, 1], -c[:, 0]
        return np.concatenate([np.einsum("nki,nij->nkj", jc, cross), jc], axis=2)

    steps = _steps(joined(obs, cameras, points), "image", lens, huber, 6, jacobian, damping)
    both = cameras.select("image", "r", "t").join(steps, "image", "left")
    flat = both.select("image", *[F.get("r", F.lit(k)).alias(f"r{k}") for k in range(9)], *[F.get("t", F.lit(k)).alias(f"t{k}") for k in range(3)], *[F.coalesce(f"d{k}", F.lit(0.0)).alias(f"d{k}") for k in range(6)])
    inputs = [*[f"r{k}" for k in range(9)], *[f"t{k}" for k in range(3)], *[f"d{k}" for k in range(6)]]
    new = _batched(flat, ["image"], inputs, inputs[:12], lambda x: _turned(x[:, 12:], x[:, :9], x[:, 9:12]))
    return new.select("image", F.array(*inputs[:9]).alias("r"), F.array(*inputs[9:12]).alias("t"))


def refine_lens(obs: DataFrame, cameras: DataFrame, points: DataFrame, lens: Lens, huber: float = 4.0) -> tuple[Lens, float, float]:
    """Shared focal length and centre after one step, the robust cost before it, and the usable observations. One row of sums comes to the driver."""

    def jacobian(c: np.ndarray, r: np.ndarray, jc: np.ndarray) -> np.ndarray:
        out = np.zeros((len(c), 2, 3))
        z = np.where(c[:, 2] > 1e-9, c[:, 2], np.inf)
        out[:, 0, 0], out[:, 1, 0] = c[:, 0] / z, c[:, 1] / z
        out[:, 0, 1] = out[:, 1, 2] = 1.0
        return out

    rows = joined(obs, cameras, points).withColumn("all", F.lit(1))
    step = _steps(rows, "all", lens, huber, 3, jacobian, 0.0).first()
    if step is None:
        return lens, 0.0, 0.0
    return Lens(lens.f + step.d0, lens.cx + step.d1, lens.cy + step.d2), step.cost, step.good


def bundle_adjust(obs: DataFrame, cameras: DataFrame, points: DataFrame, lens: Lens, *, rounds: int = 10, huber: float = 4.0, intrinsics: bool = False, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame, Lens, list[float]]:
    """Cameras, points, lens and the mean robust cost before each round.

    Stops after ``rounds``, or once the cost falls by less than the share ``tolerance``. ``obs`` has ``image, track, u, v``;
    ``cameras`` has ``image, r, t`` (arrays of 9 and 3); ``points`` has ``track, x`` (array of 3). NULL pixels are left out.
    """
    seen = materialise(obs.select("image", "track", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).filter("u is not null and v is not null and not isnan(u) and not isnan(v)"), "adjust-obs")
    cameras, points = materialise(cameras.select("image", "r", "t"), "adjust-cameras"), materialise(points.select("track", "x"), "adjust-points")
    history: list[float] = []
    for _ in range(rounds):
        better, cost, good = refine_lens(seen, cameras, points, lens, huber)
        history.append(cost / max(good, 1.0))
        if len(history) > 1 and history[-2] - history[-1] < tolerance * history[-2]:
            break
        lens = better if intrinsics else lens
        moved = materialise(refine_points(seen, cameras, points, lens, huber), "adjust-points")
        turned = materialise(refine_poses(seen, cameras, moved, lens, huber), "adjust-cameras")
        forget(points)
        forget(cameras)
        points, cameras = moved, turned
    return cameras, points, lens, history


def staged_adjustment(obs: DataFrame, cameras: DataFrame, points: DataFrame, lens: Lens, *, limits: tuple[float, ...] = (16.0, 8.0, 4.0), rounds: int = 3, huber: float = 4.0, intrinsics: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, Lens]:
    """Cameras, points, the observations that are left, and the lens, after stages of filter, adjustment and filter.

    In every stage observations off by the stage's limit or more, or behind their camera, go, and tracks that keep fewer than two.
    Frames as in :func:`bundle_adjust`; points without observations leave.
    """
    left = materialise(obs.select("image", "track", "u", "v"), "staged-obs")

    def kept(rows: DataFrame, cameras: DataFrame, points: DataFrame, lens: Lens, limit: float) -> DataFrame:
        flat = points.select("track", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
        seen = lookup_join(rows, cameras.select("image", "r", "t"), "image", "inner")
        good = filter_tracks(residuals(seen, flat, "track", "u", "v", lens.f, lens.f, lens.cx, lens.cy), "track", limit)
        return materialise(good.select("image", "track", "u", "v"), "staged-obs")

    for limit in limits:
        left = kept(left, cameras, points, lens, limit)
        cameras, points, lens, _ = bundle_adjust(left, cameras, points, lens, rounds=rounds, huber=huber, intrinsics=intrinsics)
        left = kept(left, cameras, points, lens, limit)
        points = points.join(left.select("track").distinct(), "track", "left_semi")
    return cameras, materialise(points, "staged-points"), left, lens
