"""Least-squares estimates per group, from sums that Spark adds up.

A group contributes only a fixed number of sums (moments), combined before the shuffle, so its size does not matter. The small
dense algebra on the sums of many groups is done at once by numpy in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import grouped_quantile
from skyweave.session import forget, materialise


def _batched(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], outputs: Sequence[str], solve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keys`` and ``outputs``: ``solve`` maps a matrix of the inputs to a matrix of the outputs."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.asarray(batch.column(c).cast(pa.float64()).fill_null(np.nan)) for c in inputs])
                y = solve(x)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(y[:, i]) for i in range(len(outputs))]], [*keys, *outputs])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{c} double" for c in outputs])
    return df.select(*keys, *inputs).mapInArrow(run, schema)


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """The rotations nearest to a stack of 3 x 3 matrices; NaN where a matrix is not finite."""
    good = np.isfinite(m).all(axis=(1, 2))
    out = np.full(m.shape, np.nan)
    u, _, vt = np.linalg.svd(m[good])
    u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
    out[good] = u @ vt
    return out


ROTATION = [f"r{k}" for k in range(9)]


def mean_rotation(df: DataFrame, group: str, rotation: str, weight: Column | None = None) -> DataFrame:
    """``group, n, r0..r8``: the chordal mean of rotations (arrays of 9), optionally weighted."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.filter(F.col(rotation).isNotNull())
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.get(rotation, F.lit(k)) * w).alias(f"m{k}") for k in range(9)])

    def solve(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, 0], nearest_rotation(x[:, 1:].reshape(-1, 3, 3)).reshape(-1, 9)])

    return _batched(sums, [group], ["n", *[f"m{k}" for k in range(9)]], ["n", *ROTATION], solve)


SIMILARITY = ["s", *ROTATION, "t0", "t1", "t2"]


def _similarity_of_moments(x: np.ndarray, with_scale: bool) -> np.ndarray:
    n, src, dst, ss = x[:, 0], x[:, 1:4], x[:, 4:7], x[:, 7]
    mu_s, mu_d = src / n[:, None], dst / n[:, None]
    cross = x[:, 8:17].reshape(-1, 3, 3) / n[:, None, None] - mu_d[:, :, None] * mu_s[:, None, :]
    spread = ss / n - (mu_s**2).sum(1)
    u, d, vt = np.linalg.svd(np.nan_to_num(cross))
    sign = np.sign(np.linalg.det(u @ vt))
    u[:, :, 2] *= sign[:, None]
    d[:, 2] *= sign
    r = u @ vt
    s = d.sum(1) / np.maximum(spread, 1e-12) if with_scale else np.ones(len(x))
    t = mu_d - s[:, None] * np.einsum("nij,nj->ni", r, mu_s)
    out = np.column_stack([n, s, r.reshape(-1, 9), t])
    out[n < 3, 1:] = np.nan
    return out


def similarity_fit(df: DataFrame, group: str, src: Sequence[str], dst: Sequence[str], with_scale: bool = True) -> DataFrame:
    """``group, n, s, r0..r8, t0..t2`` with dst = s R src + t by least squares; NaN for fewer than 3 points.

    Moments are taken about each group's own mean, in a first pass, so large coordinates lose no digits.
    """
    columns = [*src, *dst]
    whole = df.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in columns))
    means = materialise(whole.groupBy(group).agg(*[F.avg(c).alias(f"mu_{c}") for c in columns]), "fit-means")
    key = F.struct(group).alias("__at")
    near = lookup_join(whole.select(group, *columns).withColumn("__at", F.struct(group)), means.select(key, *[f"mu_{c}" for c in columns]), "__at", "inner").drop("__at")
    a = {c: F.col(c) - F.col(f"mu_{c}") for c in columns}
    sums = near.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(a[c]).alias(f"a{k}") for k, c in enumerate(columns)],
        F.sum(sum((a[c] * a[c] for c in src), F.lit(0.0))).alias("ss"),
        *[F.sum(a[d] * a[s]).alias(f"x{3 * i + j}") for i, d in enumerate(dst) for j, s in enumerate(src)],
        *[F.first(f"mu_{c}").alias(f"mu{k}") for k, c in enumerate(columns)],
    )

    def solve(x: np.ndarray) -> np.ndarray:
        out = _similarity_of_moments(x[:, :17], with_scale)
        mu_s, mu_d = x[:, 17:20], x[:, 20:23]
        r = out[:, 2:11].reshape(-1, 3, 3)
        out[:, 11:14] += mu_d - out[:, 1:2] * np.einsum("nij,nj->ni", r, mu_s)
        return out

    inputs = ["n", *[f"a{k}" for k in range(6)], "ss", *[f"x{k}" for k in range(9)], *[f"mu{k}" for k in range(6)]]
    return _batched(sums, [group], inputs, ["n", *SIMILARITY], solve)


def fit_residuals(df: DataFrame, group: str, src: Sequence[str], dst: Sequence[str], fits: DataFrame) -> DataFrame:
    """``df`` with ``residual``: the distance of dst from the fitted place of src."""
    key = F.struct(group)
    both = lookup_join(df.withColumn("__k", key), fits.select(key.alias("__k"), *[F.col(c).alias(f"__{c}") for c in SIMILARITY]), "__k", "inner")
    squares = []
    for i in range(3):
        at = F.col("__s") * sum((F.col(f"__r{3 * i + j}") * F.col(src[j]) for j in range(3)), F.lit(0.0)) + F.col(f"__t{i}")
        squares.append((at - F.col(dst[i])) * (at - F.col(dst[i])))
    return both.withColumn("residual", F.sqrt(squares[0] + squares[1] + squares[2])).drop("__k", *[f"__{c}" for c in SIMILARITY])


def robust_similarity_fit(df: DataFrame, group: str, src: Sequence[str], dst: Sequence[str], rounds: int = 5, keep: float = 0.8) -> DataFrame:
    """:func:`similarity_fit` refitted to the ``keep`` share of rows with the smallest residuals, ``rounds`` times."""
    whole = materialise(df.select(group, *src, *dst).filter(" and ".join(f"{c} is not null and not isnan({c})" for c in [*src, *dst])), "fit-rows")
    fits = materialise(similarity_fit(whole, group, src, dst), "fit")
    for _ in range(rounds):
        rows = materialise(fit_residuals(whole, group, src, dst, fits).filter(~F.isnan("residual")), "fit-residuals")
        cut = materialise(grouped_quantile(rows, group, "residual", keep, "cut"), "fit-cut")
        key = F.struct(group)
        kept = lookup_join(rows.withColumn("__k", key), cut.select(key.alias("__k"), "cut"), "__k", "inner").filter(F.col("residual") <= F.col("cut")).drop("__k")
        # written, as the next fit reads them several times
        kept = materialise(kept.select(group, *src, *dst), "fit-kept")
        fits = materialise(similarity_fit(kept, group, src, dst), "fit")
        forget(rows)
        forget(kept)
    return fits


def triangulate(obs: DataFrame, track: str, u: Column, v: Column, rotation: str, translation: str) -> DataFrame:
    """``track, views, x, y, z`` by the linear method: the point that minimises the algebraic error of all views.

    ``u`` and ``v`` are normalised image coordinates. Each view adds two rows to a 4 x 4 normal matrix, of which Spark adds
    up the ten entries; the eigenvector of the smallest eigenvalue is the point. Fewer than 2 views give NaN.
    """
    r = lambda i: F.get(rotation, F.lit(i))
    t = lambda i: F.get(translation, F.lit(i))
    row = lambda k: [r(3 * k), r(3 * k + 1), r(3 * k + 2), t(k)]
    p = [row(k) for k in range(3)]
    length = F.sqrt(u * u + v * v + 1)
    first = [(u * p[2][k] - p[0][k]) / length for k in range(4)]
    second = [(v * p[2][k] - p[1][k]) / length for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = obs.groupBy(track).agg(F.count(F.lit(1)).cast("double").alias("views"), *[F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"n{i}{j}") for i, j in pairs])

    def solve(x: np.ndarray) -> np.ndarray:
        m = np.zeros((len(x), 4, 4))
        for k, (i, j) in enumerate(pairs):
            m[:, i, j] = m[:, j, i] = x[:, 1 + k]
        bad = ~np.isfinite(m).all(axis=(1, 2))
        m[bad] = np.eye(4)
        point = np.linalg.eigh(m)[1][:, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            xyz = point[:, :3] / point[:, 3:]
        xyz[bad | (x[:, 0] < 2)] = np.nan
        return np.column_stack([x[:, 0], xyz])

    return _batched(sums, [track], ["views", *[f"n{i}{j}" for i, j in pairs]], ["views", "x", "y", "z"], solve)


def line_fit(df: DataFrame, group: str, x: Column, y: Column) -> DataFrame:
    """``group, n, slope, intercept, r2`` of y on x by least squares."""
    return df.groupBy(group).agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def flight_offsets(df: DataFrame, cluster: str, flight: str, value: str, rounds: int = 60, step: float = 0.02) -> DataFrame:
    """``flight, offset``: alternately the mean of every cluster and the median residual of every flight.

    ``value`` is a height; flights differ by a constant. The flight with most rows (smaller name first) has offset 0.
    Stops when no offset moves by ``step`` or more. One row per flight and round is compared, in Spark.
    """
    rows = materialise(df.select(F.col(cluster).alias("c"), F.col(flight).alias("f"), F.col(value).alias("v")).filter("c is not null and f is not null and v is not null and not isnan(v)"), "offset-rows")
    biggest = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "f").first()
    offsets = materialise(rows.select("f").distinct().withColumn("offset", F.lit(0.0)), "offsets")
    if biggest is None:
        return offsets.select(F.col("f").alias(flight), "offset")
    for _ in range(rounds):
        moved = lookup_join(rows, offsets, "f", "inner")
        means = moved.groupBy("c").agg(F.avg(F.col("v") - F.col("offset")).alias("m"))
        residual = materialise(lookup_join(rows, means, "c", "inner").withColumn("e", F.col("v") - F.col("m")), "offset-residuals")
        found = grouped_quantile(residual, "f", "e", 0.5, "o")
        zero = found.filter(F.col("f") == biggest.f).select(F.col("o").alias("zero"))
        after = materialise(found.crossJoin(F.broadcast(zero)).select("f", (F.col("o") - F.col("zero")).alias("offset")), "offsets")  # one row
        far = after.join(offsets.withColumnRenamed("offset", "was"), "f").agg(F.max(F.abs(F.col("offset") - F.col("was")))).first()[0]
        offsets = after
        if far is None or far < step:
            break
    return offsets.select(F.col("f").alias(flight), "offset")
