"""Point clouds: voxels, thinning, outliers, recursive median cells, matching of descriptors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweave.operators.keyed import lookup_join
from skyweave.operators.ordering import positions_in_group
from skyweave.session import Growing, forget, materialise, materialise_counted


def voxel(columns: Sequence[str], size: float) -> list[Column]:
    """Cell numbers of a point."""
    return [F.floor(F.col(c) / F.lit(float(size))).alias(f"v{c}") for c in columns]


def voxel_counts(points: DataFrame, columns: Sequence[str], size: float) -> DataFrame:
    return points.groupBy(*voxel(columns, size)).agg(F.count(F.lit(1)).alias("n"))


def voxel_representative(points: DataFrame, key: str, columns: Sequence[str], size: float, order: Column | None = None) -> DataFrame:
    """One point per voxel: the one with the smallest ``order`` (default: the MD5 of the key as text), then key."""
    first = F.md5(F.col(key).cast("string")) if order is None else order
    kept = F.min(F.struct(first.alias("o"), F.col(key).alias("key"), *[F.col(c) for c in columns])).alias("p")
    return points.groupBy(*voxel(columns, size)).agg(kept).select(*[f"v{c}" for c in columns], F.col("p.key").alias(key), *[F.col(f"p.{c}") for c in columns])


def voxel_size_for(points: DataFrame, columns: Sequence[str], most: int, low: float, high: float, rounds: int = 20) -> float:
    """The smallest size found by geometric bisection that leaves at most ``most`` occupied voxels."""
    for _ in range(rounds):
        size = (low * high) ** 0.5
        if points.select(*voxel(columns, size)).distinct().count() > most:
            low = size
        else:
            high = size
    return high


def median_cells(points: DataFrame, key: str, x: str, y: str, most: int, max_rounds: int = 60) -> DataFrame:
    """``key, cell``: cells of at most ``most`` points, by splitting at the median of the longer side, again and again.

    The points of a cell are ranked by the longer side (x if both are equal), then by key, and the first half (rounded down)
    goes left; so equal positions are split as well. Keys must be distinct and positions not missing. Cell numbers are binary paths.
    """
    at = materialise(points.select(F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(1).cast("long").alias("cell")), "cells")
    for _ in range(max_rounds):
        sizes = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("by_x")).filter(F.col("n") > most)
        sizes = materialise(sizes, "cells-sizes")
        if sizes.isEmpty():
            return at.select(F.col("id").alias(key), "cell")
        joined = materialise(lookup_join(at, sizes, "cell", "left").withColumn("v", F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y"))), "cells-open")
        placed = positions_in_group(joined.filter("n is not null").select("id", "x", "y", "cell", "v"), "cell", [F.col("v"), F.col("id")])
        right = (F.col("pos") >= F.floor(F.col("size") / 2)).cast("long")
        done = joined.filter("n is null").select("id", "x", "y", "cell")
        after = materialise(done.unionByName(placed.select("id", "x", "y", (F.col("cell") * 2 + right).alias("cell"))), "cells")
        forget(at)
        forget(joined)
        at = after
    raise RuntimeError(f"cells are not small enough after {max_rounds} rounds")


def nearest_of_set(points: DataFrame, targets: DataFrame, key: str, columns: Sequence[str], name: str = "d", few: int = 1_000, reach: float | None = None) -> DataFrame:
    """``key, d``: the distance of every point from the nearest target; no rows if there are no targets.

    Up to ``few`` targets, which are counted, are broadcast. More are put into cubes of the size ``reach`` (by default from the
    targets' extent, one target a cube on average): a point meets the 27 cubes around it, and is done once its nearest target is within
    the reach; the others go on with four times the reach. Coordinates must not be missing.
    """
    t = targets.select(*[F.col(c).cast("double").alias(f"t_{c}") for c in columns])
    t, n = materialise_counted(t, "targets")
    far = F.sqrt(sum(((F.col(c) - F.col(f"t_{c}")) * (F.col(c) - F.col(f"t_{c}")) for c in columns), F.lit(0.0)))
    left = points.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    if n <= few:
        return left.join(F.broadcast(t)).groupBy(key).agg(F.min(far).alias(name))
    if reach is None:
        wide = t.agg(*[(F.max(f"t_{c}") - F.min(f"t_{c}")).alias(c) for c in columns]).first()
        reach = max(max(wide) / n ** (1 / len(columns)), 1e-9)
    found = Growing(points.sparkSession, "nearest-of-set")
    left = materialise(left, "nearest-asking")
    while True:
        cube = lambda c, p="": F.floor(F.col(p + c) / F.lit(reach))  # noqa: B023, E731
        near = t
        for c in columns:
            near = near.withColumn(f"b_{c}", F.explode(F.array(*[cube(c, "t_") + d for d in (-1, 0, 1)])))
        asked = left.withColumns({f"b_{c}": cube(c) for c in columns})
        best = asked.join(near, [f"b_{c}" for c in columns]).groupBy(key).agg(F.min(far).alias(name)).filter(F.col(name) <= reach)
        found.append(best)
        left, open_ = materialise_counted(left.join(found.part(-1), key, "left_anti"), "nearest-asking")
        if not open_:
            return found.read()
        reach *= 4


def _pack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def mutual_matches(a: DataFrame, b: DataFrame, group: str, key: str, vector: str, ratio: float = 0.85, block: int = 2048) -> DataFrame:
    """``group, a, b, distance``: mutual nearest neighbours that pass the ratio test.

    Distance of unit vectors: sqrt(2 - 2 cos). A pair is kept if each is the other's nearest (smaller key first on ties) and the
    distance is below ``ratio`` times that to a's second nearest; a group with one target matches nothing. Groups are
    cut into blocks of both sides; each pair of blocks is one task that returns its two nearest per a and nearest per b.
    Vectors of a group must have one length and be finite, and not zero.
    """

    def blocked(df: DataFrame, mine: str, other: str, sizes: DataFrame) -> DataFrame:
        j = lookup_join(df.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(vector).alias("v")), sizes, "g", "left").fillna(1, ["na", "nb"])
        place = F.pmod(F.xxhash64("id"), F.col("n" + mine)).cast("int").alias(mine)
        return j.select("g", "id", "v", place, F.explode(F.sequence(F.lit(0), F.col("n" + other) - 1)).alias(other))

    count = lambda df, n: df.groupBy(F.col(group).alias("g")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(n))
    # only groups of more than one block: each has more than `block` rows
    sizes = count(a, "na").join(count(b, "nb"), "g", "full").filter("na > 1 or nb > 1").fillna(1, ["na", "nb"])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"g": left.column("g").type if left.num_columns else pa.int32()}
        if not left.num_rows or not right.num_rows:
            return pa.table({"g": pa.array([], empty["g"]), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "of": pa.array([], pa.string())})
        x, y = (_pack(t.column("v").combine_chunks()) for t in (left, right))
        x, y = (m / np.linalg.norm(m, axis=1)[:, None] for m in (x, y))
        ia, ib = np.asarray(left.column("id")), np.asarray(right.column("id"))
        d = np.sqrt(np.maximum(2 - 2 * np.round(x @ y.T, 12), 0))
        two = np.lexsort((np.broadcast_to(ib, d.shape), d), axis=1)[:, :2]
        one = np.lexsort((np.broadcast_to(ia, d.T.shape), d.T), axis=1)[:, 0]
        rows_a = np.repeat(np.arange(len(ia)), two.shape[1])
        a_ = np.concatenate([ia[rows_a], ia[one]])
        b_ = np.concatenate([ib[two.ravel()], ib])
        dd = np.concatenate([d[rows_a, two.ravel()], d[one, np.arange(len(ib))]])
        return pa.table({"g": pa.array([left.column("g")[0].as_py()] * len(a_), empty["g"]), "a": pa.array(a_), "b": pa.array(b_), "d": pa.array(dd), "of": pa.array(["a"] * len(rows_a) + ["b"] * len(ib))})

    kind = dict(a.dtypes)[group]
    left, right = blocked(a, "a", "b", sizes), blocked(b, "b", "a", sizes)
    found = left.groupBy("g", "a", "b").cogroup(right.groupBy("g", "a", "b")).applyInArrow(nearest, f"g {kind}, a long, b long, d double, of string")
    found = materialise(found, "mutual")
    by_a = Window.partitionBy("g", "a").orderBy("d", "b")
    best_a = found.filter("of = 'a'").withColumn("r", F.row_number().over(by_a)).filter("r <= 2").groupBy("g", "a").agg(F.min_by("b", "r").alias("b"), F.min("d").alias("d"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("second"))
    best_b = found.filter("of = 'b'").groupBy("g", "b").agg(F.min(F.struct("d", "a")).alias("m")).select("g", "b", F.col("m.a").alias("a"))
    return best_a.filter(F.col("d") < ratio * F.col("second")).join(best_b, ["g", "a", "b"]).select(F.col("g").alias(group), "a", "b", F.col("d").alias("distance"))
