"""Points near other points, and points inside regions.

Latitude is cut into strips of about equally many points. A point belongs to one strip (its *home*) and
is also sent to the strips below within reach. Strips with many points are cut again by longitude, and cells
that are still large (many points at one place) into hashed blocks, of which each pair of blocks is one
group. Inside a group the points are swept from south to north past a set of active points ordered by longitude.
A pair is owned by the home cell of its southern point, so it comes out once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions.geo import ecef_array, latitude_reach, longitude_reach
from skyweave.operators.keyed import lookup_join
from skyweave.session import materialise, shuffle_width

#: Points of a group, and at most as many strips and longitude cuts per strip, whatever the input.
CELL_ROWS = 20_000
MAX_STRIPS = 4_096
MAX_CUTS = 64


@dataclass(frozen=True)
class Strips:
    """``lat``: inner bounds of the strips, south to north; ``lon[s]``: inner longitude bounds of strip s; ``base[s]``: number of its first cell."""

    lat: np.ndarray
    lon: list[np.ndarray]

    @property
    def base(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(x) + 1 for x in self.lon])])

    def home(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.lat, lat, side="right")
        cell = np.empty(len(lat), np.int64)
        base = self.base
        for s in np.unique(strip):
            rows = strip == s
            cell[rows] = base[s] + np.searchsorted(self.lon[s], lon[rows], side="right")
        return cell

    def reached(self, south: np.ndarray, north: np.ndarray, west: np.ndarray, east: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that meets a row's box; longitudes may run past 180 degrees either way."""
        first, last = np.searchsorted(self.lat, south, side="right"), np.searchsorted(self.lat, north, side="right")
        base = self.base
        rows, cells = [], []
        for s in range(int(first.min()), int(last.max()) + 1) if len(first) else ():
            here = np.flatnonzero((first <= s) & (s <= last))
            for turn in (-360.0, 0.0, 360.0):
                w, e = np.maximum(west[here] + turn, -180.0), np.minimum(east[here] + turn, 180.0)
                met = w <= e
                a = np.searchsorted(self.lon[s], w[met], side="right")
                b = np.searchsorted(self.lon[s], e[met], side="right")
                width = b - a + 1
                rows.append(np.repeat(here[met], width))
                cells.append(base[s] + np.repeat(a, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.column_stack([np.concatenate(rows), np.concatenate(cells)]), axis=0)
        return both[:, 0], both[:, 1]


def latitude_strips(points: DataFrame, rows: int, *, cell_rows: int = CELL_ROWS) -> Strips:
    """Bounds from quantiles of all points; what comes to the driver is bounded by MAX_STRIPS * MAX_CUTS numbers."""
    wanted = int(min(MAX_STRIPS, max(shuffle_width(points.sparkSession), -(-rows // cell_rows))))
    probs = [k / wanted for k in range(1, wanted)]
    lat = np.unique(points.approxQuantile("lat", probs, 0.1 / wanted)) if probs and rows else np.zeros(0)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(lat, np.asarray(batch.column(0)), side="right").astype(np.int32)), batch.column(1)], ["strip", "lon"])

    placed = points.select("lat", "lon").mapInArrow(strip, "strip int, lon double")
    cuts = placed.groupBy("strip").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("lon", [k / MAX_CUTS for k in range(1, MAX_CUTS)], 1000).alias("lons"))
    lon = [np.zeros(0)] * (len(lat) + 1)
    for r in cuts.collect():
        blocks = min(MAX_CUTS, -(-r.n // cell_rows))
        lon[r.strip] = np.unique([r.lons[round(k * MAX_CUTS / blocks) - 1] for k in range(1, blocks)]) if blocks > 1 else np.zeros(0)
    return Strips(lat, lon)


def positions(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """``key, lat, lon`` of the rows with a usable position, longitudes in [-180, 180); one row per key and position."""
    rows = df.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    good = rows.filter("key is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and abs(lon) <= 180")
    return good.withColumn("lon", F.when(F.col("lon") == 180, F.lit(-180.0)).otherwise(F.col("lon"))).distinct()


def _sweep(radius_m: float):
    reach = latitude_reach(radius_m)

    def pairs_of(part: pa.Table) -> Iterator[pa.RecordBatch]:
        lat, lon = np.asarray(part.column("lat")), np.asarray(part.column("lon"))
        names = part.column("key").to_pylist()
        own, block = np.asarray(part.column("home")), np.asarray(part.column("block"))
        here = sorted(range(len(names)), key=lambda i: (lat[i], lon[i], names[i]))
        at = ecef_array(lat, lon)
        turn = longitude_reach(lat, radius_m)
        bi, bj = int(part.column("bi")[0].as_py()), int(part.column("bj")[0].as_py())
        active: list[tuple[float, int]] = []
        oldest, a, b = 0, [], []
        for p in here:
            while lat[here[oldest]] < lat[p] - reach:
                gone = here[oldest]
                if own[gone]:
                    k = bisect.bisect_left(active, (lon[gone], gone))
                    del active[k]
                oldest += 1
            if turn[p] >= 180.0:
                spans = [(-400.0, 400.0)]
            else:
                w, e = lon[p] - turn[p], lon[p] + turn[p]
                spans = [(w, e)] + ([(w + 360.0, 400.0)] if w < -180.0 else []) + ([(-400.0, e - 360.0)] if e >= 180.0 else [])
            for w, e in spans:
                for k in range(bisect.bisect_left(active, (w, -1)), len(active)):
                    x, q = active[k]
                    if x > e:
                        break
                    if bi == bj or block[q] != block[p]:
                        a.append(q)
                        b.append(p)
            if own[p]:
                bisect.insort(active, (lon[p], p))
            if len(a) > 200_000:
                yield from verified(a, b, at, names)
                a, b = [], []
        yield from verified(a, b, at, names)

    def verified(a: list[int], b: list[int], at: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        if not a:
            return
        i, j = np.array(a), np.array(b)
        d = np.sqrt(((at[i] - at[j]) ** 2).sum(1))
        close = np.flatnonzero(d <= radius_m)
        rows = [(min(names[i[k]], names[j[k]]), max(names[i[k]], names[j[k]]), float(d[k])) for k in close if names[i[k]] != names[j[k]]]
        if rows:
            first, second, far = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(far)], ["key_a", "key_b", "dist_m"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([np.asarray(batch.column(c)) for c in range(3)])
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:], strict=False):
                mine = tuple(marks[x])
                if group is not None and mine != group:
                    yield from pairs_of(pa.Table.from_batches(held).combine_chunks())
                    held = []
                group = mine
                held.append(batch.slice(x, y - x))
        if held:
            yield from pairs_of(pa.Table.from_batches(held).combine_chunks())

    return sweep


def near_pairs(df: DataFrame, key: str, lat: str, lon: str, radius_m: float, *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs of different keys at most ``radius_m`` metres apart: ``key_a < key_b, dist_m``.

    The distance is the straight line between the points at height 0. Rows without a key, or with a
    latitude or longitude that is NULL, NaN or out of range, take no part; repeated rows count once; a key at
    several positions is paired by its closest one. Points at one place are all paired; empty input
    gives an empty result. Keys are strings. Longitudes meet across 180 degrees and around the poles.
    """
    if not radius_m >= 0:
        raise ValueError("radius_m must not be negative")
    points = materialise(positions(df, key, lat, lon).withColumn("key", F.col("key").cast("string")), "spatial-points")
    rows = points.count()
    strips = latitude_strips(points, rows, cell_rows=cell_rows)
    sent = df.sparkSession.sparkContext.broadcast(strips)
    reach = latitude_reach(radius_m)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = sent.value
        for batch in batches:
            y, x = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            turn = longitude_reach(y, radius_m)
            row, cell = cut.reached(y - reach, y, x - turn, x + turn)
            home = cut.home(y, x)[row] == cell
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *[batch.column(c).take(take) for c in range(3)], pa.array(home)], ["cell", "key", "lat", "lon", "home"])

    placed = materialise(points.select("key", "lat", "lon").mapInArrow(place, "cell long, key string, lat double, lon double, home boolean"), "spatial-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * cell_rows)).cast("int").alias("blocks")).filter("blocks > 1")
    # at most one row per cell, MAX_STRIPS * MAX_CUTS of them
    blocked = placed.join(F.broadcast(sizes), "cell", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.col("blocks"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    grouped = blocked.withColumn("other", other).select(
        "cell", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "key", "lat", "lon", "home", "block"
    )
    swept = grouped.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj").mapInArrow(_sweep(radius_m), "key_a string, key_b string, dist_m double")
    return swept.groupBy("key_a", "key_b").agg(F.min("dist_m").alias("dist_m"))


def near_places(df: DataFrame, key: str, lat: str, lon: str, radius_m: float, *, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """:func:`near_pairs` without listing the pairs of one place: ``members(place, key)`` and ``pairs(place_a, place_b, dist_m)``.

    All keys at exactly one position are a place, named by its smallest key; ``pairs`` are places at most ``radius_m`` apart. A million
    photos at one spot are a million rows of ``members``, not half a billion pairs. Two keys are near if they share a place or theirs are a pair.
    """
    points = materialise(positions(df, key, lat, lon).withColumn("key", F.col("key").cast("string")), "spatial-points")
    named = materialise(points.groupBy("lat", "lon").agg(F.min("key").alias("least")).withColumn("place", F.concat_ws("@", F.col("least"), F.hex(F.xxhash64("lat", "lon")))), "spatial-places")
    at = F.struct("lat", "lon")
    members = lookup_join(points.withColumn("at", at), named.select(at.alias("at"), "place"), "at", "inner").select("place", "key")
    pairs = near_pairs(named, "place", "lat", "lon", radius_m, cell_rows=cell_rows)
    return members, pairs.select(F.col("key_a").alias("place_a"), F.col("key_b").alias("place_b"), "dist_m")


def _inside(points: pa.Table, regions: pa.Table) -> pa.Table:
    lat, lon = np.asarray(points.column("lat")), np.asarray(points.column("lon"))
    order = np.argsort(lat, kind="stable")
    lat, lon = lat[order], lon[order]
    low, high = (lat[0], lat[-1]) if len(lat) else (0.0, 0.0)
    out_rows, out_codes = [], []
    for code, xs, ys in zip(regions.column("code").to_pylist(), regions.column("lons").to_pylist(), regions.column("lats").to_pylist(), strict=True):
        if not len(lat):
            break
        x, y = np.asarray(xs, float), np.asarray(ys, float)
        turned = lambda v, first=x[0]: first + np.mod(v - first + 180.0, 360.0) - 180.0
        x, at = turned(x), turned(lon)
        x2, y2 = np.roll(x, -1), np.roll(y, -1)
        south, north = np.minimum(y, y2), np.maximum(y, y2)
        inside = np.zeros(len(lat), bool)
        for k in np.flatnonzero((south <= high) & (north > low) & (south < north)):
            a, b = np.searchsorted(lat, south[k]), np.searchsorted(lat, north[k])
            if a < b:
                inside[a:b] ^= at[a:b] < x[k] + (lat[a:b] - y[k]) * (x2[k] - x[k]) / (y2[k] - y[k])
        hits = np.flatnonzero(inside)
        out_rows.append(order[hits])
        out_codes += [code] * len(hits)
    rows = np.concatenate(out_rows) if out_rows else np.zeros(0, np.int64)
    return pa.table({"key": points.column("key").combine_chunks().take(pa.array(rows)) if len(rows) else pa.array([], pa.string()), "region": pa.array(out_codes, pa.string())})


def containing_regions(df: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, code: str, lons: str, lats: str, *, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every point with every region that contains it: ``key, region``.

    A region is one polygon, its corners in order, the last joined to the first, either winding; edges are
    straight in the plane of longitude and latitude, with longitudes taken within 180 degrees of the first
    corner. A point is inside if a line to the east crosses the border an odd number of times.
    Points as in :func:`near_pairs`. Regions without a code, with fewer than 3 corners, lists of different
    length or a missing corner contain nothing. Regions travel to the cells that their boxes meet.
    """
    points = materialise(positions(df, key, lat, lon).withColumn("key", F.col("key").cast("string")), "spatial-points")
    strips = latitude_strips(points, points.count(), cell_rows=cell_rows)
    sent = df.sparkSession.sparkContext.broadcast(strips)
    shapes = regions.select(F.col(code).cast("string").alias("code"), F.col(lons).cast("array<double>").alias("lons"), F.col(lats).cast("array<double>").alias("lats"))
    whole = lambda c: ~F.exists(c, lambda v: v.isNull() | F.isnan(v))
    shapes = shapes.filter(F.col("code").isNotNull() & (F.size("lons") >= 3) & (F.size("lons") == F.size("lats")) & whole("lons") & whole("lats")).distinct()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = sent.value.home(np.asarray(batch.column(1)), np.asarray(batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", "key", "lat", "lon"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = []
            for xs, ys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = xs[0] + np.mod(np.asarray(xs) - xs[0] + 180.0, 360.0) - 180.0
                boxes.append((min(ys), max(ys), x.min(), x.max()))
            if boxes:
                row, cell = sent.value.reached(*np.array(boxes).T)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[c.take(pa.array(row)) for c in batch.columns]], ["cell", "code", "lons", "lats"])

    placed = points.select("key", "lat", "lon").mapInArrow(home, "cell long, key string, lat double, lon double")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    met = shapes.mapInArrow(spread, "cell long, code string, lons array<double>, lats array<double>")
    met = met.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = placed.groupBy("cell", "block").cogroup(met.groupBy("cell", "block")).applyInArrow(_inside, "key string, region string")
    return found.distinct()


def _nearest_of_block(k: int):
    def nearest(queries: pa.Table, points: pa.Table) -> pa.Table:
        if not queries.num_rows or not points.num_rows:
            return pa.table({"key": pa.array([], pa.string()), "other": pa.array([], pa.string()), "dist_m": pa.array([], pa.float64())})
        q = ecef_array(np.asarray(queries.column("lat")), np.asarray(queries.column("lon")))
        order = points.column("key").combine_chunks()
        points = points.take(pc.sort_indices(order))
        names, asked = points.column("key").to_pylist(), queries.column("key").to_pylist()
        at = ecef_array(np.asarray(points.column("lat")), np.asarray(points.column("lon")))
        place = {n: i for i, n in enumerate(names)}
        rows: list[tuple] = []
        for i in range(0, len(asked), 256):
            part = q[i : i + 256]
            d = np.sqrt(np.maximum(((part[:, None, :] - at[None, :, :]) ** 2).sum(2), 0))
            for row, name in enumerate(asked[i : i + 256]):
                if name in place:
                    d[row, place[name]] = np.inf
            best = np.argsort(np.round(d, 6), axis=1, kind="stable")[:, :k]
            for row in range(len(part)):
                rows += [(asked[i + row], names[j], float(d[row, j])) for j in best[row] if np.isfinite(d[row, j])]
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"key": pa.array(a, pa.string()), "other": pa.array(b, pa.string()), "dist_m": pa.array(c, pa.float64())})

    return nearest


def nearest_points(df: DataFrame, key: str, lat: str, lon: str, k: int, *, start_m: float = 50.0, cell_rows: int = 4000) -> DataFrame:
    """The ``k`` nearest other keys of every key: ``key, other, dist_m, rank``; equal distances (to a micrometre) by smaller key.

    A key's list is final when its k-th distance is within the reach that its cell was given; the others try again with
    four times the reach, against the points that are then in reach. Keys must have one position each; other conditions as in :func:`near_pairs`.
    """
    points = materialise(positions(df, key, lat, lon).withColumn("key", F.col("key").cast("string")).dropDuplicates(["key"]), "nearest-points")
    rows = points.count()
    strips = latitude_strips(points, rows, cell_rows=cell_rows)
    sent = df.sparkSession.sparkContext.broadcast(strips)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = sent.value.home(np.asarray(batch.column(1)), np.asarray(batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", "key", "lat", "lon"])

    schema = "cell long, key string, lat double, lon double"
    left, done, reach_m = points, None, start_m
    while True:
        last = reach_m > 2.6e7
        dlat = 180.0 if last else latitude_reach(reach_m)

        def spread(batches: Iterator[pa.RecordBatch], dlat=dlat, reach_m=reach_m, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, x = np.asarray(batch.column(1)), np.asarray(batch.column(2))
                turn = np.full(len(y), 180.0) if last else longitude_reach(y, reach_m)
                row, cell = sent.value.reached(y - dlat, y + dlat, x - turn, x + turn)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[c.take(pa.array(row)) for c in batch.columns]], ["cell", "key", "lat", "lon"])

        asking = materialise(left.select("key", "lat", "lon").mapInArrow(home, schema), "nearest-asking")
        # one row per cell, at most MAX_STRIPS * MAX_CUTS
        cells = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("qn"))
        reached = points.select("key", "lat", "lon").mapInArrow(spread, schema).join(F.broadcast(cells), "cell")
        sizes = reached.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * cell_rows)).cast("int").alias("pn"))
        block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asking.join(F.broadcast(cells), "cell").join(F.broadcast(sizes), "cell").withColumn("q", block("qn")).withColumn("p", every("pn"))
        p = reached.join(F.broadcast(sizes), "cell").withColumn("p", block("pn")).withColumn("q", every("qn"))
        pick = ["cell", "q", "p", "key", "lat", "lon"]
        found = q.select(*pick).groupBy("cell", "q", "p").cogroup(p.select(*pick).groupBy("cell", "q", "p")).applyInArrow(_nearest_of_block(k), "key string, other string, dist_m double")
        w = Window.partitionBy("key").orderBy(F.round("dist_m", 6), "other")
        lists = materialise(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "nearest-lists")
        if last:
            ready = lists
        else:
            final = lists.filter((F.col("rank") == k) & (F.col("dist_m") <= reach_m)).select("key")
            ready = lists.join(final, "key", "left_semi")
            left = materialise(left.join(final, "key", "left_anti"), "nearest-left")
        done = ready if done is None else done.unionByName(ready)
        if last or left.isEmpty():
            return done
        reach_m *= 4
