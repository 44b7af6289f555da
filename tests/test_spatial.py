import itertools

import numpy as np
import pytest

from skyweave.functions.geo import ecef_array
from skyweave.operators.spatial import containing_regions, near_pairs

SCHEMA = "name string, lat double, lon double, home boolean"


def brute(rows, radius):
    good = sorted({(n, a, (o + 180) % 360 - 180) for n, a, o, _ in rows if n is not None and a is not None and o is not None and np.isfinite([a, o]).all() and abs(a) <= 90 and abs(o) <= 180})
    at = ecef_array(np.array([g[1] for g in good]), np.array([g[2] for g in good]))
    return {(min(a[0], b[0]), max(a[0], b[0])) for (i, a), (j, b) in itertools.combinations(enumerate(good), 2) if a[0] != b[0] and np.linalg.norm(at[i] - at[j]) <= radius}


def cloud(n=260, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        kind = k % 6
        lat, lon = [(50.0, 8.0), (-17.0, 180.0), (89.99998, 0.0), (0.0, -180.0), (78.0, 23.0), (50.0, 8.0)][kind]
        lat = min(90.0, lat + rng.normal() * 5e-5) if kind != 5 else lat
        lon = rng.uniform(-180, 180) if kind == 2 else (lon + rng.normal() * 5e-5 + 180) % 360 - 180
        rows.append((f"p{k:04d}", float(lat), float(lon), True))
    return rows


@pytest.mark.parametrize("cell_rows", [20_000, 12])
def test_near_pairs_equals_brute_force(spark, cell_rows):
    rows = cloud() + [(f"same{k}", 50.0, 8.0, None) for k in range(40)] + [("p0001", 50.0, 8.0, True), ("p0002", None, 1.0, True), ("x", float("nan"), 1.0, True), (None, 50.0, 8.0, True), ("far", 95.0, 8.0, True)]
    got = near_pairs(spark.createDataFrame(rows, SCHEMA), "name", "lat", "lon", 5.0, cell_rows=cell_rows).collect()
    assert len(got) == len({(r.key_a, r.key_b) for r in got})
    assert {(r.key_a, r.key_b) for r in got} == brute(rows, 5.0)


def test_near_pairs_over_a_large_radius(spark):
    rows = cloud(90)
    got = near_pairs(spark.createDataFrame(rows, SCHEMA), "name", "lat", "lon", 3_000_000.0, cell_rows=20)
    assert {(r.key_a, r.key_b) for r in got.collect()} == brute(rows, 3_000_000.0)


def test_near_pairs_of_nothing(spark):
    assert near_pairs(spark.createDataFrame([], SCHEMA), "name", "lat", "lon", 5.0).count() == 0
    with pytest.raises(ValueError):
        near_pairs(spark.createDataFrame([], SCHEMA), "name", "lat", "lon", float("nan"))


def inside(lat, lon, xs, ys):
    turn = lambda v: xs[0] + (v - xs[0] + 180) % 360 - 180
    x, odd = turn(lon), False
    for k in range(len(xs)):
        x1, y1, x2, y2 = turn(xs[k]), ys[k], turn(xs[(k + 1) % len(xs)]), ys[(k + 1) % len(xs)]
        if (y1 <= lat) != (y2 <= lat) and x < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


@pytest.mark.parametrize("cell_rows", [20_000, 15])
def test_regions_across_the_date_line_and_of_either_winding(spark, cell_rows):
    rng = np.random.default_rng(5)
    points = [(f"q{k}", float(rng.uniform(-3, 3)), float((rng.uniform(175, 185) + 180) % 360 - 180), True) for k in range(200)]
    star = [(2.5 * (1 + k % 2) * np.cos(k * np.pi / 8), 1.2 * (1 + k % 2) * np.sin(k * np.pi / 8)) for k in range(16)]
    regions = [("star", [float((180 + x + 180) % 360 - 180) for x, _ in star], [float(y) for _, y in star])]
    regions += [("box", [178.0, 178.0, -178.0, -178.0], [-1.0, 1.0, 1.0, -1.0]), ("line", [1.0, 2.0], [0.0, 1.0]), ("gap", [1.0, None, 3.0], [0.0, 1.0, 2.0]), (None, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])]
    shapes = spark.createDataFrame(regions, "name string, lons array<double>, lats array<double>")
    got = containing_regions(spark.createDataFrame(points, SCHEMA), "name", "lat", "lon", shapes, "name", "lons", "lats", cell_rows=cell_rows).collect()
    expect = {(n, c) for n, a, o, _ in points for c, xs, ys in regions[:2] if inside(a, o, xs, ys)}
    assert expect and {(r.key, r.region) for r in got} == expect and len(got) == len(expect)
    assert containing_regions(spark.createDataFrame([], SCHEMA), "name", "lat", "lon", shapes, "name", "lons", "lats").count() == 0
    assert containing_regions(spark.createDataFrame(points, SCHEMA), "name", "lat", "lon", shapes.limit(0), "name", "lons", "lats").count() == 0
