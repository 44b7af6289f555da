import numpy as np
from pyspark.sql import functions as F

from skyweave.operators.matching import average_rotations, filter_tracks, footprint_overlap, residuals

RNG = np.random.default_rng(11)


def rot(v):
    th = np.linalg.norm(v)
    a = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / max(th, 1e-12)
    return np.eye(3) + np.sin(th) * a + (1 - np.cos(th)) * a @ a


def angle(a, b):
    return np.degrees(np.arccos(np.clip((np.trace(a.T @ b) - 1) / 2, -1, 1)))


def test_residuals_and_filter(spark):
    eye = np.eye(3).ravel().tolist()
    obs = [(1, 10.0, 20.0, 0.0), (1, 10.0, 21.0, 0.0), (1, 10.0, 90.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 5.0, 5.0, 0.0), (3, 5.0, 6.0, -9.0)]
    o = spark.createDataFrame([(t, u, v, eye, [0.0, 0.0, z]) for t, u, v, z in obs], "track int, u double, v double, r array<double>, t array<double>")
    p = spark.createDataFrame([(1, 1.0, 2.0, 1.0), (2, float("nan"), 0.0, 1.0), (3, 0.5, 0.5, 1.0)], "track int, x double, y double, z double")
    e = residuals(o, p, "track", "u", "v", 10.0, 10.0, 0.0, 0.0)
    assert sorted(r.error for r in e.collect()) == [0.0, 0.0, 1.0, 70.0, float("inf")]
    assert {(r.track, r.error) for r in filter_tracks(e, "track", 4.0).collect()} == {(1, 0.0), (1, 1.0)}


def test_rotation_averaging_reduces_the_error(spark):
    truth = [rot(RNG.normal(size=3)) for _ in range(14)]
    edges = []
    for i in range(14):
        for j in range(i + 1, 14):
            if (i + j) % 2 or j == i + 1:
                noise = rot(RNG.normal(size=3) * (0.005 if (i * j) % 11 else 1.0))
                edges.append((i, j, (noise @ truth[j] @ truth[i].T).ravel().tolist()))
    start = [(i, (rot(RNG.normal(size=3) * 0.08) @ r).ravel().tolist()) for i, r in enumerate(truth)]
    got = average_rotations(spark.createDataFrame(edges, "i int, j int, rij array<double>"), spark.createDataFrame([*start, (99, start[0][1])], "node int, r array<double>"), tolerance_deg=0.05)
    found = {r.node: np.array(r.r).reshape(3, 3) for r in got.collect()}

    def error(rs):
        return np.median([angle(rs[j] @ rs[i].T, truth[j] @ truth[i].T) for i in range(14) for j in range(i + 1, 14)])

    before = error({i: np.array(r).reshape(3, 3) for i, r in start})
    assert error(found) < 0.25 * before and np.allclose(found[99], np.array(start[0][1]).reshape(3, 3), atol=1e-6)


def test_footprints_of_level_cameras(spark):
    down = np.array([[1.0, 0, 0], [0, -1, 0], [0, 0, -1]]).ravel().tolist()
    up = np.eye(3).ravel().tolist()
    c = spark.createDataFrame([("a", down, [0.0, 0.0, 100.0]), ("b", down, [50.0, 0.0, 100.0]), ("c", down, [1000.0, 0.0, 100.0]), ("d", up, [0.0, 0.0, 100.0])], "name string, r array<double>, c array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "i string, j string")
    got = {(r.i, r.j): r.overlap for r in footprint_overlap(c, pairs, 400, 400, 400.0, grid=8).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.0, ("a", "d"): 0.0}
    assert footprint_overlap(c, pairs.filter(F.lit(False)), 400, 400, 400.0).count() == 0
