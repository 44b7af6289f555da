import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators.adjust import Lens, bundle_adjust
from skyweave.operators.pixels import guided_candidates, log_depth_ratios, pooled_attention, ratio_test, reprojection_overlap, robust_regression, valid_pixels

RNG = np.random.default_rng(5)


def rot(v):
    th = np.linalg.norm(v)
    a = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / max(th, 1e-12)
    return np.eye(3) + np.sin(th) * a + (1 - np.cos(th)) * a @ a


def test_bundle_adjustment_lowers_the_error_of_a_disturbed_scene(spark):
    points = RNG.uniform(-2, 2, (40, 3))
    cams = [(rot(RNG.normal(size=3) * 0.3), np.array([0.0, 0.0, 9.0]) + RNG.normal(size=3) * 0.5) for _ in range(6)]
    lens = Lens(800.0, 320.0, 240.0)
    obs = []
    for k, (r, t) in enumerate(cams):
        for p, x in enumerate(points):
            c = r @ x + t
            obs.append((k, p, float(800 * c[0] / c[2] + 320), float(800 * c[1] / c[2] + 240)))
    obs[7] = (*obs[7][:2], obs[7][2] + 300, obs[7][3])
    obs += [(0, 3, None, 1.0), (99, 1, 5.0, 5.0), (1, 999, 5.0, 5.0)]
    o = spark.createDataFrame(obs, "image int, track int, u double, v double")
    c = spark.createDataFrame([(k, (rot(RNG.normal(size=3) * 0.01) @ r).ravel().tolist(), (t + RNG.normal(size=3) * 0.02).tolist()) for k, (r, t) in enumerate(cams)], "image int, r array<double>, t array<double>")
    x = spark.createDataFrame([(p, (v + RNG.normal(size=3) * 0.03).tolist()) for p, v in enumerate(points)] + [(500, [0.0, 0.0, 0.0])], "track int, x array<double>")
    cameras, moved, same, history = bundle_adjust(o, c, x, lens, rounds=8)
    shifted = (2 * 4 * 300 - 16) / 240  # the robust cost of the one wrong observation, which must not pull the rest
    assert history[-1] - shifted < 0.05 * (history[0] - shifted) and all(b <= a * 1.001 for a, b in zip(history, history[1:], strict=False)) and same == lens
    assert cameras.count() == 6 and {r.track: r.x for r in moved.collect()}[500] == [0.0, 0.0, 0.0]
    r = np.array(cameras.filter("image = 0").first().r).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3), atol=1e-9)


def test_reprojection_overlap_of_a_wall(spark):
    eye = np.eye(3).ravel().tolist()
    w = h = 10
    pixels = [(1, im, x, y, 5.0, 1.0) for im in (1, 2) for x in range(w) for y in range(h)]
    px = spark.createDataFrame(pixels, "batch int, image int, px int, py int, depth double, conf double")
    cams = spark.createDataFrame([(1, 1, eye, [0.0, 0.0, 0.0]), (1, 2, eye, [-2.0, 0.0, 0.0]), (1, 3, eye, [0.0, 0.0, -99.0])], "batch int, image int, r array<double>, t array<double>").select("*", *[F.lit(v).alias(n) for n, v in (("fx", 10.0), ("fy", 10.0), ("cx", 5.0), ("cy", 5.0))])
    got = {(r.src, r.dst): r.share for r in reprojection_overlap(px, cams, w, h).collect()}
    assert got[(1, 2)] == pytest.approx(0.6) and got[(2, 1)] == pytest.approx(0.6) and got[(1, 3)] == 0 and got[(3, 1)] == 0
    v = valid_pixels(px.withColumn("conf", F.col("px").cast("double")), q=0.3)
    assert {r.px for r in v.select("px").distinct().collect()} == set(range(3, 10))


def test_depth_ratios_and_robust_regression(spark):
    a = [(1, x, y, 4.0 * (1 + 0.01 * ((x + y) % 3 - 1))) for x in range(10) for y in range(10)] + [(2, 0, 0, 1.0)]
    b = [(1, x, y, 2.0) for x in range(10) for y in range(10)] + [(2, 0, 0, 1.0)]
    make = lambda r: spark.createDataFrame(r, "image int, px int, py int, depth double")
    got = log_depth_ratios(make(a), make(b)).collect()
    assert len(got) == 1 and got[0]["median"] == pytest.approx(np.log(2)) and got[0].n == 100 and 0.01 < got[0].spread < 0.02
    rows = []
    for g, (m, c) in enumerate(((2.0, 1.0), (-0.5, 3.0))):
        for k in range(60):
            x = k / 10
            rows.append((g, x, m * x + c + (50.0 if k % 10 == 0 else 0.001 * (k % 3))))
    f = {r.g: (r.b0, r.b1) for r in robust_regression(spark.createDataFrame([*rows, (0, None, 1.0)], "g int, x double, y double"), "g", F.col("y"), [F.col("x"), F.lit(1.0)], rounds=5).collect()}
    assert f[0] == pytest.approx((2.0, 1.0), abs=0.05) and f[1] == pytest.approx((-0.5, 3.0), abs=0.05)


def test_attention_and_guided_matching(spark):
    m = spark.createDataFrame([(1, 0, 1, q, 2, k, v) for q, k, v in ((0, 0, 0.1), (0, 1, 0.3), (1, 0, 0.2), (1, 1, 0.0))], "batch int, head int, i int, query int, j int, key int, value double")
    r = pooled_attention(m).first()
    assert (r["mean"], r.top, r.peak) == (pytest.approx(0.3), pytest.approx(0.4), 0.3)
    xy = RNG.uniform(0, 1000, (200, 2))
    t = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(xy)], "pair int, t int, x double, y double")
    q = spark.createDataFrame([(1, k, float(p[0] + 3), float(p[1] - 2)) for k, p in enumerate(xy[:40])], "pair int, q int, x double, y double")
    got = guided_candidates(q, t, 150.0, 5)
    found = {}
    for r in got.collect():
        found.setdefault(r.q, {})[r["rank"]] = (r.t, r.px_distance)
    for k in range(40):
        d = np.hypot(*(xy - xy[k] - [3, -2]).T)
        order = [j for j in np.lexsort((np.arange(200), d)) if d[j] <= 150][:5]
        assert [found[k][i + 1][0] for i in range(len(order))] == order
    kept = {r.q for r in ratio_test(got, ["pair", "q"], "t", "px_distance").collect()}
    assert kept == {k for k, v in found.items() if 2 in v and v[1][1] < 0.85 * v[2][1]}
