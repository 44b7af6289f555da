import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import geo, pose, vec
from skyweave.operators.cloud import median_cells, mutual_matches, voxel_counts, voxel_representative, voxel_size_for
from skyweave.operators.estimators import SIMILARITY, flight_offsets, line_fit, mean_rotation, robust_similarity_fit, similarity_fit, triangulate
from skyweave.operators.spatial import nearest_points

RNG = np.random.default_rng(7)


def rotations(n):
    q = RNG.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    w, x, y, z = q.T
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    return q, r.transpose(2, 0, 1)


def one(df, *columns):
    return [df.select(c.alias("c")).first().c for c in columns]


def test_rotations_and_transforms(spark):
    q, r = rotations(6)
    t = RNG.normal(size=(6, 3))
    v = RNG.normal(size=(6, 3)) * 0.7
    rows = [(*map(float, 3 * q[k]), r[k].ravel().tolist(), t[k].tolist(), v[k].tolist()) for k in range(6)]
    df = spark.createDataFrame(rows, "w double, x double, y double, z double, r array<double>, t array<double>, v array<double>")
    m = pose.similarity(F.lit(2.5), F.col("r"), F.col("t"))
    out = df.select(
        pose.rotation_of_quaternion(F.col("w"), F.col("x"), F.col("y"), F.col("z")).alias("a"), pose.rotation_of_quaternion(*pose_columns()).alias("b"), pose.centre(F.col("r"), F.col("t")).alias("c"),
        pose.angle_deg(F.col("r")).alias("angle"), pose.rotation_of_vector(F.col("v")).alias("e"),
        pose.apply_similarity(pose.compose_similarity(m, pose.invert_similarity(m)), F.col("v")).alias("same"), pose.apply_similarity(m, F.col("v")).alias("moved"),
    ).collect()
    for k, o in enumerate(out):
        assert np.allclose(o.a, r[k].ravel()) and np.allclose(o.b, r[k].ravel()) and np.allclose(o.c, -r[k].T @ t[k])
        assert o.angle == pytest.approx(np.degrees(np.arccos(np.clip((np.trace(r[k]) - 1) / 2, -1, 1))))
        e = np.array(o.e).reshape(3, 3)
        assert np.allclose(e @ e.T, np.eye(3)) and np.allclose(e @ v[k], v[k]) and np.linalg.det(e) == pytest.approx(1)
        assert np.allclose(o.same, v[k]) and np.allclose(o.moved, 2.5 * r[k] @ v[k] + t[k])


def test_expressions_of_nested_steps_stay_small(spark):
    r, t = pose.move_pose(F.col("m"), F.col("r"), F.col("t"))
    assert len(str(pose.centre(r, t))) < 20_000  # every number once held all numbers of the step before: millions
    rb, tb = pose.relative(F.col("r"), F.col("t"), r, t)
    assert len(str(pose.centre(rb, tb))) < 100_000


def pose_columns():
    q = pose.quaternion_of_rotation(F.col("r"))
    return [F.get(q, F.lit(k)) for k in range(4)]


def test_projection_gimbal_and_lenses(spark):
    df = spark.createDataFrame([(np.eye(3).ravel().tolist(), [0.0] * 3, [1.0, 2.0, z]) for z in (4.0, -4.0)], "r array<double>, t array<double>, x array<double>")
    p = pose.project(F.col("r"), F.col("t"), F.col("x"), F.lit(100.0), F.lit(200.0), F.lit(5.0), F.lit(6.0))
    got = df.select(p.alias("p"), pose.reprojection_error(p, F.lit(30.0), F.lit(106.0)).alias("e")).collect()
    assert (got[0].p.u, got[0].p.v, got[0].e) == (30.0, 106.0, 0.0) and got[1].p.u is None and got[1].e == float("inf")
    g = np.array(one(spark.range(1), pose.rotation_of_gimbal(F.lit(90.0), F.lit(-90.0)))[0]).reshape(3, 3)
    assert np.allclose(g @ g.T, np.eye(3)) and np.allclose(g[2], [0, 0, -1], atol=1e-12) and np.linalg.det(g) == pytest.approx(1)
    k = spark.createDataFrame([("SIMPLE_RADIAL", [9.0, 4.0, 3.0, 0.1]), ("PINHOLE", [9.0, 8.0, 4.0, 3.0])], "m string, p array<double>").select(pose.intrinsics(F.col("m"), F.col("p")).alias("k")).collect()
    assert tuple(k[0].k) == (9.0, 9.0, 4.0, 3.0) and tuple(k[1].k) == (9.0, 8.0, 4.0, 3.0)


def test_vectors_and_geodesy(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vec.norm("a").alias("n"), vec.cosine("a", "b").alias("c"), vec.distance("a", "b").alias("d"), vec.unit("a").alias("u"), vec.root_unit("b").alias("h"), vec.power_mean("b").alias("g"), vec.finite("a", 2).alias("f")).collect()
    assert (got[0].n, got[0].u, got[0].f) == (5.0, [0.6, 0.8], True) and got[0].c == pytest.approx(0.96) and got[0].d == pytest.approx(2**0.5)
    assert got[1].c is None and got[1].u == [0.0, 0.0] and got[1].f is False and np.allclose(got[0].h, np.sqrt([4 / 7, 3 / 7]))
    x, y, z = one(spark.range(1), *geo.ecef(F.lit(0.0), F.lit(90.0), F.lit(10.0)))
    assert abs(x) < 1e-6 and y == pytest.approx(6378147.0) and abs(z) < 1e-6
    e, n, u = one(spark.range(1), *geo.enu(F.lit(50.00001), F.lit(8.0), F.lit(5.0), F.lit(50.0), F.lit(8.0), F.lit(0.0)))
    assert abs(e) < 1e-6 and n == pytest.approx(1.112, abs=1e-3) and u == pytest.approx(5.0, abs=1e-5)


def test_similarities_are_recovered(spark):
    rows, truth = [], {}
    for g in range(3):
        _, r = rotations(1)
        s, t = RNG.uniform(0.5, 3), RNG.normal(size=3) * 100
        truth[g] = (s, r[0], t)
        src = RNG.normal(size=(40, 3)) * [5, 4, 3] + 1e4
        dst = s * src @ r[0].T + t
        if g == 2:
            dst[:6] += 50
        rows += [(g, *map(float, src[k]), *map(float, dst[k])) for k in range(40)]
    rows += [(9, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0), (0, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, x double, y double, z double")
    plain = {r.g: r for r in similarity_fit(df, "g", list("abc"), list("xyz")).collect()}
    robust = {r.g: r for r in robust_similarity_fit(df, "g", list("abc"), list("xyz"), rounds=3).collect()}
    for g, fits in ((0, plain), (1, plain), (0, robust), (1, robust), (2, robust)):
        s, r, t = truth[g]
        f = [fits[g][c] for c in SIMILARITY]
        assert f[0] == pytest.approx(s, rel=1e-6) and np.allclose(f[1:10], r.ravel(), atol=1e-6) and np.allclose(f[10:], t, atol=0.1)
    assert np.isnan(plain[9].s)


def test_mean_rotation_lines_and_offsets(spark):
    _, r = rotations(1)
    rows = []
    for k in range(30):
        w = RNG.normal(size=3) * 0.05
        th = np.linalg.norm(w)
        a = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / th
        rows.append(("g", ((np.eye(3) + np.sin(th) * a + (1 - np.cos(th)) * a @ a) @ r[0]).ravel().tolist()))
    m = mean_rotation(spark.createDataFrame([*rows, ("g", None)], "g string, r array<double>"), "g", "r").first()
    got = np.array([m[f"r{k}"] for k in range(9)]).reshape(3, 3)
    assert m.n == 30 and np.allclose(got @ got.T, np.eye(3)) and np.degrees(np.arccos((np.trace(got.T @ r[0]) - 1) / 2)) < 2
    line = line_fit(spark.createDataFrame([(1, float(x), 3.0 * x + 2) for x in range(5)], "g int, x double, y double"), "g", F.col("x"), F.col("y")).first()
    assert line.slope == pytest.approx(3) and line.intercept == pytest.approx(2) and line.r2 == pytest.approx(1)
    shift = {"a": 0.0, "b": 2.5, "c": -1.0}
    data = [(c, f, 100.0 * c + o) for c in range(6) for f, o in shift.items() for _ in range(3 if f == "a" else 2)]
    assert {r.f: round(r.offset, 1) for r in flight_offsets(spark.createDataFrame(data, "c int, f string, v double"), "c", "f", "v", step=1e-4).collect()} == shift


def test_triangulation_is_the_inverse_of_projection(spark):
    rows, points = [], RNG.normal(size=(8, 3))
    _, rs = rotations(5)
    for k, r in enumerate(rs):
        t = np.array([0, 0, 8.0]) + RNG.normal(size=3) * 0.3
        for p, x in enumerate(points):
            c = r @ x + t
            if (p + k) % 5:
                rows.append((p, float(c[0] / c[2]), float(c[1] / c[2]), r.ravel().tolist(), t.tolist()))
    rows.append((99, 0.1, 0.1, rs[0].ravel().tolist(), [0.0, 0.0, 1.0]))
    df = spark.createDataFrame(rows, "track int, u double, v double, r array<double>, t array<double>")
    got = {r.track: (r.x, r.y, r.z) for r in triangulate(df, "track", F.col("u"), F.col("v"), "r", "t").collect()}
    assert all(np.allclose(got[p], x, atol=1e-6) for p, x in enumerate(points)) and np.isnan(got[99][0])


def test_voxels_and_cells(spark):
    x = RNG.uniform(-50, 50, (300, 3))
    x[:40] = x[0]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "id int, x double, y double, z double")
    occupied = {tuple(np.floor(p / 10).astype(int)) for p in x}
    assert voxel_counts(df, ["x", "y", "z"], 10.0).count() == len(occupied) and voxel_representative(df, "id", ["x", "y", "z"], 10.0).count() == len(occupied)
    size = voxel_size_for(df, ["x", "y", "z"], 100, 0.1, 100.0, rounds=8)
    assert voxel_counts(df, ["x", "y", "z"], size).count() <= 100
    cells = median_cells(df, "id", "x", "y", 30).collect()
    sizes = np.unique([c.cell for c in cells], return_counts=True)[1]
    assert len(cells) == 300 and sizes.max() <= 30


def test_mutual_matches_in_blocks(spark):
    a, b = RNG.normal(size=(60, 8)), RNG.normal(size=(50, 8))
    b[:30] = a[:30] + 0.05 * RNG.normal(size=(30, 8))
    rows = lambda m: [(1, k, v.tolist()) for k, v in enumerate(m)] + [(2, 500, [1.0] * 8)]
    make = lambda m: spark.createDataFrame(rows(m), "g int, id long, v array<double>")
    ua, ub = (m / np.linalg.norm(m, axis=1)[:, None] for m in (a, b))
    d = np.sqrt(np.maximum(2 - 2 * ua @ ub.T, 0))
    two = np.sort(d, axis=1)[:, :2]
    expect = {(i, int(d[i].argmin())) for i in range(60) if d[:, d[i].argmin()].argmin() == i and two[i, 0] < 0.85 * two[i, 1]}
    for block in (2048, 16):
        got = mutual_matches(make(a), make(b), "g", "id", "v", block=block).collect()
        assert {(r.a, r.b) for r in got} == expect and len(got) == len(expect) and {r.g for r in got} == {1}


@pytest.mark.parametrize("cell_rows", [4000, 10])
def test_nearest_points_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(2)
    rows = [(f"n{k:03d}", float(50 + rng.normal() * 1e-3), float((180 + rng.normal() * 1e-3 + 180) % 360 - 180)) for k in range(120)]
    rows += [(f"dup{k}", 50.0, -180.0) for k in range(15)] + [("lone", -70.0, 10.0), (None, 1.0, 1.0), ("bad", None, 1.0)]
    got = {}
    for r in nearest_points(spark.createDataFrame(rows, "k string, a double, o double"), "k", "a", "o", 3, cell_rows=cell_rows).collect():
        got.setdefault(r.key, {})[r["rank"]] = r.other
    good = [r for r in rows if r[0] is not None and r[1] is not None]
    at = geo.ecef_array(np.array([r[1] for r in good]), np.array([r[2] for r in good]))
    for i, r in enumerate(good):
        d = np.round(np.linalg.norm(at - at[i], axis=1), 6)
        order = sorted((j for j in range(len(good)) if j != i), key=lambda j: (d[j], good[j][0]))[:3]
        assert [got[r[0]][k] for k in (1, 2, 3)] == [good[j][0] for j in order]
