"""Fits between frames, views of points, covers, blocks and cells on small data with known results."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from skyweave.operators import covis, estimators, frames, keyed
from skyweave.operators.cloud import median_cells, nearest_of_set
from skyweave.operators.covis import shared_counts
from skyweave.operators.frames import fit_from_cameras, merge_by_positions, merge_frames, place_images
from skyweave.operators.graph import farthest_seeds_cover, hop_pairs
from skyweave.operators.matching import average_rotations
from skyweave.operators.metrics import spread_stats
from skyweave.operators.pairs import met_among
from skyweave.operators.spatial import near_pairs, near_places
from skyweave.operators.views import bilinear, early_stop
from skyweave.plans import fits
from skyweave import session
from skyweave.session import Growing, clear_scratch, materialise_counted, scratch_path, shared_dir


def turn(v):
    th = np.linalg.norm(v)
    if th < 1e-12:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / th
    return np.eye(3) + math.sin(th) * k + (1 - math.cos(th)) * k @ k


def moved(m, r, c):
    s, rot, t = m
    return r @ rot.T, s * rot @ c + t


def inverse(m):
    s, rot, t = m
    return 1 / s, rot.T, -rot.T @ t / s


def cameras(rng, n):
    return [(turn(rng.normal(size=3)), rng.normal(size=3) * 20) for _ in range(n)]


KINDS = "rd array<double>, cd array<double>, rs array<double>, cs array<double>"


@pytest.mark.parametrize("with_ratios", [True, False])
def test_similarity_of_frames_leaves_outliers_out(spark, with_ratios):
    rng = np.random.default_rng(3)
    known, rows = {}, []
    for link in range(3):
        m = known[link] = (rng.uniform(0.5, 3), turn(rng.normal(size=3)), rng.normal(size=3) * 9)
        for k, (r, c) in enumerate(cameras(rng, 12)):
            rd, cd = moved(m, r, c)
            if k == 0:
                rd, cd = turn(np.array([0.4, 0, 0])) @ rd, cd + 40
            rows.append((link, rd.ravel().tolist(), cd.tolist(), r.ravel().tolist(), c.tolist()))
    rows.append((7, *[rows[1][k] for k in range(1, 5)]))  # one camera: its scale is the ratio's, or 1
    ratios = spark.createDataFrame([(link, math.log(m[0]) + d) for link, m in known.items() for d in (-0.1, 0.0, 0.1)] + [(7, math.log(known[0][0]))], "link int, v double") if with_ratios else None
    got = {r.link: r for r in fit_from_cameras(spark.createDataFrame(rows, f"link int, {KINDS}"), "link", ratios).collect()}
    assert set(got) == {0, 1, 2, 7}
    for link, (s, rot, t) in known.items():
        assert (got[link].n, got[link].inliers) == (12, 11)
        assert got[link].m.s == pytest.approx(s) and got[link].m.r == pytest.approx(rot.ravel().tolist()) and got[link].m.t == pytest.approx(t.tolist())
    assert got[7].m.s == pytest.approx(known[0][0] if with_ratios else 1.0)


def clusters(rng):
    world = cameras(rng, 30)
    held = {5: range(0, 14), 3: range(10, 20), 9: range(17, 30), 4: range(25, 30)}
    frames = {k: (rng.uniform(0.5, 2), turn(rng.normal(size=3)), rng.normal(size=3) * 5) for k in held}
    rows, depths = [], []
    for k, images in held.items():
        for i in images:
            r, c = moved(inverse(frames[k]), *world[i])
            rows.append((k, i, r.ravel().tolist(), c.tolist()))
            depths += [(k, i, p, (3.0 + p) / frames[k][0]) for p in range(2)]
    return world, frames, rows, depths


def test_clusters_are_merged_down_the_tree(spark):
    world, frames, rows, depths = clusters(np.random.default_rng(8))
    rows.append((77, 900, rows[0][2], rows[0][3]))  # shares no image
    members = spark.createDataFrame(rows, "cluster int, image int, r array<double>, c array<double>")
    merged = merge_frames(members, spark.createDataFrame(depths, "cluster int, image int, pixel int, depth double"))
    assert {r.cluster: r.depth for r in merged.collect()} == {5: 0, 3: 1, 9: 2, 4: 3}
    s, rot, t = frames[5]
    for r in place_images(members, merged).collect():
        assert s * rot @ np.array(r.c) + t == pytest.approx(world[r.image][1], abs=1e-6)


def test_clusters_are_placed_by_positions_and_lines_by_gimbals(spark):
    rng = np.random.default_rng(2)
    world, frames, rows, _ = clusters(rng)
    line = [(turn(rng.normal(size=3)), np.array([k * 3.0, 0.0, 0.0])) for k in range(6)]
    frames[50] = (1.5, turn(np.array([0.1, 0.2, 0.3])), np.ones(3))
    for k, (r, c) in enumerate(line):
        a, b = moved(inverse(frames[50]), r, c)
        rows.append((50, 100 + k, a.ravel().tolist(), b.tolist()))
    at = [(k, c.tolist(), r.ravel().tolist()) for k, (r, c) in enumerate(world)] + [(100 + k, c.tolist(), r.ravel().tolist()) for k, (r, c) in enumerate(line)]
    members = spark.createDataFrame(rows, "cluster int, image int, r array<double>, c array<double>")
    positions = spark.createDataFrame(at, "image int, g array<double>, rg array<double>")
    got = {r.cluster: r for r in merge_by_positions(members, positions, rounds=1).collect()}
    assert {k: r.collinear for k, r in got.items()} == {5: False, 3: False, 9: False, 4: False, 50: True}
    for k, (s, rot, t) in frames.items():
        assert got[k].m.s == pytest.approx(s) and got[k].m.r == pytest.approx(rot.ravel().tolist(), abs=1e-6) and got[k].m.t == pytest.approx(t.tolist(), abs=1e-5)
    assert merge_by_positions(members, positions.drop("rg"), rounds=1).filter("cluster = 50").first().m is None


def test_rotations_settle_or_say_so(spark):
    rng = np.random.default_rng(1)
    true = [turn(rng.normal(size=3)) for _ in range(12)]
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12) if (j - i) in (1, 2, 5)]
    edges = [(i, j, (turn(np.array([0, 0, 1.0])) if (i, j) == (0, 1) else np.eye(3)) @ true[j] @ true[i].T) for i, j in pairs]
    e = spark.createDataFrame([(i, j, m.ravel().tolist()) for i, j, m in edges], "i int, j int, rij array<double>")
    start = spark.createDataFrame([(k, (turn(rng.normal(size=3) * 0.03) @ r).ravel().tolist()) for k, r in enumerate(true)] + [(99, np.eye(3).ravel().tolist())], "node int, r array<double>")
    got = {r.node: np.array(r.r).reshape(3, 3) for r in average_rotations(e, start, tolerance_deg=0.05).collect()}
    for i, j in pairs:
        assert np.trace(got[j] @ got[i].T @ (true[j] @ true[i].T).T) > 1 + 2 * math.cos(math.radians(1.0))
    assert set(got) == {*range(12), 99}
    with pytest.raises(RuntimeError):
        average_rotations(e, start, max_rounds=2)


@pytest.mark.parametrize("few", [1_000, 0])
def test_nearest_of_a_set(spark, few):
    rng = np.random.default_rng(6)
    p, t = rng.normal(size=(200, 3)) * 30, np.vstack([rng.normal(size=(40, 3)) * 10, [[500.0, 0, 0]]])
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "k int, x double, y double, z double")
    targets = spark.createDataFrame([tuple(map(float, x)) for x in t], "x double, y double, z double")
    got = {r.k: r.d for r in nearest_of_set(points, targets, "k", ["x", "y", "z"], few=few).collect()}
    assert got == pytest.approx({k: float(np.linalg.norm(t - x, axis=1).min()) for k, x in enumerate(p)})
    assert nearest_of_set(points, targets.limit(0), "k", ["x", "y", "z"]).count() == 0


@pytest.mark.parametrize("block", [1000, 7])
def test_heavy_points_are_counted_in_blocks(spark, block):
    rng = random.Random(4)
    obs = [(0, m) for m in range(40)] + [(rng.randrange(1, 9), rng.randrange(40)) for _ in range(120)] + [(None, 3), (3, None)]
    seen = {}
    for p, m in obs:
        if p is not None and m is not None:
            seen.setdefault(p, set()).add(m)
    expect = {}
    for ms in seen.values():
        for i in ms:
            for j in ms:
                if i < j:
                    expect[i, j] = expect.get((i, j), 0) + 1
    df = spark.createDataFrame(obs, "point_id int, image_id int")
    assert {(r.i, r.j): r.shared for r in shared_counts(df, block=block).collect()} == expect


def test_no_task_of_a_heavy_point_holds_more_than_a_block_pair(spark, monkeypatch):
    monkeypatch.setattr(covis, "BLOCK_IMAGES", 25)
    df = spark.range(400).select(F.lit(1).alias("point_id"), F.col("id").alias("image_id"))
    counted = shared_counts(df)
    assert counted.count() == 400 * 399 // 2
    assert "blocks" in counted._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_that_met(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (None, 10), (3, None)], "g int, m int")
    pairs = spark.createDataFrame([(10, 11), (10, 12), (11, 12), (10, 99)], "i int, j int")
    assert {tuple(r) for r in met_among(pairs, members, "g", "m").collect()} == {(10, 11), (11, 12)}


def test_cells_of_equal_positions_are_split(spark):
    same = spark.createDataFrame([(k, 1.0, 2.0) for k in range(200)], "id int, x double, y double")
    sizes = [r["count"] for r in median_cells(same, "id", "x", "y", 64).groupBy("cell").count().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 64
    with pytest.raises(RuntimeError):
        median_cells(same, "id", "x", "y", 1, max_rounds=2)


def test_cover_equals_the_one_by_one_choice(spark):
    rng = random.Random(9)
    sets = {b: {rng.randrange(60) for _ in range(rng.randrange(1, 12))} for b in range(40)}
    left, expect = {k: set(v) for k, v in sets.items()}, []
    while any(left.values()):
        best = max(left, key=lambda b: (len(left[b]), -b))
        gone = set(left[best])
        expect.append((len(expect), best, len(gone)))
        left = {k: v - gone for k, v in left.items()}
    df = spark.createDataFrame([(b, n) for b, ns in sets.items() for n in ns], "ball int, node int")
    assert sorted(map(tuple, farthest_seeds_cover(df).collect())) == expect
    assert farthest_seeds_cover(df.limit(0)).count() == 0


def test_long_chains_are_searched_to_the_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "i int, j int")
    got = hop_pairs(chain, spark.createDataFrame([(0,), (40,)], "node int")).collect()
    assert {(r.source, r.node): r.hops for r in got} == {(s, k): abs(k - s) for s in (0, 40) for k in range(41)}


def test_one_place_is_not_a_pair_of_all(spark):
    rows = [(f"a{k:03d}", 10.0, 20.0) for k in range(300)] + [("b", 10.00001, 20.0), ("c", 10.0, 20.00002), ("far", -5.0, 1.0), ("none", None, 3.0)]
    df = spark.createDataFrame(rows, "name string, lat double, lon double")
    members, pairs = near_places(df, "name", "lat", "lon", 5.0)
    members, pairs = members.collect(), pairs.collect()
    place = {r.key: r.place for r in members}
    assert len(members) == 303 and len(set(place.values())) == 4 and len(pairs) == 3
    near = {frozenset((r.place_a, r.place_b)) for r in pairs}
    full = {(r.key_a, r.key_b) for r in near_pairs(df, "name", "lat", "lon", 5.0).collect()}
    assert {(a, b) for a in place for b in place if a < b and (place[a] == place[b] or frozenset((place[a], place[b])) in near)} == full


def test_missing_groups_keep_their_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r.g: (r.n, r.median) for r in spread_stats(df, "g", "v").collect()} == {None: (2, 2.0), "a": (1, 5.0)}


def test_grids_and_early_stops(spark):
    grid = spark.createDataFrame([(1, x, y, float(x + 10 * y)) for x in range(3) for y in range(3) if (x, y) != (2, 2)], "image int, ix long, iy long, value double")
    q = spark.createDataFrame([(1, 0, 0.5, 0.25), (1, 1, 1.5, 1.5), (1, 2, 2.5, 0.0), (2, 3, 0.5, 0.5)], "image int, q int, gx double, gy double")
    assert {r.q: r.value for r in bilinear(q, grid).collect()} == {0: 3.0, 1: None, 2: None, 3: None}
    losses = [(1, k, 100.0 * 0.8**k) for k in range(20)] + [(2, k, [9, 8, 7, 6, 5, 5, 5, 5, 5, 5, 5, 5, 5][k] * 1.0) for k in range(13)] + [(3, 0, 1.0)]
    got = {r.g: r.step for r in early_stop(spark.createDataFrame(losses, "g int, step int, v double"), "g", "step", "v").collect()}
    assert got == {2: 11}


def test_written_rounds_and_their_folder(spark):
    g = Growing(spark, "test")
    assert g.append(spark.range(3).toDF("x")) == 3 and g.append(spark.range(0).toDF("x")) == 0
    assert g.read().count() == 3 and g.part(-1).count() == 0 and g.part(0).count() == 3
    df, n = materialise_counted(spark.range(7).toDF("x"), "test")
    assert n == df.count() == 7
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and callable(clear_scratch)


@pytest.mark.parametrize("query", [fits.planted_gimbals, fits.planted_links, fits.planted_positions, fits.planted_merge])
def test_frames_of_known_queries_need_no_large_plan(spark, sf, monkeypatch, query):
    """What a query writes first is its frames; the driver holds their plan several times over."""
    first = []

    def written(df, label):
        first.append(df)
        raise InterruptedError(label)

    monkeypatch.setattr(fits, "materialise", written)
    with pytest.raises(InterruptedError, match="two-frames|clusters"):
        query(spark, sf)
    assert len(first[0]._jdf.queryExecution().analyzed().toString()) < 100_000


@pytest.mark.parametrize("query", [fits.planted_positions, fits.planted_links])
def test_heavy_groups_do_not_multiply_the_plan(spark, sf, monkeypatch, query):
    """Lookups on lookups with heavy keys: every written plan names few tables, and the rows are those without heavy keys."""
    plain = sorted(query(spark, sf).collect())
    named = []

    def spy(module):
        write = module.materialise

        def written(df, label):
            named.append(df._jdf.queryExecution().analyzed().toString().count("Relation ["))
            return write(df, label)

        monkeypatch.setattr(module, "materialise", written)

    for module in (estimators, fits, frames):
        spy(module)
    monkeypatch.setattr(keyed, "HEAVY_ROWS", 5)
    assert sorted(query(spark, sf).collect()) == plain
    assert max(named) <= 12


def test_links_are_fitted_in_few_plans(spark, sf):
    """The driver's memory grows with the plans that it makes: how many there are, and their joins and exchanges together."""
    bus = spark.sparkContext._jsc.sc().listenerBus()

    def known():
        bus.waitUntilEmpty(60_000)
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in map(found.apply, range(found.size()))}

    before = known()
    assert fits.planted_links(spark, sf).count() == 3
    plans = [p for k, p in known().items() if k not in before]
    assert 10 < len(plans) <= 24
    assert sum(len(re.findall(r"^\(\d+\) \w*(?:Join|Exchange)\b", p, re.M)) for p in plans) <= 200


def test_a_deep_tree_is_merged_in_few_rounds(spark, monkeypatch):
    """A chain of 30 clusters under the largest one, and a chain apart: as many rounds as the depth has digits, twice."""
    rng = np.random.default_rng(4)
    world = cameras(rng, 200)
    held = {k: range(3 * k, 3 * k + 6) for k in range(1, 31)} | {0: [3, 4, 5, *range(190, 196)]} | {k: range(3 * k, 3 * k + 6) for k in range(50, 53)}
    frames_of = {k: (rng.uniform(0.5, 2), turn(rng.normal(size=3)), rng.normal(size=3) * 5) for k in held}
    rows = [(k, i, r.ravel().tolist(), c.tolist()) for k, images in held.items() for i in images for r, c in [moved(inverse(frames_of[k]), *world[i])]]
    members = spark.createDataFrame(rows, "cluster int, image int, r array<double>, c array<double>")
    written = []
    path = session.scratch_path

    def named(spark, label):
        written.append(label)
        return path(spark, label)

    save = DataFrameWriter.parquet
    monkeypatch.setattr(session, "scratch_path", named)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **k: written.append(to) or save(self, to, *a, **k))
    merged = merge_frames(members)
    rounds = [x for x in written if x.startswith("/") or ":" in x]
    got = {r.cluster: r for r in merged.collect()}
    assert {k: r.depth for k, r in got.items()} == {k: k for k in range(31)}
    s, rot, t = frames_of[0]
    for r in place_images(members, merged).collect():
        assert s * rot @ np.array(r.c) + t == pytest.approx(world[r.image][1], abs=1e-5)
    assert sum("/merge" in x or "/tour" in x for x in rounds) <= 25
