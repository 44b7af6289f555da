"""Whole plans on small tables whose results are known."""

import datetime

import numpy as np
import pytest

from skyweave.plans import evaluation, flows, geometry, graph_edges, graphs, reports

DAY = datetime.datetime(2024, 1, 1)


def test_sequences_across_the_date_line_keep_all_photos(spark, tmp_path):
    line = [("w/s_1.jpg", 179.9999), ("w/s_2.jpg", -179.9999), ("s_3.jpg", 180.0), ("s_4.jpg", -180.0), ("t_1.jpg", 8.0), ("t_2.jpg", 8.0002)]
    spark.createDataFrame([(n, [0.0, lon, 50.0], DAY) for n, lon in line], "names string, lla array<double>, received_at timestamp_ntz").write.parquet(str(tmp_path / "gps.parquet"))
    got = {r.name: (r.e, r.n) for r in geometry.geodetic_enu(spark, str(tmp_path)).collect()}
    step = np.radians(1e-4) * 6378137.0
    expect = {"s_1.jpg": -step, "s_2.jpg": step, "s_3.jpg": 0.0, "s_4.jpg": 0.0, "t_1.jpg": -step, "t_2.jpg": step}
    assert set(got) == set(expect)
    assert all(got[n] == pytest.approx((e, 0.0), abs=2e-3) for n, e in expect.items())


def test_upserts_let_the_latest_win_though_it_is_not_finite(spark, tmp_path):
    late = DAY + datetime.timedelta(hours=1)
    rows = [(1, 2, 0.5, DAY), (1, 2, float("nan"), late), (1, 3, float("inf"), DAY), (1, 4, 0.25, DAY), (1, 4, float("-inf"), late), (2, 1, float("nan"), DAY), (2, 1, 0.75, late), (2, 3, None, DAY), (2, 4, 2.0**101, DAY), (3, 3, 0.5, DAY)]
    spark.createDataFrame(rows, "image_id int, other_id int, score float, updated_at timestamp_ntz").write.parquet(str(tmp_path / "camera_connections.parquet"))
    got = {(r.image_id, r.other_id): r.score for r in flows.stream_upserts(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): None, (1, 3): None, (1, 4): None, (2, 1): 0.75, (2, 3): None, (2, 4): 2.0**101}


def test_tracks_behind_cameras_far_off_or_of_parallel_rays_are_dropped(spark, tmp_path):
    xs = {1: 0.0, 2: 0.75, 3: -0.75, 4: 10.0}  # cameras that look along z; 0.75 at a depth of 100 is 0.43 degrees
    xs |= {5: -0.01, 6: 0.0, 7: 0.0}
    ys = dict.fromkeys(xs, 0.0) | {6: 0.6, 7: -0.6}  # of 5, 6 and 7 only the last two are 1 degree apart, and 5 has the greatest ray
    spark.createDataFrame([(k, 1.0, 0.0, 0.0, 0.0, -x, -ys[k], 0.0, 1, f"s_{k}.jpg") for k, x in xs.items()], "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string").write.parquet(str(tmp_path / "images.parquet"))
    spark.read.parquet(str(tmp_path / "images.parquet")).limit(0).write.parquet(str(tmp_path / "anchor_images.parquet"))
    at = {1: (0.0, 100.0, (1, 4)), 2: (0.0, -100.0, (1, 4)), 3: (0.0, 100.0, (1, 2)), 4: (0.0, 50.0, (1, 2, 3)), 5: (0.0, 100.0, (1, 2, 4)), 6: (0.0, 50.0, (1, 2)), 7: (0.0, 50.0, (5, 6, 7)), 8: (0.0, 50.0, (5, 6))}
    rows = [(t, i, 10 * t + i, 3000.0 * (x - xs[i]) / z + 2000.0, 1500.0 - 3000.0 * ys[i] / z + (900.0 if (t, i) == (5, 2) else 0.0), 0.5, DAY) for t, (x, z, seen) in at.items() for i in seen]
    spark.createDataFrame(rows, "track_id long, obs_img int, obs_feat int, x double, y double, conf double, logged_at timestamp_ntz").write.parquet(str(tmp_path / "track_obs.parquet"))
    got = {r.track_id: (r.x, r.y, r.z) for r in geometry.triangulated_tracks(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4, 7}  # 2 is behind, 3, 6 and 8 have narrow rays, 5 has a view that is far off
    assert all(got[t] == pytest.approx((at[t][0], 0.0, at[t][1]), abs=1e-6) for t in got)
    assert {(r.track_id, r.obs_img) for r in reports.reprojection_filter(spark, str(tmp_path)).collect()} == {(1, 1), (1, 4), (4, 1), (4, 2), (4, 3), (7, 5), (7, 6), (7, 7)}


def test_hops_go_on_to_the_end_of_a_chain(spark, tmp_path):
    rows = [(10 * k + n, i) for k in range(8) for n in range(3) for i in (k, k + 1)]  # images 0 to 8, neighbours share 3 tracks
    spark.createDataFrame(rows, "track_id long, obs_img int").write.parquet(str(tmp_path / "track_obs.parquet"))
    spark.createDataFrame([(0,)], "image_id int").write.parquet(str(tmp_path / "anchor_images.parquet"))
    assert {r.node: r.hops for r in graphs.hop_distance(spark, str(tmp_path)).collect()} == {k: k for k in range(9)}


@pytest.mark.parametrize("query", [evaluation.rotation_accuracy, evaluation.overlap_percentiles, graph_edges.health_gate])
def test_quantiles_do_not_gather_a_group_in_one_task(spark, sf, query):
    plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan.replace("AS median", "")
