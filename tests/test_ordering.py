import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave import session
from skyweave.operators import ordering
from skyweave.operators.ordering import grouped_quantile, positions_in_group, running_totals, with_index
from skyweave.operators.sequences import consecutive_runs, run_means, steps, sweep_windows


def rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(k, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *[x / 2 for x in range(20)]])) for k in range(n)]


def test_index_and_totals_over_a_global_order(spark):
    df = spark.createDataFrame(rows(), "id int, g string, v double").repartition(7)
    got = sorted(with_index(df, [F.col("id").desc()]).collect(), key=lambda r: r.idx)
    assert [r.id for r in got] == list(range(399, -1, -1)) and [r.idx for r in got] == list(range(400))
    run = {r.id: r.upto for r in running_totals(df, [F.col("id")], {"upto": F.when(F.col("id") % 3 == 0, F.col("id"))}).collect()}
    assert all(run[k] == sum(x for x in range(k + 1) if x % 3 == 0) for k in run)
    assert with_index(df.limit(0), [F.col("id")]).count() == 0


def test_places_in_groups(spark):
    data = rows()
    got = positions_in_group(spark.createDataFrame(data, "id int, g string, v double").repartition(5), "g", [F.col("id")]).collect()
    for g in {r[1] for r in data}:
        members = [r[0] for r in data if r[1] == g]
        assert {r.id: r.pos for r in got if r.g == g} == {k: i for i, k in enumerate(members)}
        assert {r["size"] for r in got if r.g == g} == {len(members)}


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_quantiles_of_groups(spark, q):
    data = rows(301, 5)
    got = {r.g: r.q for r in grouped_quantile(spark.createDataFrame(data, "id int, g string, v double"), "g", "v", q).collect()}
    for g in {r[1] for r in data}:
        v = [r[2] for r in data if r[1] == g and r[2] is not None and r[2] == r[2]]
        assert got[g] == pytest.approx(np.quantile(v, q))


def test_quantiles_write_one_table_and_meet_groups_of_many_partitions(spark, monkeypatch):
    written = []
    path = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda spark, label: written.append(label) or path(spark, label))
    monkeypatch.setattr(ordering, "shuffle_width", lambda spark: 9)
    rng = random.Random(4)
    inf = float("inf")
    data = [("hot", rng.choice([rng.random(), 0.5, -inf])) for _ in range(3000)] + [("same", 7.0)] * 500 + [(None, float(k)) for k in range(40)] + [(f"g{k}", float(k)) for k in range(300)] + [("end", inf)]
    df = spark.createDataFrame(data, "g string, v double")
    for q in (0.0, 0.25, 0.5, 0.75, 1.0):
        got = {r.g: r.q for r in grouped_quantile(df, "g", "v", q).collect()}
        assert set(got) == {g for g, _ in data} and got["end"] != got["end"]  # between infinities
        for g in ("hot", "same", None, "g0", "g299"):
            v = sorted(x for h, x in data if h == g)
            at = (len(v) - 1) * q
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert got[g] == pytest.approx(low + (high - low) * (at - math.floor(at)), nan_ok=True)
    assert written == ["ordering"] * 5


def test_windows_runs_steps(spark):
    data = [(g, k) for g, n in (("a", 19), ("b", 5), ("c", 12), ("d", 8)) for k in range(n)]
    df = spark.createDataFrame(data, "g string, k int")
    got = {}
    for r in sweep_windows(df, "g", [F.col("k")]).collect():
        got.setdefault((r.g, r.window), {})[r.slot] = r.k
    starts = {g: sorted(v[0] for (h, _), v in got.items() if h == g) for g in "abcd"}
    assert starts == {"a": [0, 4, 8, 11], "b": [0], "c": [0, 4], "d": [0]}
    assert all(len(v) == (5 if g == "b" else 8) and sorted(v) == list(range(len(v))) for (g, _), v in got.items())
    runs = consecutive_runs(spark.createDataFrame([("x", k) for k in (1, 2, 3, 3, 7, 9, 10, None)], "g string, k int"), "g", "k").collect()
    assert {(r.first, r.last, r.n) for r in runs} == {(1, 3, 3), (7, 7, 1), (9, 10, 2)}
    assert {(r.k, r.prev_k) for r in steps(df.filter("g = 'b'"), "g", [F.col("k")], ["k"]).collect()} == {(k, k - 1) for k in range(1, 5)}
    assert {(r.start, r["mean"]) for r in run_means(df.filter("g = 'b'"), "g", [F.col("k")], "k").collect()} == {(0, 1.0), (1, 2.0), (2, 3.0)}
