"""Top-n, caps and groups against plain Python on small, awkward inputs."""

import math
import random
from collections import Counter, defaultdict

import pytest

from skyweave.llm import caps
from skyweave.llm.caps import cap_contributors, water_level
from skyweave.llm.groups import connected_groups
from skyweave.llm.topn import LoserTree, top_n_per_group


def missing(v):
    return v is None or (isinstance(v, float) and math.isnan(v))


def order(r):
    _, score, *ties = r
    return (missing(score), 0 if missing(score) else -score, *[(t is None, t or 0) for t in ties])


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for width in (1, 2, 3, 7, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(width)]
        tree, got = LoserTree(runs), []
        while tree.head[tree.winner] is not None:
            got.append(tree.head[tree.winner])
            tree.advance(tree.at[tree.winner] + 1)
        assert got == sorted(x for r in runs for x in r)


def awkward(seed=2, n=700):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g = 7 if rng.random() < 0.4 else rng.choice([None, *range(25)])
        s = rng.choice([None, float("nan"), float("inf"), -1.5, *[x / 4 for x in range(12)]])
        rows.append((g, s, rng.choice([None, *range(30)]), rng.choice(["a", "b", None])))
    return rows + rows[:40]


@pytest.mark.parametrize("n", [1, 3, 1000])
@pytest.mark.parametrize("keep_missing", [True, False])
def test_top_n_with_nulls_ties_and_repeats(spark, n, keep_missing):
    rows = awkward()
    df = spark.createDataFrame([(*r, 1) for r in rows], "bucket int, s double, t0 int, rank string, run int").repartition(5)
    got = defaultdict(list)
    for r in top_n_per_group(df, "bucket", "s", ["t0", "rank"], n, buckets=3, keep_missing=keep_missing).collect():
        got[r[0]].append((r[4], r[:4]))
    expect = defaultdict(list)
    for r in rows:
        if keep_missing or not missing(r[1]):
            expect[r[0]].append(r)
    assert set(got) == set(expect)
    for g, members in expect.items():
        best = sorted(members, key=lambda r: (missing(r[1]), 0 if missing(r[1]) else -r[1], r[2] is None, r[2] or 0, r[3] is None, r[3] or ""))[:n]
        assert [k for k, _ in sorted(got[g], key=lambda x: x[0])] == list(range(1, len(best) + 1))
        assert [tuple(None if missing(v) else v for v in r) for _, r in sorted(got[g], key=lambda x: x[0])] == [tuple(None if missing(v) else v for v in r) for r in best]


def test_top_n_of_text_groups_and_of_nothing(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("", 2.0, 1), (None, 3.0, 2), ("x", 1.0, 0)], "g string, s double, t int")
    assert {(r.g, r.t, r["rank"]) for r in top_n_per_group(df, "g", "s", ["t"], 1).collect()} == {("x", 0, 1), ("", 1, 1), (None, 2, 1)}
    assert top_n_per_group(df.limit(0), "g", "s", ["t"], 1).count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", "s", ["t"], 0)


@pytest.mark.parametrize("counts,share", [([100, 50, 3, 2, 1], 0.3), ([10] * 10, 0.1), ([1000, 1, 1], 0.4), ([1000, 1, 1], 0.2), ([7, 7, 7, 90, 300, 2], 0.25), ([5], 1.0)])
def test_water_level_is_the_largest_that_holds(spark, counts, share):
    got = water_level(spark.createDataFrame([(c,) for c in counts], "n int"), max_share=share)
    holds = [c for c in range(1, max(counts) + 1) if c <= share * sum(min(n, c) for n in counts) + 1e-9]
    assert got == (max(holds) if holds else 1)


def test_water_level_of_counts_and_of_nothing(spark):
    df = spark.createDataFrame([(9,), (3,)], "n int")
    assert water_level(df, max_count=5) == 5 and water_level(df, max_count=50) == 9 and water_level(df.limit(0), max_share=0.5) == 0
    for bad in ({"max_count": 0}, {"max_share": 0.0}, {"max_share": 1.5}):
        with pytest.raises(ValueError):
            water_level(df, **bad)


@pytest.mark.parametrize("direct", [1000, 1])
def test_caps_either_way_of_ranking(spark, direct):
    rows = [r[:3] for r in awkward(5)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "g int, q double, t0 int, level int").repartition(6)
    got = cap_contributors(df, "g", "q", ["t0"], max_count=12, direct_level=direct).collect()
    sizes = Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in got:
        assert r.capped == (sizes[r.g] > 12) and r.level == 12
        by[r.g].append((r["rank"], (r.g, r.q, r.t0)))
    for g in sizes:
        best = sorted((r for r in rows if r[0] == g), key=order)[:12]
        assert [k for k, _ in sorted(by[g], key=lambda x: x[0])] == list(range(1, len(best) + 1))
        assert [tuple(None if missing(v) else v for v in r) for _, r in sorted(by[g], key=lambda x: x[0])] == [tuple(None if missing(v) else v for v in r) for r in best]
    assert cap_contributors(df.limit(0), "g", "q", ["t0"], max_share=0.5, direct_level=direct).count() == 0


def test_caps_need_a_limit(spark):
    with pytest.raises(ValueError):
        cap_contributors(spark.createDataFrame([(1, 1.0, 1)], "g int, q double, t int"), "g", "q", ["t"])
    assert caps.DIRECT_LEVEL >= 1


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


def shapes():
    rng = random.Random(9)
    chain = [(k, k + 1) for k in range(1000, 1150)]
    shuffled = list(range(2000, 2100))
    rng.shuffle(shuffled)
    long_chain = list(zip(shuffled, shuffled[1:], strict=False))
    hub = [(5000, 5001 + k) for k in range(300)] + [(9999, 6000 + k) for k in range(300)]
    loose = [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    return chain + long_chain + hub + loose + [(7, 7), (8, 8), (8, 9), (-3, 4), (4, -3), (-3, 4)]


def test_groups_equal_union_find(spark, monkeypatch):
    from skyweave.operators import keyed

    monkeypatch.setattr(keyed, "HEAVY_ROWS", 50)
    monkeypatch.setattr(keyed, "HEAVY_KEYS", 20)
    pairs = shapes()
    df = spark.createDataFrame([*[(a, b, 0) for a, b in pairs], (None, 3, 0), (3, None, 0), (None, None, 0)], "u long, v long, component int")
    got = connected_groups(df, "u", "v").collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == union_find(pairs)


def test_groups_of_nothing_and_too_few_rounds(spark):
    assert connected_groups(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    assert {tuple(r) for r in connected_groups(spark.createDataFrame([(5, 5)], "a int, b int"), "a", "b").collect()} == {(5, 5)}
    with pytest.raises(RuntimeError):
        connected_groups(spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int"), "a", "b", max_rounds=1)


@pytest.mark.parametrize("kind,values", [("bigint", [9007199254740993, 9007199254740992, 9007199254740995, None, -(2**63) + 1]), ("decimal(38,3)", None), ("int", [3, 3, -5, None, 2])])
def test_scores_keep_their_type(spark, kind, values):
    from decimal import Decimal

    values = values or [Decimal("12345678901234567890123456789.001"), Decimal("12345678901234567890123456789.002"), Decimal("-0.001"), None, Decimal("12345678901234567890123456789.000")]
    df = spark.createDataFrame([(1, v, k) for k, v in enumerate(values)], f"g int, s {kind}, t int").repartition(3)
    got = top_n_per_group(df, "g", "s", ["t"], 3)
    assert got.schema["s"].dataType == df.schema["s"].dataType
    best = sorted(range(len(values)), key=lambda k: (values[k] is None, -(values[k] or 0), k))[:3]
    assert [(r.s, r.t) for r in got.orderBy("rank").collect()] == [(values[k], k) for k in best]


def test_top_n_refuses_scores_that_are_not_numbers(spark):
    with pytest.raises(ValueError):
        top_n_per_group(spark.createDataFrame([("a", "b", 1)], "g string, s string, t int"), "g", "s", ["t"], 1)


def test_buckets_follow_the_rows(spark, monkeypatch):
    from skyweave.llm import topn

    monkeypatch.setattr(topn, "BUCKET_ROWS", 100)
    df = spark.range(5000).selectExpr("id % 997 as g", "cast(id as int) as s", "id as t").repartition(6)
    found = top_n_per_group(df, "g", "s", ["t"], 2)
    assert found.rdd.getNumPartitions() >= 19
    expect = {(g, s) for g in range(997) for s in sorted(range(g, 5000, 997))[-2:]}
    assert {(r.g, r.s) for r in found.collect()} == expect
