"""Vector search against brute force, with copies, ties and unusable vectors."""

from dataclasses import replace

import numpy as np
import pytest

from skyweave.llm.vectors import IndexParams, brute_force, most_similar, valid_vectors

P = IndexParams(dim=16, cells=12, probes=8, words=16, books=4, block_rows=64, rerank=48)


def table(spark, seed=4, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, 16))
    x *= rng.uniform(0.5, 30, (n, 1))
    x[100:130] = x[100]
    rows = [(k, [float(np.float32(v)) for v in x[k]], 1) for k in range(n)]
    rows += [(k, [0.0] * 16, 0) for k in range(50)]  # older rows of the same keys
    bad = [None, [], [1.0] * 15, [1.0] * 17, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    rows += [(2000 + k, v, 1) for k, v in enumerate(bad)] + [(None, [1.0] * 16, 1)] + rows[:5]
    return spark.createDataFrame([(*r, 9) for r in rows], "id long, vec array<float>, at int, cell int"), x.astype(np.float32)


def lists(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=1)[:, :k]
    return order, s


@pytest.mark.parametrize("params", [P, replace(P, max_first=4)])
def test_recall_and_exact_similarities(spark, params):
    """With one word, and with two, naming a cell."""
    df, x = table(spark)
    got = most_similar(df, "id", "vec", 5, params, at="at").collect()
    order, s = lists(x, 5)
    assert len(got) == len({(r.id, r.other) for r in got})
    assert all(r.id != r.other and abs(r.sim - s[r.id, r.other]) < 2e-6 for r in got)
    truth = {(i, int(j)) for i in range(len(x)) for j in order[i]}
    assert len(truth & {(r.id, r.other) for r in got}) / len(truth) >= 0.9
    # equal vectors: the five smallest other ids
    mine = {k: [r.other for r in sorted((r for r in got if r.id == k), key=lambda r: r["rank"])] for k in (100, 129)}
    assert mine == {100: [101, 102, 103, 104, 105], 129: [100, 101, 102, 103, 104]}


def test_stated_queries_and_brute_force_agree(spark):
    df, x = table(spark)
    some = most_similar(df, "id", "vec", 5, P, at="at", queries="id % 50 = 0").collect()
    assert {r.id for r in some} == set(range(0, 600, 50))
    exact = {(r.id, r.other, r.sim) for r in brute_force(valid_vectors(df, "id", "vec", 16, "at"), 5, 16, "id % 50 = 0").collect()}
    assert len(exact & {(r.id, r.other, r.sim) for r in some}) >= 0.9 * len(exact)
    order, _ = lists(x, 5)
    assert {(i, o) for i, o, _ in exact} == {(i, int(j)) for i in range(0, 600, 50) for j in order[i]}


def test_least_similarity_and_tiny_inputs(spark):
    df, _ = table(spark, n=160)
    assert all(r.sim >= 0.93 for r in most_similar(df, "id", "vec", 3, P, at="at", min_sim=0.93).collect())
    assert most_similar(df.limit(0), "id", "vec", 3, P).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 16)], "id long, vec array<float>")
    assert most_similar(one, "id", "vec", 3, P).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 16), (2, [1.0] * 16)], "id long, vec array<float>")
    assert {(r.id, r.other, r.sim) for r in most_similar(two, "id", "vec", 3, P).collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
