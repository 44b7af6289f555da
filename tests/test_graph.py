import heapq
import random

import pytest

from skyweave.operators.graph import build_tracks, component_sizes, components, farthest_seeds_cover, hops, max_product_paths, place_by_rank, spanning_forest, walk_back


def graph(seed=3, n=60, m=90):
    rng = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            edges[(min(a, b), max(a, b))] = rng.randrange(1, 20) / 20
    return [(a, b, w) for (a, b), w in edges.items()]


def labels(nodes, edges):
    p = {x: x for x in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b, *_ in edges:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_components_with_chains_and_lone_nodes(spark):
    edges = [*graph(), *[(k, k + 1, 1.0) for k in range(100, 160)], (7, 7, 1.0)]
    df = spark.createDataFrame(edges, "i int, j int, w double")
    got = components(df, nodes=spark.createDataFrame([(500,), (None,)], "node int"))
    expect = labels({x for a, b, _ in edges for x in (a, b) if a != b} | {500}, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in got.collect()} == expect
    assert {r["size"] for r in component_sizes(got).filter("component = 100").collect()} == {61}
    assert components(df.limit(0)).count() == 0


def test_hops_and_paths(spark):
    edges = graph()
    df = spark.createDataFrame(edges, "i int, j int, w double")
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    dist, layer = {0: 0, 1: 0}, [0, 1]
    while layer:
        layer = [y for x in layer for y, _ in near.get(x, []) if y not in dist and not dist.update({y: dist[x] + 1})]
    source = spark.createDataFrame([(0,), (1,), (None,)], "node int")
    assert {r.node: r.hops for r in hops(df, source).collect()} == dist
    best, heap = {}, [(-1.0, 0), (-1.0, 1)]
    while heap:
        w, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = -w
        for y, v in near.get(x, []):
            if -w * v >= 0.05 and y not in best:
                heapq.heappush(heap, (w * v, y))
    paths = max_product_paths(df, source, "w", min_weight=0.05)
    got = {r.node: r for r in paths.collect()}
    assert {k: pytest.approx(v) for k, v in best.items()} == {k: r.weight for k, r in got.items()}
    walked = {}
    for r in walk_back(paths, paths.select("node")).collect():
        walked.setdefault(r.target, {})[r.step] = r.node
    assert set(walked) == set(got)
    for target, steps in walked.items():
        assert steps[max(steps)] == target and steps[0] == got[target].source and len(steps) == got[target].hops + 1


def test_spanning_forest_equals_greedy(spark):
    edges = graph(8, 40, 110) + [(200, 201, 0.5)]
    got = spanning_forest(spark.createDataFrame(edges, "i int, j int, w double"), "w").collect()
    tree, p = set(), {x: x for a, b, _ in edges for x in (a, b)}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = find(a), find(b)
        if x != y:
            p[x] = y
            tree.add((a, b))
    assert {(r.i, r.j) for r in got} == tree and len(got) == len(tree)


def test_tracks_are_dropped_whole(spark):
    m = [(1, 1, 2, 1), (2, 1, 3, 4), (1, 2, 2, 2), (2, 2, 1, 3), (5, 0, 5, 0), (None, 1, 2, 9)]
    got = build_tracks(spark.createDataFrame(m, "a int, fa int, b int, fb int"), "a", "fa", "b", "fb").collect()
    assert {(r.image_id, r.feat_id) for r in got} == {(1, 1), (2, 1), (3, 4)} and len({r.track_id for r in got}) == 1


def test_cover_and_placement(spark):
    sets = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (2, 4), (3, 5), (4, 4), (4, 3)], "ball int, node int")
    assert [(r.ball, r.gain) for r in farthest_seeds_cover(sets).orderBy("round").collect()] == [(2, 3), (1, 1), (3, 1)]
    df = spark.createDataFrame([(1, 3, "a"), (1, -1, "b"), (1, None, "c"), (2, None, "d")], "k int, h int, c string")
    assert {(r.k, r.c) for r in place_by_rank(df, "k", ["h", "c"]).collect()} == {(1, "b"), (2, "d")}
