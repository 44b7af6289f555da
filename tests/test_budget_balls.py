import random
from collections import Counter

import pytest

from skyweave.operators.budget import track_budget
from skyweave.operators.graph import balls


def one_by_one(rows, budget):
    images = {}
    for t, m in set(rows):
        if t is not None and m is not None:
            images.setdefault(t, set()).add(m)
    seen, kept = Counter(), set()
    for t in sorted(images, key=lambda t: (-len(images[t]), t)):
        if any(seen[m] < budget for m in images[t]):
            seen.update(images[t])
            kept |= {(t, m) for m in images[t]}
    return kept


@pytest.mark.parametrize("seed, budget", [(1, 4), (2, 1)])
def test_budget_is_that_of_the_single_choices(spark, seed, budget):
    rng = random.Random(seed)
    # image 0 is in a third of the rows
    rows = [(rng.randrange(120), rng.choice([0, rng.randrange(12), rng.randrange(12)])) for _ in range(420)]
    rows += [(None, 3), (4, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "point_id long, image_id int")
    got = [tuple(r) for r in track_budget(df, "point_id", "image_id", budget).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(rows, budget)


def test_budget_limits(spark):
    empty = spark.createDataFrame([], "point_id long, image_id int")
    assert track_budget(empty, "point_id", "image_id", 3).count() == 0
    with pytest.raises(ValueError):
        track_budget(empty, "point_id", "image_id", 0)


def ball(neighbours, source, size):
    out, layer = [source], [source]
    places = {source: (0, 0)}
    depth = 0
    while layer and len(out) < size:
        depth += 1
        new = {x for y in layer for x in neighbours.get(y, ())} - set(out)
        held = set(out)
        layer = sorted(new, key=lambda x: (-len(neighbours[x] & held), x))[: size - len(out)]
        for x in layer:
            places[x] = (depth, len(places))
        out += layer
    return places


def test_balls_against_single_searches(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(50, 51), (51, 52), (52, 53), (53, 50), (None, 4), (7, 7)]
    neighbours = {}
    for a, b in edges:
        if a is not None and a != b:
            neighbours.setdefault(a, set()).add(b)
            neighbours.setdefault(b, set()).add(a)
    df = spark.createDataFrame(edges + edges[:5], "i int, j int")
    sources = [0, 3, 50, 99]
    got = balls(df, spark.createDataFrame([(s,) for s in [*sources, 3, None]], "node int"), 8).collect()
    assert len(got) == len({(r.source, r.node) for r in got})
    for s in sources:
        assert {r.node: (r.layer, r.place) for r in got if r.source == s} == ball(neighbours, s, 8)
    assert balls(df.limit(0), spark.createDataFrame([], "node int"), 8).count() == 0
