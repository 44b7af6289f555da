import math

import pytest

import __spark_entry__ as entry
from oracle import same
from skyweave.plans import registry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_sound_rows(spark, sf, name):
    """Rows come out, none twice, and all of their numbers but missing ones are finite."""
    got = registry.queries()[name](spark, sf).collect()
    assert got and len(got) == len({tuple(map(str, r)) for r in got})
    assert all(v is None or not isinstance(v, float) or math.isfinite(v) for r in got for v in r)
