import pytest

from oracle import same
from skyweave.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, llm.queries()[name], llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf, name):
    assert llm.queries()[name](spark, sf).count() > 0
