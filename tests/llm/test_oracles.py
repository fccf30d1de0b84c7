import pytest
from duck import assert_same

from fedframe.llm import queries


@pytest.mark.parametrize("name", ["op1_secrets", "op10_quality"])
def test_query_equals_sql(name, spark, sf):
    assert_same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_one_query_for_each_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.queries()) == list(range(1, 11))
