import pytest
from oracle import compare

from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLES[name]) == []
