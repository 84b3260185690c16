"""The queries of the training problems run on the small tables; those with SQL equal it."""

import pytest

from folioscope.llm import queries
from tests.conftest import DATA
from tests.test_audit import normal


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, oracle, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert got.columns.is_unique
    if name in queries.SQL:
        wanted = oracle.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns) and normal(got) == normal(wanted)
