"""Every query with SQL equals its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SQL = entry.oracle_sql()
CORE = [n for n in SQL if not n.startswith(("p2_", "p5_", "p6_", "p7_", "p8_"))]


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if x is None or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, oracle, name):
    got, wanted = entry.queries()[name](spark, DATA).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert normal(got) == normal(wanted)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['folioscope.llm'] = None\nimport importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('folioscope.llm') else f(n, *a)\nimport __spark_entry__ as e; assert e.queries() and not any(n.startswith('p2_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
