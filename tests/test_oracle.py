import pytest
from oracle import compare, connect

from tabulara.plans import dealt, dealt_sql, results, results_sql

QUERIES = dealt.queries() | results.queries()
SQL = dealt_sql.oracle_sql() | results_sql.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf, name):
    compare(spark, con, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows and any(v is not None for v in rows[0])


def test_entry_imports_without_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
