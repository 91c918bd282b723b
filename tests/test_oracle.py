"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from linkstream.plans.registry import load_all
from tests.conftest import SF01
from tests.oracle_check import compare, duck_connection

REG = load_all()
WITH_ORACLE = sorted(n for n, q in REG.items() if q.oracle)
ROWS_ONLY = sorted(n for n, q in REG.items() if not q.oracle)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF01)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_matches_oracle(spark, con, name):
    q = REG[name]
    n, problems = compare(spark, con, name, q.build, q.oracle, SF01)
    assert not problems, problems


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    assert REG[name].build(spark, SF01).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["short_code", "long_url", "total_clicks", "rank"]
    assert set(E.oracle_sql()) <= set(E.queries())
