"""Every registered query equals its DuckDB oracle on the smallest test tables
(tools/check_oracle.py runs the same comparison at any scale)."""

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, compare
from tradelens.plans.catalog import queries
from tradelens.plans.oracle import WITHOUT_SQL, oracle_sql

KEYS = sorted(set(queries()) - WITHOUT_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = queries()[key](spark, SF_SMALL)
    rel = duck.sql(oracle_sql()[key])
    res = compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), rel.columns)
    assert res in ("OK", "APPROX"), res
