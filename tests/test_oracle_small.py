"""Every registered query with an oracle agrees with DuckDB on sf0.001."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_check import duck, rows_of

SQLS = entry.oracle_sql()
QUERIES = entry.queries()
SLOW = {"silver_partitions", "anomaly_partitions"}  # thousands of partition directories


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in SQLS if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(SQLS[name])
    cols = [d[0] for d in res.description]
    d_rows = rows_of(cols, res.fetchall())
    assert sorted(sdf.columns) == sorted(cols)
    assert s_rows == d_rows


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["type", "cnt", "avg_weight_t", "percentage"]
