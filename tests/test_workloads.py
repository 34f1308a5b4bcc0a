"""Every query of the star schema against its SQL in DuckDB."""

import os

import duckdb
import pytest

from factloom import workloads

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", workloads.QUERIES)
def test_workload(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.execute(workloads.SQL[name]).df(), workloads.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda d: sorted(repr([round(float(x), 4) if isinstance(x, (int, float)) else str(x) for x in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert plain(got) == plain(want)
