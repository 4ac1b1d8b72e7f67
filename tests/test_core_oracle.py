"""Every query with SQL agrees with DuckDB on the driver's small tables."""

import glob
import os

import duckdb
import pytest

from tokenlake.plans import decoder_queries, file_queries, queries

SF = "/root/testdata/sf0.001"


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v).replace(" 00:00:00", "") for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL | decoder_queries.ORACLE_SQL | file_queries.ORACLE_SQL))
def test_query(spark, duck, name):
    all_, sql = queries.QUERIES | decoder_queries.QUERIES | file_queries.QUERIES, queries.ORACLE_SQL | decoder_queries.ORACLE_SQL | file_queries.ORACLE_SQL
    mine, theirs = all_[name](spark, SF).toPandas(), duck.sql(sql[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)
