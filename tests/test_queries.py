"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import glob
import os

import pytest

from stratapoint.plans import catalog, files

SF = "/root/testdata/sf0.001"
assert files  # registers its queries
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, query in catalog.queries().items():
        mine, theirs = query(spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns), name
        order = sorted(mine.columns)
        rows = lambda d: sorted(map(tuple, d[order].values.tolist()), key=lambda r: [(v is None, 0 if v is None else v) for v in r])
        assert rows(mine) == rows(theirs), name


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "query_box_lod" in e.queries()
