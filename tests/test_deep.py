"""The octree below the levels that the registered SQL is unrolled to."""

import duckdb

from stratapoint.plans import catalog
from stratapoint.plans.bridge import lod_sql


def test_the_tree_is_whole_below_the_unrolled_levels(spark, tmp_path):
    """One far point makes the cube wide, so that the others share a node down to level 7 and go on below it."""
    con = duckdb.connect()
    near = "select event_id, date_trunc('day', ts)::timestamp as ts, user_id, event_type, value, props from '/root/testdata/sf0.01/events.parquet'"
    con.execute(f"copy ({near} union all select 10000, ts, 200000, event_type, 200000, props from ({near}) where event_id = 0) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    rows = lambda sql: sorted(con.execute(sql).fetchall())
    deep = lambda name: catalog.oracle_sql()[name].replace(lod_sql(), lod_sql(16))
    for name in ("lod_assign", "hierarchy_nodes", "node_fill", "order_file"):
        got = sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
        assert got == rows(deep(name)), name
    points = rows(deep("lod_assign"))
    assert len(points) == 10_001 and max(p[1] for p in points) > 7
    assert len(rows(catalog.oracle_sql()["lod_assign"])) < 10_001  # the SQL as registered loses those
