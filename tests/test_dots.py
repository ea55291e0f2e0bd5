"""Events at one place: segments without length, against the SQL."""

import duckdb
import pytest
from test_queries import key

from plansheet.plans import catalog


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Five events of a user, of which the second and third are 997 numbers apart and so at one place."""
    d = tmp_path_factory.mktemp("dots")
    rows = ", ".join(f"({k}, timestamp '2024-01-01 00:00:0{i}', 7, {v}::double)" for i, (k, v) in enumerate([(1, 3.5), (2, 8.25), (999, 8.25), (1000, 8.25), (1003, 40.0)]))
    duckdb.sql(f"copy (select * from (values {rows}) v(event_id, ts, user_id, value)) to '{d}/events.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["sca16_segment_measures", "sca30_bulge_arcs", "src6_gcode", "stf1_modal_state"])
def test_segment_without_length(spark, folder, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert len(want) in (1, 4)
    assert sorted(tuple(map(key, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(key, r)) for r in want)
