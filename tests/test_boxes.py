"""Fusion of rows whose ids repeat, against the SQL of the query."""

import os

import duckdb
import pytest

from argusframe.plans.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
def test_fusion_equals_its_sql_where_the_models_share_ids(spark, tmp_path):
    con = duckdb.connect()
    con.execute(
        f"COPY (SELECT * REPLACE (event_id % 400 + 1000000 * (event_id // 400) AS event_id) FROM read_parquet('{SF}/events.parquet')"
        f" WHERE event_id < 800) TO '{tmp_path}/events.parquet'"
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    # rows of two frames that share an id tie, so their order is left out
    names = ["video_id", "camera_id", "frame_number", "det_id", "object_type", "verified"]
    cur = con.execute(ORACLES["fuse_detections"])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    want = sorted((*(r[at[n]] for n in names), sorted(r[at["sources"]].split("|"))) for r in cur.fetchall())
    rows = QUERIES["fuse_detections"](spark, str(tmp_path)).collect()
    got = sorted((*(r[n] for n in names), sorted(r["sources"].split("|"))) for r in rows)
    assert len({r[3] for r in got}) < len(got)
    assert got == want
