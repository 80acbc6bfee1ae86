"""Registered queries against their SQL; ALL_QUERIES=1 runs every one of them."""

import os

import duckdb
import pytest

from argusframe.plans.all_queries import ORACLES, QUERIES
from checkrun import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = """
proximity_flags anomaly_fighting anomaly_robbery anomaly_vandalism sudden_stops
detection_events reconstruct_events video_summary motion_events track_spans digest_items
person_convergence vehicle_collision disappearances saved_searches overview_stats
upsert_recordings fps_consistency duplicate_runs nms_mixed match_models fuse_detections
frame_interval_sample marker_clusters prune_overlaps nal_segments dvr_frame_scan
unallocated_blocks signature_match candidate_audit stream_sessions
""".split()
NAMES = list(ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cur = sql.execute(ORACLES[name])
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got_cols == want_cols
    assert got == want


def test_every_query_is_registered_once_and_most_have_sql():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "carve_streams", "track_centroid", "track_entities", "track_open_vocab", "stream_tracks",
    }
