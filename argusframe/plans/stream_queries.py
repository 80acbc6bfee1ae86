"""Streaming runs over the event files, drained once; closed windows only."""

from pyspark.sql import functions as F

from argusframe.checks.events_sql import DEV
from argusframe.checks.views import DET
from argusframe.plans import incident_queries as IQ
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X
from argusframe.streaming import live as L

# append mode emits a window once the watermark, ten seconds behind the newest row, passed it
_DONE = "(SELECT max(us) - 10000000 FROM det)"


def _stream(spark, sf):
    return X.detections_of(X.event_stream(spark, sf))


def _drained(spark, stream, name):
    out = L.scratch(spark, name)
    L.run_once(stream, out, L.scratch(spark, f"{name}-checkpoint"))
    return spark.read.parquet(out)


@query(
    "stream_sessions",
    f"""WITH {DEV} SELECT video_id, camera_id, object_type, track_id, start_time, end_time, detection_count, confidence FROM dev
    WHERE epoch_us(end_time) + 3000001 <= {_DONE}""",
    "confidence",
)
def stream_sessions(spark, sf):
    return _drained(spark, L.live_sessions(_stream(spark, sf)), "sessions")


@query(
    "stream_counts",
    f"""WITH {DET} SELECT make_timestamp(us - us % 60000000) AS window_start, camera_id, object_type, count(*) AS n FROM det
    WHERE us - us % 60000000 + 60000000 <= {_DONE} GROUP BY ALL""",
)
def stream_counts(spark, sf):
    return _drained(spark, L.live_counts(_stream(spark, sf)), "counts")


@query(
    "stream_proximity",
    f"SELECT video_id, camera_id, frame_number, start_time, event_type, track_a, track_b FROM ({IQ.PROXIMITY_SQL})",
)
def stream_proximity(spark, sf):
    return _drained(spark, L.live_proximity(_stream(spark, sf), _stream(spark, sf)), "proximity")


@query("stream_tracks")
def stream_tracks(spark, sf):
    """Live tracks; the tests compare them with the batch tracker."""
    return _drained(spark, L.live_tracks(_stream(spark, sf), fps=4.0), "tracks")


@query(
    "stream_upsert",
    """WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
    SELECT user_id, event_id, event_type, value FROM r WHERE rn=1""",
    "value",
)
def stream_upsert(spark, sf):
    rows = X.event_stream(spark, sf).select("user_id", "event_id", "event_type", "value")
    path = L.scratch(spark, "upserts")
    L.run_upserts(rows, path, L.scratch(spark, "upserts-checkpoint"))
    return L.read_upserts(spark, path, ["user_id"], ["event_id"])
