import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from argusframe.sources.session import local_session  # noqa: E402

T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


DETECTION = (
    "det_id BIGINT, video_id STRING, camera_id STRING, frame_number BIGINT, ts TIMESTAMP, "
    "object_type STRING, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, "
    "track_id BIGINT, vx DOUBLE, vy DOUBLE"
)


@pytest.fixture
def detections(spark):
    """Rows of (frame, seconds, class, box, track[, velocity[, confidence]]) as detections."""

    def make(rows, video="v", camera="CH-01"):
        out = []
        for i, r in enumerate(rows):
            frame, sec, cls, box, track = r[:5]
            vx, vy = r[5] if len(r) > 5 else (0.0, 0.0)
            conf = r[6] if len(r) > 6 else 0.9
            out.append(
                (i, video, camera, frame, T0 + dt.timedelta(seconds=sec), cls, conf,
                 *(float(b) for b in box), track, float(vx), float(vy))
            )
        return spark.createDataFrame(out, DETECTION)

    return make
