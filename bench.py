"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (space-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

from argusframe.plans.all_queries import QUERIES
from argusframe.sources.session import local_session

HEADLINE = """
proximity_flags anomaly_assault anomaly_fighting anomaly_robbery anomaly_road_accident
anomaly_crowd anomaly_vandalism ego_looming sudden_stops detection_events track_kinematics
person_convergence vehicle_collision reconstruct_events track_spans disappearances
search_events saved_searches overview_stats evidence_nested upsert_recordings
integrity_score_penalty duplicate_runs nms_mixed match_models fuse_detections
marker_clusters nal_segments dvr_frame_scan signature_match track_centroid
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cpus)
    # the first query also pays for starting Python and compiling; that is nobody's time
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
