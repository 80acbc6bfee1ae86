import datetime as dt
import random

import pytest

from argusframe.operators import activity as A, search as Q, trajectories as TJ
from tests.conftest import T0

EVENT = (
    "event_id BIGINT, video_id STRING, camera_id STRING, event_type STRING, start_time TIMESTAMP, "
    "end_time TIMESTAMP, confidence DOUBLE, track_id BIGINT, object_type STRING, case_id BIGINT"
)


def events(spark, rows):
    """Rows of (start, end, class, confidence, track)."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    return spark.createDataFrame(
        [
            (i, "v", "CH-01", (c or "MOTION").upper(), at(s), at(e), f, t, c, 1)
            for i, (s, e, c, f, t) in enumerate(rows)
        ],
        EVENT,
    )


def test_noise_is_dropped_by_minimum_observations(detections):
    rows = [(1, 0, "person", (0, 0, 10, 20), 9)] + [
        (f, f * 1.0, "person", (50, 50, 80, 120), 1) for f in (10, 11, 12)
    ]
    det = detections(rows)
    assert A.detection_events(det).count() == 2
    kept = A.detection_events(det, min_observations=2, min_duration_s=1.0).collect()
    assert [(r.track_id, r.detection_count, r.entity_id) for r in kept] == [(1, 3, "person#1")]


def test_gap_bound_is_inclusive_and_sessions_cross_slices(detections):
    times = [0, 3, 6.000001, 9, 12, 15.1, 15.2]
    det = detections([(i, t, "car", (0, 0, 10, 10), 1) for i, t in enumerate(times)])
    for width in (4, 7, 900):
        got = A.detection_events(det, slice_seconds=width).orderBy("start_time").collect()
        assert [r.detection_count for r in got] == [2, 3, 2], width


def test_slice_width_never_changes_a_result(spark, detections):
    rng = random.Random(3)
    t, rows = 0.0, []
    for f in range(160):
        t += rng.choice([0.2, 0.5, 2.9, 3.0, 3.2, 11.0])
        for k in range(2):
            rows.append((f, t, "person", (rng.randint(0, 200), 50, rng.randint(201, 400), 150), k, (rng.choice([0, 30]), 0)))
    det = detections(rows)
    ev = events(spark, [(i * 1.3, i * 1.3 + rng.random() * 6, rng.choice(["person", "car", None]), rng.random(), i % 3) for i in range(120)])
    same = lambda make, widths: len({str(sorted(map(str, make(w).collect()))) for w in widths}) == 1
    assert same(lambda w: A.detection_events(det, slice_seconds=w).select("start_time", "detection_count", "last_frame"), (5, 31, 9000))
    assert same(lambda w: A.velocity_backfill(det, w).select("det_id", "ivx"), (3, 50, 9000))
    assert same(lambda w: A.interval_islands(ev, slice_seconds=w), (2, 17, 9000))
    assert same(lambda w: A.reconstruct_events(ev, slice_seconds=w), (2, 17, 9000))
    assert same(lambda w: Q.disappearances(ev, slice_seconds=w), (2, 17, 9000))


def test_island_compares_with_the_row_before_not_the_longest(spark):
    ev = events(spark, [(0, 100, "car", 0.9, 1), (1, 2, "car", 0.9, 2), (6, 7, "car", 0.9, 3)])
    assert sorted(r.event_count for r in A.interval_islands(ev).collect()) == [1, 2]


@pytest.mark.parametrize(
    "rows, kind",
    [
        ([(0, 1, "car", 0.7, 1), (2, 3, "bus", 0.8, 2)], "POSSIBLE_VEHICLE_INTERACTION"),
        ([(0, 1, "car", 0.7, 1), (1, 3, "person", 0.8, 2)], "PERSON_VEHICLE_ACTIVITY"),
        ([(0, 1, "backpack", 0.7, 1), (1, 3, "person", 0.8, 2)], "PERSON_OBJECT_ACTIVITY"),
        ([(0, 1, None, 0.7, 1)], "MOTION_ACTIVITY"),
        ([(0, 1, "dog", 0.7, 1)], "GENERAL_ACTIVITY"),
        ([(0, 0.1, "car", 0.7, 1), (2, 3, "bus", 0.8, 2)], "GENERAL_ACTIVITY"),
    ],
)
def test_activity_rules(spark, rows, kind):
    assert [r.event_type for r in A.reconstruct_events(events(spark, rows)).collect()] == [kind]


def test_motion_closes_only_on_a_late_quiet_sample(spark):
    def run(samples):
        df = spark.createDataFrame(
            [("v", i, float(p), float(s)) for i, (p, s) in enumerate(samples)],
            "video_id STRING, frame_number BIGINT, pts DOUBLE, score DOUBLE",
        )
        rows = A.motion_events(df, slice_seconds=3).orderBy("start_seconds").collect()
        return [(r.start_seconds, r.end_seconds, r.peak_score) for r in rows]

    assert run([(0, 0.5), (1, 0.6), (20, 0.7)]) == [(0.0, 20.0, 0.7)]
    assert run([(0, 0.5), (1, 0.6), (2, 0), (3.5, 0), (4, 0.2), (6, 0.3)]) == [(0.0, 1.0, 0.6), (4.0, 6.0, 0.3)]
    assert run([(0, 0.5), (1, 0), (2, 0.4), (2.5, 0)]) == [(0.0, 2.0, 0.5)]
    assert run([(0, 0.5)]) == []


def test_moving_person_heads_east_and_loiterer_is_found(detections):
    east = detections([(i, i, "person", (10 + 20 * i, 10, 30 + 20 * i, 60), 1, (20, 0)) for i in range(3)])
    row = TJ.track_summaries(east).collect()[0]
    assert row.direction.startswith("Eastbound") and not row.is_loitering
    still = detections([(i, t, "person", (100 + i, 100, 120 + i, 150), 2) for i, t in enumerate((0, 1.5, 3.5))])
    kinds = {r.event_type for r in TJ.track_incidents(TJ.track_summaries(still)).collect()}
    assert kinds == {"PERSON_TRACK", "LOITERING_DETECTED"}


def test_collision_and_convergence_against_brute_force(detections):
    rng = random.Random(11)
    rows = []
    for f in range(40):
        for t in range(6):
            x, y = rng.randint(0, 900), rng.randint(0, 400)
            cls = "person" if t < 3 else "car"
            rows.append((f, f * 0.31, cls, (x, y, x + rng.randint(10, 300), y + rng.randint(10, 300)), t, (rng.randint(-60, 60), 5)))
    det = detections(rows)
    tracks = TJ.track_summaries(det)
    mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    best = {}
    for fa, ta, ca, ba, ka, *_ in rows:
        for fb, tb, cb, bb, kb, *_ in rows:
            if ka < kb and ca == cb and abs(round(ta * 1e6) - round(tb * 1e6)) <= 600000:
                (ax, ay), (bx, by) = mid(ba), mid(bb)
                d = ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5
                best[ca, ka, kb] = min(best.get((ca, ka, kb), (1e18, 0)), (d, ta))
    conv = {(r.track_a, r.track_b): r.distance for r in TJ.person_convergence(det, tracks).collect()}
    assert conv == {k[1:]: pytest.approx(v[0]) for k, v in best.items() if k[0] == "person" and v[0] <= 150}
    coll = {(r.track_a, r.track_b): r for r in TJ.vehicle_collision(det, tracks).collect()}
    assert set(coll) == {k[1:] for k in best if k[0] == "car"}
    for k, v in best.items():
        if k[0] == "car":
            assert coll[k[1:]].min_distance == pytest.approx(v[0])
            assert coll[k[1:]].start_time == T0 + dt.timedelta(seconds=v[1])


def test_context_stays_small(spark, detections):
    rows = [(f, f * 5.0, "person", (f % 300, 50, f % 300 + 40, 150), f % 40) for f in range(500)]
    ev = A.detection_events(detections(rows))
    spans = A.track_spans(ev)
    out = Q.video_context(spans, TJ.track_incidents(TJ.track_summaries(detections(rows))), ev, "camera_id", "who was there")
    row = out.collect()[0]
    assert row.context_chars < 6000 and "Tracked Entity Spans (Top 25 of 40)" in row.context


def test_upper_median_and_null_confidence(spark):
    # gaps 1, 2, 3, 4: the upper median is 3, so the wait is 9 seconds
    ev = events(spark, [(0, 0, "car", None, 1), (1, 1, "car", 0.9, 1), (3, 3, "car", 0.9, 1), (6, 6, "car", 0.9, 1), (10, 10, "car", 0.9, 1)])
    row = Q.disappearances(ev, min_confidence=0.5).collect()[0]
    assert row.observation_count == 5
    assert row.disappearance_time == T0 + dt.timedelta(seconds=19)


def test_search_edge_values(spark):
    ev = events(spark, [(0, 1, "car", None, 1), (5, 6, "person", 0.4, 2)])
    assert Q.search_events(ev, 1, [], min_confidence=0).count() == 2
    assert Q.search_events(ev, 1, [], min_confidence=0.1).count() == 1
    assert Q.intent_search(ev, "any bicycle?").count() == 2
    assert [r.object_type for r in Q.intent_search(ev, "which people?").collect()] == ["person"]


def test_interval_jumps_against_a_plain_walk(spark):
    from argusframe.operators.slicing import next_after

    rng = random.Random(8)
    rows = [(k, p) for k in ("a", "b") for p in sorted(rng.uniform(0, 60) for _ in range(150))]
    df = spark.createDataFrame(rows, "k STRING, p DOUBLE")
    for width in (1.3, 7.0, 100.0):
        got = sorted((r.k, r.p) for r in next_after(df, ["k"], "p", 1.3, width).collect())
        want = []
        for k in ("a", "b"):
            due = -1.0
            for p in [p for q, p in rows if q == k]:
                if p >= due:
                    want.append((k, p))
                    due = p + 1.3
        assert got == want, width


def test_walks_share_batches_and_cross_them(spark):
    from bisect import bisect_left

    from argusframe.operators.slicing import next_after

    rng = random.Random(9)
    rows = [(k, rng.randrange(400) / 10) for k in ("a", "b", None, *map(str, range(30))) for _ in range(40)]
    df = spark.createDataFrame([*rows, ("a", None)], "k STRING, p DOUBLE")
    want = []
    for key in {k for k, _ in rows}:
        pos, due = sorted({p for k, p in rows if k == key}), float("-inf")
        while (i := bisect_left(pos, due)) < len(pos):
            want.append((str(key), pos[i]))
            due = pos[i] + 1.3
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in ("3", "10000"):
        spark.conf.set(conf, size)
        try:
            found = next_after(df, ["k"], "p", 1.3, 5.0)
            assert sorted((str(r.k), r.p) for r in found.collect()) == sorted(want)
        finally:
            spark.conf.unset(conf)
    # no group is a table of its own
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
