"""Trackers on hand-made scenes, and streams against batch."""

import random

from pyspark.sql import functions as F

from argusframe.operators import tracking as T
from argusframe.streaming import live as L


def scene(seed, frames=60):
    rng = random.Random(seed)
    rows, f = [], 0
    things = {k: [rng.randint(0, 800), rng.randint(0, 400)] for k in range(5)}
    for _ in range(frames):
        f += rng.choice([1, 1, 1, 2, 5, 7, 9])
        for k, p in things.items():
            p[0] += rng.randint(-60, 60)
            p[1] += rng.randint(-40, 40)
            if rng.random() < 0.8:
                cls = ["person", "car", "motion"][k % 3]
                rows.append((f, f * 0.5, cls, (p[0], p[1], p[0] + 60, p[1] + 90), k if rng.random() < 0.5 else None, (0, 0), 0.5 + k / 10))
    return rows


def box(x, y=100, w=60, h=60):
    return (x, y, x + w, y + h)


def ids(df, column):
    return [getattr(r, column) for r in df.orderBy("det_id").collect()]


def test_centroid_tracks_by_hand(detections):
    cases = [
        # within 220 pixels: one track; beyond, without overlap: two
        ([(1, 0, "car", box(0), None), (2, 0.5, "car", box(215), None)], [1, 1]),
        ([(1, 0, "car", box(0), None), (2, 0.5, "car", box(230), None)], [1, 2]),
        # six frames without it are forgiven, seven are not
        ([(1, 0, "car", box(0), None), (8, 3.5, "car", box(0), None)], [1, 1]),
        ([(1, 0, "car", box(0), None), (9, 4.0, "car", box(0), None)], [1, 2]),
        # another class costs 50 pixels, so the nearer person takes the track of the car no longer
        ([(1, 0, "car", box(0), None), (2, 0.5, "person", box(70), None), (2, 0.5, "car", box(100), None)], [1, 2, 1]),
        ([(1, 0, "car", box(0), None), (2, 0.5, "motion", box(70), None), (2, 0.5, "car", box(100), None)], [1, 1, 2]),
        # two that pass each other: the nearest pairs are taken first
        ([(1, 0, "car", box(0), None), (1, 0, "car", box(300), None), (2, 0.5, "car", box(290), None), (2, 0.5, "car", box(20), None)], [1, 2, 2, 1]),
    ]
    for rows, want in cases:
        assert ids(T.track_centroid(detections(rows), fps=2.0), "track_id") == want


def test_centroid_velocity_is_smoothed(detections):
    rows = [(1, 0, "car", box(0), None), (2, 0.5, "car", box(10), None), (3, 1.0, "car", box(30), None)]
    assert ids(T.track_centroid(detections(rows), fps=2.0), "vx") == [0.0, 20.0, 0.75 * 40 + 0.25 * 20]


def test_entities_by_hand(detections):
    cases = [
        # the same track of the same class is the same entity however far
        ([(1, 0, "car", box(0), 7), (2, 0.5, "car", box(900), 7)], ["entity_1", "entity_1"]),
        ([(1, 0, "car", box(0), 7), (2, 0.5, "truck", box(900), 7)], ["entity_1", "entity_2"]),
        # else within 180 pixels
        ([(1, 0, "car", box(0), None), (2, 0.5, "car", box(170), None)], ["entity_1", "entity_1"]),
        ([(1, 0, "car", box(0), None), (2, 0.5, "car", box(190), None)], ["entity_1", "entity_2"]),
        # three frames without it are forgiven, four are not
        ([(1, 0, "car", box(0), None), (5, 2.0, "car", box(0), None)], ["entity_1", "entity_1"]),
        ([(1, 0, "car", box(0), None), (6, 2.5, "car", box(0), None)], ["entity_1", "entity_2"]),
    ]
    for rows, want in cases:
        assert ids(T.track_entities(detections(rows)), "entity_id") == want


def test_open_vocabulary_labels_by_hand(detections):
    cases = [
        # overlap 30 x 60 of 90 x 60 is a third; 25 of 95 is too little
        ([(1, 0, "car", box(0), None), (2, 0.5, "car", box(30), None)], [-1, -1]),
        ([(1, 0, "car", box(0), None), (2, 0.5, "car", box(35), None)], [-1, -2]),
        ([(1, 0, "car", box(0), None), (7, 3.0, "car", box(0), None)], [-1, -1]),
        ([(1, 0, "car", box(0), None), (8, 3.5, "car", box(0), None)], [-1, -2]),
        ([(1, 0, "car", box(0), None), (2, 0.5, "dog", box(0), None)], [-1, -2]),
    ]
    for rows, want in cases:
        assert ids(T.track_open_vocab(detections(rows)), "track_id") == want


def test_trackers_do_not_depend_on_slices_or_on_the_order_of_rows(detections):
    det = detections(scene(1))
    for track, column, narrow in (
        (T.track_centroid, "track_id", {"slice_seconds": 20}),
        (T.track_entities, "entity_id", {"slice_seconds": 20, "slice_frames": 15}),
        (T.track_open_vocab, "track_id", {"slice_seconds": 20, "slice_frames": 15}),
    ):
        wide = ids(track(det), column)
        assert ids(track(det.orderBy(F.desc("det_id")), **narrow), column) == wide
        if track is not T.track_open_vocab:  # labels may be given twice in a frame
            rows = track(det).groupBy("frame_number", column).count()
            assert rows.where("count > 1").count() == 0


def test_vehicle_keeps_its_track_and_speed(detections):
    det = detections([(1, 0, "vehicle", (100, 200, 300, 300), None), (2, 0.5, "vehicle", (200, 200, 400, 300), None)])
    rows = T.track_centroid(det, fps=2.0).orderBy("frame_number").collect()
    assert [r.track_id for r in rows] == [1, 1]
    assert rows[1].vx == 200.0 and rows[1].vy == 0.0


def test_min_hits(detections):
    det = detections([(f, f * 0.5, "car", (100, 100, 150, 150), None) for f in range(4)])
    assert sorted(r.frame_number for r in T.track_centroid(det, min_hits=3).collect()) == [2, 3]


def test_live_tracks_equal_batch_over_several_batches(spark, detections, tmp_path):
    rows = scene(5, 30)
    det = detections(rows)
    src = str(tmp_path / "in")
    cut = sorted({r[0] for r in rows})
    third = len(cut) // 3
    for n, (lo, hi) in enumerate([(0, cut[third]), (cut[third], cut[2 * third]), (cut[2 * third], 10**9)]):
        part = det.where((F.col("frame_number") >= lo) & (F.col("frame_number") < hi))
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    L.run_once(L.live_tracks(stream, fps=2.0, delay="1 hour"), out, str(tmp_path / "cp"))
    live = {r.det_id: r.track_id for r in spark.read.parquet(out).collect()}
    batch = {r.det_id: r.track_id for r in T.track_centroid(det, fps=2.0).collect()}
    assert live == batch


def test_replayed_upsert_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    write = L.upsert_sink(path)
    rows = lambda *r: spark.createDataFrame(list(r), "k BIGINT, v BIGINT, n STRING")
    write(rows((1, 1, "a"), (2, 1, "b")), 0)
    write(rows((1, 2, "c")), 1)
    first = sorted(map(str, L.read_upserts(spark, path, ["k"], ["v"]).collect()))
    write(rows((1, 2, "c")), 1)
    assert sorted(map(str, L.read_upserts(spark, path, ["k"], ["v"]).collect())) == first
    assert len(first) == 2
