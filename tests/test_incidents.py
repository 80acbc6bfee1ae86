from argusframe.operators import incidents as I


def test_touching_vehicles_flag_contact_once(detections):
    det = detections(
        [
            (10, 0, "car", (100, 150, 200, 250), 1),
            (10, 0, "truck", (208, 150, 320, 260), 2),
            (10, 0, "car", (900, 900, 950, 950), 3),
        ]
    )
    rows = I.proximity_flags(det).collect()
    assert [(r.event_type, r.track_a, r.track_b) for r in rows] == [
        ("REVIEW_FLAG_POSSIBLE_CONTACT", 1, 2)
    ]
    assert rows[0].edge_distance_px == 8.0


def test_boxes_far_apart_or_same_track_give_nothing(detections):
    det = detections(
        [
            (1, 0, "car", (0, 0, 10, 10), 1),
            (1, 0, "car", (60, 0, 70, 10), 2),
            (1, 0, "car", (0, 0, 10, 10), 1),
            (1, 0, "car", (0, 0, 10, 10), None),
        ]
    )
    assert I.proximity_flags(det).count() == 0


def test_pair_spanning_many_grid_cells_appears_once(detections):
    det = detections(
        [(1, 0, "car", (-300, -300, 3000, 2000), 1), (1, 0, "bus", (100, 100, 2500, 1500), 2)]
    )
    assert I.proximity_flags(det).count() == 1


def test_looming_vehicle(detections):
    det = detections(
        [(1, 0, "car", (280, 150, 360, 210), 4), (2, 0.25, "car", (200, 180, 440, 360), 4)]
    )
    rows = I.ego_looming(det).collect()
    assert len(rows) == 1 and rows[0].event_type == "REVIEW_FLAG_EGO_COLLISION_WARNING"
    assert rows[0].confidence == 0.95


def test_sudden_stop(detections):
    box = lambda c: (c - 20, 100, c + 20, 140)
    det = detections([(i, 0.25 * i, "car", box(c), 7) for i, c in enumerate((130, 155, 156))])
    rows = I.sudden_stops(det).collect()
    assert [(r.speed_before, r.speed_after) for r in rows] == [(100.0, 4.0)]


def test_assault_uses_the_end_of_the_track(detections):
    det = detections(
        [
            (1, 0.0, "person", (10, 100, 60, 200), 1),
            (1, 0.0, "person", (100, 100, 150, 200), 2),
            (2, 0.5, "person", (90, 100, 140, 200), 1),
            (2, 0.5, "person", (100, 100, 150, 200), 2),
        ]
    )
    rows = I.assault(det).collect()
    assert [(r.frame_number, r.track_id, r.victim_track) for r in rows] == [(2, 1, 2)]


def test_road_accident_exactly_one(detections):
    det = detections(
        [
            (5, 1, "car", (100, 100, 200, 200), 1, (40, 0)),
            (5, 1, "car", (150, 100, 250, 200), 2, (-30, 0)),
        ]
    )
    assert I.road_accident(det).count() == 1
    assert I.pedestrian_struck(det).count() == 0


def test_robbery_looks_up_the_last_common_frame(detections):
    # frame 2 misses the aggressor, so the common frames are 1 and 3
    rows = [
        (0, 0.0, "person", (400, 100, 440, 200), 1),
        (0, 0.0, "person", (600, 100, 640, 200), 2),
        (1, 0.5, "person", (400, 100, 440, 200), 1),
        (1, 0.5, "person", (600, 100, 640, 200), 2),
        (2, 1.0, "person", (600, 100, 640, 140), 2),
        (3, 1.5, "person", (540, 100, 580, 200), 1),
        (3, 1.5, "person", (600, 100, 640, 140), 2),
    ]
    got = I.robbery(detections(rows)).collect()
    assert [(r.frame_number, r.track_a, r.track_b) for r in got] == [(3, 1, 2)]
    assert abs(got[0].shrink_ratio - 0.4) < 1e-9


def test_shuffled_input_gives_the_same_rows(detections):
    rows = [
        (f, f * 0.25, "person", (100 + 30 * t + f, 100, 140 + 30 * t + f, 200 - 10 * (f % 5)), t, (t * 20, -f))
        for f in range(12)
        for t in range(4)
    ]
    det = detections(rows)
    for op in (I.proximity_flags, I.assault, I.fighting, I.robbery, I.crowd_panic, I.sudden_stops):
        a = sorted(map(str, op(det).collect()))
        b = sorted(map(str, op(det.orderBy("confidence", "x1").repartition(3)).collect()))
        assert a == b, op.__name__


def test_frames_are_sorted_by_their_number_first(spark):
    schema = (
        "video_id string, camera_id string, frame_number long, det_id long, track_id long, "
        "x1 double, y1 double, x2 double, y2 double"
    )
    rows = [(f"vid-{i}", "CH-01", i, 10 * i + j, j, 0.0, 0.0, 9.0, 9.0) for i in range(3) for j in range(2)]
    pairs = I.same_frame_pairs(spark.createDataFrame(rows, schema))
    assert pairs.count() == 3
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    sorts = [line.split("Sort [")[1] for line in plan.splitlines() if "Sort [" in line]
    assert sorts and all(s.startswith("frame_number#") for s in sorts), plan
