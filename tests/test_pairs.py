"""Joins of track pairs cost their overlap, and see all of it."""

import random

import pytest
from pyspark.sql import functions as F

from argusframe.operators import pairs
from argusframe.operators.slicing import SLICE, range_slice

ROWS = "video_id string, camera_id string, track_id long, frame_number long, x int"


def tracks(seed):
    rng = random.Random(seed)
    rows = []
    for t in range(12):
        start, step = rng.randrange(300), rng.choice([1, 1, 2, 3])
        for f in range(start, start + rng.randrange(1, 400), step):
            if rng.random() < 0.8:
                rows.append(("v", "c", t, f, rng.randrange(100)))
    rows += [("v", "c", 3, f, 7) for f in range(5000, 5100)]  # comes back after a long gap
    rows += [("v", "c", 4, f, 8) for f in range(5050, 5150)]
    return rows


@pytest.mark.parametrize("frames", [1, 7, 64, 10000])
def test_common_frames_and_the_one_before(spark, frames):
    rows = tracks(frames)
    at = {}
    for _, _, t, f, x in rows:
        at.setdefault(t, {})[f] = x
    want = [("v", "c", a, b) for a in range(12) for b in range(12) if a < b and (a + b) % 3]
    table = spark.createDataFrame(rows, ROWS)
    chosen = spark.createDataFrame(want, "video_id string, camera_id string, track_a long, track_b long")
    got = pairs.last_common_frame(chosen, table, ["frame_number", "x"], frames=frames).collect()
    found = sorted(
        (r["track_a"], r["track_b"], r["frame_number"], r["a"]["x"], r["b"]["x"], r["prev"] and r["prev"]["a"]["frame_number"])
        for r in got
    )
    plain = []
    for _, _, a, b in want:
        last = None
        for f in sorted(at[a].keys() & at[b].keys()):
            plain.append((a, b, f, at[a][f], at[b][f], last))
            last = f
    assert found == sorted(plain)


def test_a_parked_car_costs_its_partners_only_their_overlap(spark):
    """One track of 10^6 rows and 10^3 partners of 40 rows each: what is joined follows the partners."""
    car = spark.range(1_000_000).select(
        F.lit("v").alias("video_id"), F.lit("c").alias("camera_id"), F.lit(0).cast("long").alias("track_id"),
        F.col("id").alias("frame_number"),
    )
    partners = spark.range(40_000).select(
        F.lit("v").alias("video_id"), F.lit("c").alias("camera_id"), (1 + F.floor(F.col("id") / 40)).alias("track_id"),
        (F.floor(F.col("id") / 40) * 997 + F.col("id") % 40).alias("frame_number"),
    )
    cut = car.unionByName(partners).withColumn(SLICE, range_slice(F.col("frame_number"), pairs.FRAMES))
    chosen = spark.range(1, 1001).select(
        F.lit("v").alias("video_id"), F.lit("c").alias("camera_id"), F.lit(0).cast("long").alias("track_a"),
        F.col("id").alias("track_b"),
    )
    spread = pairs.shared_slices(chosen, cut, cut)
    assert spread.count() <= 2 * 1000
    of_car = spread.join(cut.where("track_id = 0"), ["video_id", "camera_id", SLICE]).count()
    assert of_car <= 2 * 1000 * pairs.FRAMES
    common = pairs.pair_rows(chosen, cut, cut.withColumn("y", F.lit(1)), ["frame_number"])
    assert common.count() == 40_000


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_rows_inside_intervals(spark, width):
    rng = random.Random(width)
    rows = [(k, rng.randrange(2000), i) for i in range(900) for k in [rng.choice("ab")]]
    spans = [(rng.choice("abx"), i, s, s + rng.randrange(60)) for i in range(60) for s in [rng.randrange(2000)]]
    spans += [("a", 100, 0, 2000), ("b", 101, 700, 690)]
    got = pairs.interval_rows(
        spark.createDataFrame([s for s in spans if s[2] <= s[3]], "k string, i long, s long, e long"),
        spark.createDataFrame(rows, "k string, at long, r long"), F.col("s"), F.col("e"), "at", width, ["k"],
    )
    want = sorted((i, r) for k, i, s, e in spans for q, at, r in rows if q == k and s <= at <= e)
    assert sorted((x["i"], x["r"]) for x in got.collect()) == want


@pytest.mark.parametrize("seconds", [1, 30, 100000])
def test_next_events_of_a_camera(spark, seconds):
    import datetime as dt

    from argusframe.operators import search

    rng = random.Random(seconds)
    t0 = dt.datetime(2026, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    events = [(rng.choice("xy"), i, at(rng.randrange(200)), "E", "t") for i in range(150)]
    gone = [(rng.choice("xyz"), f"o{i}", at(rng.randrange(230))) for i in range(60)]
    got = search.disappearance_related(
        spark.createDataFrame(events, "camera_id string, event_id long, start_time timestamp, event_type string, object_type string"),
        spark.createDataFrame(gone, "camera_id string, object_type string, disappearance_time timestamp"), 3, seconds,
    ).collect()
    want = []
    for cam, o, t in gone:
        later = sorted((s, i) for c, i, s, _, _ in events if c == cam and s >= t)[:3]
        want += [(cam, o, n + 1, i) for n, (_, i) in enumerate(later)]
    assert sorted((r["camera_id"], r["object_type"], r["position"], r["event_id"]) for r in got) == sorted(want)
