"""Integrity roll-ups and the row order of ties, worked out by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from argusframe.operators import integrity as N
from argusframe.operators.slicing import islands, sequence_key, time_slice

FRAME = "video_id STRING, frame_number BIGINT, pts DOUBLE, nominal_fps DOUBLE, width INT, height INT, mean_luma DOUBLE, std_luma DOUBLE"


def frames(spark, videos):
    rows = []
    for name, (gaps, luma) in videos.items():
        pts = 0.0
        for i, (gap, y) in enumerate(zip(gaps, luma, strict=True)):
            pts += gap
            rows.append((name, i, pts, 10.0, 640, 480, y, 5.0))
    return spark.createDataFrame(rows, FRAME)


def test_the_two_scores_differ_as_their_rules_do(spark):
    steady, moving = [0.1] * 20, [10.0 * (i % 9) for i in range(20)]
    wide = [0.1] * 10 + [0.26] + [0.1] * 9  # 2.6 intervals: over 2.5, under 2.75; and a change of 6 fps
    pair = [*moving[:10], moving[9], *moving[11:]]  # two like frames are no run
    run = [*moving[:10], *[moving[9]] * 6, *moving[16:]]
    table = frames(spark, {"ok": (steady, moving), "wide": (wide, moving), "pair": (steady, pair), "run": (steady, run)})
    none = spark.createDataFrame([], "video_id STRING, frame_number BIGINT, signature ARRAY<DOUBLE>")
    penalty = {r.video_id: r.integrity_score for r in N.score_penalty(N.report_checks(table, slice_frames=6)).collect()}
    assert penalty == {"ok": 100, "pair": 100, "run": 85, "wide": 100 - 15 - 15 - 10 - 15}
    percent = {r.video_id: (r.integrity_score, r.overall_status) for r in N.score_percent(N.decoder_checks(table, none, slice_frames=6)).collect()}
    assert set(percent.values()) == {(100.0, "PASS")}


def test_duplicate_signatures_cost_a_check_but_are_no_anomaly(spark):
    table = frames(spark, {"v": ([0.1] * 20, [10.0 * (i % 9) for i in range(20)])})
    same = spark.createDataFrame([("v", 5 * i, [1.0, 2.0]) for i in range(3)], "video_id STRING, frame_number BIGINT, signature ARRAY<DOUBLE>")
    row = N.score_percent(N.decoder_checks(table, same)).collect()[0]
    assert (row.integrity_score, row.overall_status) == (85.7, "PASS")


def test_rows_of_one_moment_keep_the_order_of_their_ids(spark):
    t0 = dt.datetime(2026, 1, 1)
    ids = [1, 1023, 1024, 1025, -5, 1 << 62]
    rows = [(i, t0) for i in ids] + [(0, t0 + dt.timedelta(microseconds=1))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP").withColumn("seq", sequence_key(F.col("ts"), F.col("id")))
    assert [r.id for r in df.orderBy("seq").collect()] == [*sorted(ids), 0]
    assert df.select("seq").distinct().count() == len(rows)
    one = islands(
        df.withColumn("k", F.lit(1)), ["k"], "seq", ["ts"], lambda prev: F.col("ts") != prev["ts"],
        time_slice(F.col("ts"), 900), {"n": F.count(F.lit(1))}, {"n": F.sum("n")},
    )
    assert sorted(r.n for r in one.collect()) == [1, 6]
