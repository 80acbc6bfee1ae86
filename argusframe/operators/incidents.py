"""Review flags and behaviour anomalies over tracked detections.

Detections carry video_id, camera_id, frame_number, ts, det_id, object_type, track_id,
x1..y2, vx, vy and confidence. Same-frame pairs come from the spatial grid; per-track look
back uses sliced windows, so neither a crowded frame nor a hot track lands whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions import geometry as G, scalars as S
from argusframe.operators import vocab
from argusframe.operators.grid import near_box_pairs
from argusframe.operators.pairs import common_frames, interval_rows, last_common_frame
from argusframe.operators.slicing import lag_in_slices, sequence_key, time_slice
from argusframe.sources.session import materialize

SCENE = ["video_id", "camera_id"]
FRAME = [*SCENE, "frame_number"]
#: A frame's key to join and sort by: numbers first, as texts that begin alike are slow to sort.
BY_FRAME = ["frame_number", *SCENE]
TRACK = [*SCENE, "track_id"]


def _tracked(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    out = df.where(F.col("track_id").isNotNull())
    if types is not None:
        out = out.where(F.col("object_type").isin(types))
    return out


def _rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *FRAME, "det_id", "ts", "track_id", "object_type", "x1", "y1", "x2", "y2", *extra
    )


def _one_per_pair(df: DataFrame) -> DataFrame:
    """Keep one row per frame and track pair when a track repeats within a frame."""
    pair = Window.partitionBy(
        "frame_number", F.least("a_track_id", "b_track_id"), F.greatest("a_track_id", "b_track_id"), *SCENE
    ).orderBy("a_det_id", "b_det_id")
    return df.withColumn("_rn", F.row_number().over(pair)).where("_rn = 1").drop("_rn")


def same_frame_pairs(
    left: DataFrame, right: DataFrame | None = None, margin: float = 0.0
) -> DataFrame:
    """Near pairs of tracked objects of one frame; unordered when only `left` is given."""
    pairs = near_box_pairs(left, left if right is None else right, FRAME, margin)
    out = pairs.where(F.col("a_track_id") != F.col("b_track_id"))
    if right is None:
        out = out.where(F.col("a_det_id") < F.col("b_det_id"))
    return out


def proximity_flags(
    detections: DataFrame,
    iou_near: float = 0.05,
    iou_contact: float = 0.15,
    edge_near: float = 40.0,
    edge_contact: float = 15.0,
) -> DataFrame:
    """Contact or proximity of two tracked objects in a frame, once per frame and pair."""
    a, b = G.box("a_"), G.box("b_")
    pairs = same_frame_pairs(_rows(_tracked(detections)), margin=max(edge_near, edge_contact) / 2)
    scored = pairs.withColumn("iou", G.iou(a, b)).withColumn("edge", G.edge_distance(a, b))
    contact = (F.col("iou") >= iou_contact) | (F.col("edge") <= edge_contact)
    # either level is reached: each measure is taken once, the smaller one first
    near = (F.col("edge") <= max(edge_near, edge_contact)) | (F.col("iou") >= min(iou_near, iou_contact))
    hits = _one_per_pair(scored.where(near))
    score = F.greatest(
        F.col("iou"), F.greatest(F.lit(0.0), 1.0 - F.col("edge") / F.lit(edge_near))
    )
    return hits.select(
        *FRAME,
        F.when(contact, "REVIEW_FLAG_POSSIBLE_CONTACT")
        .otherwise("REVIEW_FLAG_PROXIMITY")
        .alias("event_type"),
        F.col("a_ts").alias("start_time"),
        F.col("a_ts").alias("end_time"),
        F.greatest(F.lit(0.5), score).alias("confidence"),
        F.col("a_track_id").alias("track_a"),
        F.col("a_object_type").alias("object_a"),
        F.col("b_track_id").alias("track_b"),
        F.col("b_object_type").alias("object_b"),
        "iou",
        F.col("edge").alias("edge_distance_px"),
    )


def _track_lag(df: DataFrame, fields: list[str], slice_seconds: float) -> DataFrame:
    keyed = df.withColumn("seq", sequence_key(F.col("ts"), F.col("det_id")))
    return lag_in_slices(
        keyed, TRACK, ["seq"], fields, time_slice(F.col("ts"), slice_seconds)
    )


def ego_looming(
    detections: DataFrame,
    min_ratio: float = 1.35,
    min_growth_px_s: float = 25.0,
    slice_seconds: float = 900,
) -> DataFrame:
    """First fast growth of a vehicle box near the camera, once per track."""
    rows = _rows(_tracked(detections, vocab.LOOMING_VEHICLES))
    one = F.lit(1.0)
    cur, prev = G.box(), G.box_of(F.col("prev"))
    w, h = F.greatest(one, G.width(cur)), F.greatest(one, G.height(cur))
    pw, ph = F.greatest(one, G.width(prev)), F.greatest(one, G.height(prev))
    dt = F.greatest(F.lit(0.05), S.seconds_between(F.col("ts"), F.col("prev.ts")))
    measured = (
        _track_lag(rows, ["ts", "x1", "y1", "x2", "y2"], slice_seconds)
        .where(F.col("prev").isNotNull())
        .withColumn("area_growth_ratio", (w * h) / F.greatest(one, pw * ph))
        .withColumn("expansion_px_s", (w - pw) / dt)
        .withColumn("_area", w * h)
        .where((F.col("y2") >= 180.0) | (F.col("_area") >= 15000.0))
        .where(
            (F.col("area_growth_ratio") >= min_ratio)
            | (F.col("expansion_px_s") >= min_growth_px_s)
        )
    )
    first = Window.partitionBy(*TRACK).orderBy("seq")
    conf = 0.55 + F.least(F.lit(0.40), (F.col("area_growth_ratio") - 1.0) * 0.3)
    return (
        measured.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(
            *TRACK,
            "object_type",
            F.lit("REVIEW_FLAG_EGO_COLLISION_WARNING").alias("event_type"),
            F.col("prev.ts").alias("start_time"),
            F.col("ts").alias("end_time"),
            F.least(F.lit(0.95), conf).alias("confidence"),
            "area_growth_ratio",
            "expansion_px_s",
        )
    )


def sudden_stops(
    detections: DataFrame,
    drop: float = 0.50,
    moving_floor: float = 3.0,
    slice_seconds: float = 900,
) -> DataFrame:
    """Track speed halving or worse between two consecutive moves."""
    rows = _rows(_tracked(detections), "confidence")
    dt = S.seconds_between(F.col("ts"), F.col("prev.ts"))
    moves = (
        _track_lag(rows, ["ts", "x1", "y1", "x2", "y2"], slice_seconds)
        .where(F.col("prev").isNotNull() & (dt > 0))
        .withColumn("speed", G.center_distance(G.box(), G.box_of(F.col("prev"))) / dt)
        .drop("prev")
    )
    again = lag_in_slices(
        moves, TRACK, ["seq"], ["ts", "speed"], time_slice(F.col("ts"), slice_seconds)
    )
    return again.where(
        (F.col("prev.speed") >= moving_floor)
        & (F.col("speed") <= F.col("prev.speed") * (1.0 - drop))
    ).select(
        *TRACK,
        "object_type",
        F.lit("REVIEW_FLAG_SUDDEN_STOP").alias("event_type"),
        F.col("prev.ts").alias("start_time"),
        F.col("ts").alias("end_time"),
        "confidence",
        F.col("prev.speed").alias("speed_before"),
        F.col("speed").alias("speed_after"),
    )


def _last_two(persons: DataFrame) -> DataFrame:
    """Last and second-last centre of every track (row limit applied before the shuffle)."""
    recent = Window.partitionBy(*TRACK).orderBy(F.desc("seq"))
    cx, cy = G.center(G.box())
    top = (
        persons.withColumn("seq", sequence_key(F.col("ts"), F.col("det_id")))
        .select(*TRACK, "seq", "ts", cx.alias("cx"), cy.alias("cy"))
        .withColumn("_rn", F.row_number().over(recent))
        .where("_rn <= 2")
    )
    pick = lambda rn, c: F.max(F.when(F.col("_rn") == rn, F.col(c)))
    return top.groupBy(*TRACK).agg(
        pick(1, "cx").alias("cx1"),
        pick(1, "cy").alias("cy1"),
        pick(2, "cx").alias("cx2"),
        pick(2, "cy").alias("cy2"),
        pick(2, "ts").alias("ts2"),
    ).where("ts2 IS NOT NULL")


def assault(
    detections: DataFrame, approach_px_s: float = 60.0, overlap_iou: float = 0.12
) -> DataFrame:
    """Overlapping persons of whom one closed in fast at the end of its track."""
    persons = _rows(_tracked(detections, ["person"]))
    pairs = same_frame_pairs(persons)
    pairs = pairs.withColumn("iou", G.iou(G.box("a_"), G.box("b_"))).where(
        F.col("iou") >= overlap_iou
    )
    sides = []
    for me, other in (("a_", "b_"), ("b_", "a_")):
        vx, vy = G.center(G.box(other))
        sides.append(
            pairs.select(
                *FRAME,
                F.col(f"{me}track_id").alias("track_id"),
                F.col(f"{other}track_id").alias("victim_track"),
                F.col(f"{me}ts").alias("start_time"),
                F.col(f"{other}ts").alias("end_time"),
                F.col(f"{me}det_id").alias("det_id"),
                vx.alias("vcx"),
                vy.alias("vcy"),
                "iou",
            )
        )
    both = reduce(DataFrame.unionByName, sides)
    ends = _last_two(persons)
    dt = F.greatest(F.lit(0.05), S.seconds_between(F.col("start_time"), F.col("ts2")))
    before = G.norm(F.col("vcx") - F.col("cx2"), F.col("vcy") - F.col("cy2"))
    after = G.norm(F.col("vcx") - F.col("cx1"), F.col("vcy") - F.col("cy1"))
    hits = (
        both.join(ends, TRACK, "inner")
        .withColumn("approach_px_s", (before - after) / dt)
        .where(F.col("approach_px_s") >= approach_px_s)
    )
    first = Window.partitionBy("frame_number", "track_id", "victim_track", *SCENE).orderBy("det_id")
    conf = 0.55 + F.least(F.lit(0.35), F.col("approach_px_s") / 200.0) + F.col("iou") * 0.2
    return (
        hits.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(
            *FRAME,
            F.lit("ANOMALY_ASSAULT").alias("event_type"),
            "start_time",
            "end_time",
            S.clamp_confidence(F.least(F.lit(0.90), conf)).alias("confidence"),
            "track_id",
            "victim_track",
            "approach_px_s",
            F.col("iou").alias("contact_iou"),
        )
    )


def _first_seen(persons: DataFrame) -> DataFrame:
    return persons.groupBy(*TRACK).agg(
        F.min(sequence_key(F.col("ts"), F.col("det_id"))).alias("first_seq"),
        F.count(F.lit(1)).alias("points"),
        F.max(G.area(G.box())).alias("max_area"),
    )


def fighting(
    detections: DataFrame,
    min_duration_s: float = 1.5,
    max_edge_px: float = 50.0,
    min_relative_speed: float = 30.0,
) -> DataFrame:
    """Person tracks close together for long with high relative speed.

    Only close pairs are ever built; the common frames, which include frames where the two are
    apart, are counted afterwards for the surviving track pairs alone.
    """
    persons = _rows(_tracked(detections, ["person"]), "vx", "vy")
    near = same_frame_pairs(persons, margin=max_edge_px / 2).where(
        G.edge_distance(G.box("a_"), G.box("b_")) <= max_edge_px
    )
    rel = S.speed(F.col("a_vx") - F.col("b_vx"), F.col("a_vy") - F.col("b_vy"))
    lo, hi = F.least("a_track_id", "b_track_id"), F.greatest("a_track_id", "b_track_id")
    close = (
        near.groupBy(*SCENE, lo.alias("t1"), hi.alias("t2"))
        .agg(F.count(F.lit(1)).alias("close_frames"), F.avg(rel).alias("avg_relative_speed"))
        .where((F.col("close_frames") >= 3) & (F.col("avg_relative_speed") >= min_relative_speed))
    )
    first = _first_seen(persons)
    f1 = first.select(*SCENE, F.col("track_id").alias("t1"), F.col("first_seq").alias("s1"))
    f2 = first.select(*SCENE, F.col("track_id").alias("t2"), F.col("first_seq").alias("s2"))
    swap = F.col("s1") > F.col("s2")
    ordered = (
        close.join(f1, [*SCENE, "t1"])
        .join(f2, [*SCENE, "t2"])
        .select(
            *SCENE,
            F.when(swap, F.col("t2")).otherwise(F.col("t1")).alias("track_a"),
            F.when(swap, F.col("t1")).otherwise(F.col("t2")).alias("track_b"),
            "close_frames",
            "avg_relative_speed",
        )
    )
    moments = persons.select(*TRACK, "frame_number", F.unix_micros("ts").alias("us"))
    span = (
        common_frames(ordered, moments, ["us"])
        .withColumn("us", F.col("a.us"))
        .groupBy(*SCENE, "track_a", "track_b", "close_frames", "avg_relative_speed")
        .agg(
            F.count(F.lit(1)).alias("common_frames"),
            F.min_by("us", "frame_number").alias("us0"),
            F.max_by("us", "frame_number").alias("us1"),
        )
        .withColumn("duration_s", (F.col("us1") - F.col("us0")) / F.lit(1e6))
        .where((F.col("common_frames") >= 3) & (F.col("duration_s") >= min_duration_s))
    )
    conf = (
        0.50
        + F.least(F.lit(0.35), F.col("avg_relative_speed") / 200.0)
        + F.least(F.lit(0.15), F.col("duration_s") / 20.0)
    )
    return span.select(
        *SCENE,
        F.lit("ANOMALY_FIGHTING").alias("event_type"),
        F.timestamp_micros("us0").alias("start_time"),
        F.timestamp_micros("us1").alias("end_time"),
        S.clamp_confidence(F.least(F.lit(0.88), conf)).alias("confidence"),
        "track_a",
        "track_b",
        "duration_s",
        "avg_relative_speed",
        "close_frames",
    )


def _robbery_hits(pairs: DataFrame, approach_px_s: float, shrink: float) -> DataFrame:
    bx, by = G.center(G.box("b_"))
    ax, ay = G.center(G.box("a_"))
    gx, gy = G.center(G.box_of(F.col("a_prev")))
    dt = F.greatest(F.lit(0.05), S.seconds_between(F.col("a_ts"), F.col("a_prev.ts")))
    before = G.area(G.box_of(F.col("b_prev")))
    ratio = F.when(
        before > 0, G.area(G.box("b_")) / F.greatest(F.lit(1.0), before)
    ).otherwise(F.lit(1.0))
    return (
        pairs.withColumn(
            "approach_px_s", (G.norm(bx - gx, by - gy) - G.norm(bx - ax, by - ay)) / dt
        )
        .withColumn("shrink_ratio", ratio)
        .where((F.col("approach_px_s") >= approach_px_s) & (F.col("shrink_ratio") <= shrink))
        .select(
            *FRAME,
            F.col("a_track_id").alias("track_a"),
            F.col("b_track_id").alias("track_b"),
            F.col("a_ts").alias("start_time"),
            F.col("b_ts").alias("end_time"),
            "approach_px_s",
            "shrink_ratio",
        )
    )


def robbery(
    detections: DataFrame,
    approach_px_s: float = 50.0,
    shrink: float = 0.60,
    slice_seconds: float = 900,
) -> DataFrame:
    """A person closing in on another whose box shrinks between two common frames.

    Where both tracks were last seen in the same frame, that frame is the previous common
    frame, and two row-level facts are necessary for a hit: the aggressor itself moved at
    least at the approach speed, and the victim shrank. Both sides are filtered by them before
    the join. Pairs whose tracks have different gaps look their last common frame up.
    """
    persons = _rows(_tracked(detections, ["person"]))
    seen = _first_seen(persons).where("points >= 3")
    cell = ["ts", "x1", "y1", "x2", "y2", "frame_number"]
    rows = (
        _track_lag(persons, cell, slice_seconds)
        .where(F.col("prev").isNotNull())
        .join(seen, TRACK, "inner")
        .drop("points", "seq", "object_type", "det_id")
    )
    # six branches read these rows; written once instead of sliced and lagged six times
    rows = materialize(rows)
    own_dt = F.greatest(F.lit(0.05), S.seconds_between(F.col("ts"), F.col("prev.ts")))
    own_speed = G.center_distance(G.box(), G.box_of(F.col("prev"))) / own_dt
    own_before = G.area(G.box_of(F.col("prev")))
    shrank = G.area(G.box()) <= shrink * F.greatest(F.lit(1.0), own_before)

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            *FRAME, *(F.col(c).alias(prefix + c) for c in df.columns if c not in FRAME)
        )

    # slack: the bound must not lose a hit to rounding
    movers, shrunk = rows.where(own_speed >= approach_px_s * 0.999), rows.where(shrank)
    ordered = F.col("a_first_seq") < F.col("b_first_seq")
    same_gap = F.col("a_prev.frame_number") == F.col("b_prev.frame_number")
    direct = side(movers, "a_").join(side(shrunk, "b_"), BY_FRAME).where(ordered & same_gap)

    # different gaps mean that one of the two was missing from the frame's latest previous one
    late = F.col("prev.frame_number") < F.max("prev.frame_number").over(Window.partitionBy(*BY_FRAME))
    seen_late = rows.withColumn("_late", late)
    maybe = G.area(G.box()) <= shrink * F.greatest(F.lit(1.0), F.col("max_area"))
    either = [
        (seen_late.where("_late"), seen_late.where(maybe)),
        (seen_late.where("NOT _late"), seen_late.where(maybe & F.col("_late"))),
    ]
    uneven = reduce(
        DataFrame.unionByName,
        (side(x.drop("_late"), "a_").join(side(y.drop("_late"), "b_"), BY_FRAME) for x, y in either),
    ).where(ordered & ~same_gap)
    apart = uneven.select(
        *FRAME, F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"),
        F.struct(*(c for c in uneven.columns if c not in FRAME)).alias("hit"),
    )
    before = last_common_frame(apart.select(*SCENE, "track_a", "track_b").distinct(), persons, cell)
    looked_up = (
        apart.join(before.where(F.col("prev").isNotNull()), [*FRAME, "track_a", "track_b"])
        .select(*FRAME, "hit.*", "prev")
        .withColumn("a_prev", F.col("prev.a"))
        .withColumn("b_prev", F.col("prev.b"))
        .select(*direct.columns)
    )
    hits = _robbery_hits(direct, approach_px_s, shrink).unionByName(
        _robbery_hits(looked_up, approach_px_s, shrink)
    )
    first = Window.partitionBy(*SCENE, "track_a", "track_b").orderBy("frame_number")
    conf = (
        0.48
        + F.least(F.lit(0.30), F.col("approach_px_s") / 200.0)
        + (1.0 - F.col("shrink_ratio")) * 0.20
    )
    return (
        hits.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(
            *FRAME,
            F.lit("ANOMALY_ROBBERY").alias("event_type"),
            "start_time",
            "end_time",
            S.clamp_confidence(F.least(F.lit(0.85), conf)).alias("confidence"),
            "track_a",
            "track_b",
            "approach_px_s",
            "shrink_ratio",
        )
    )


def road_accident(
    detections: DataFrame, collision_iou: float = 0.10, min_speed: float = 15.0
) -> DataFrame:
    """Overlapping vehicles of which at least one was moving."""
    vehicles = _rows(_tracked(detections, vocab.ANOMALY_VEHICLES), "vx", "vy")
    sa, sb = S.speed(F.col("a_vx"), F.col("a_vy")), S.speed(F.col("b_vx"), F.col("b_vy"))
    hits = (
        same_frame_pairs(vehicles)
        .withColumn("collision_iou", G.iou(G.box("a_"), G.box("b_")))
        .withColumn("speed_a", sa)
        .withColumn("speed_b", sb)
        .where(F.col("collision_iou") >= collision_iou)
        .where(F.greatest("speed_a", "speed_b") >= min_speed)
    )
    conf = (
        0.60
        + F.col("collision_iou") * 0.5
        + F.least(F.lit(0.15), F.greatest("speed_a", "speed_b") / 300.0)
    )
    return _one_per_pair(hits).select(
        *FRAME,
        F.lit("ANOMALY_ROAD_ACCIDENT").alias("event_type"),
        F.col("a_ts").alias("start_time"),
        F.col("b_ts").alias("end_time"),
        S.clamp_confidence(F.least(F.lit(0.92), conf)).alias("confidence"),
        F.col("a_track_id").alias("track_a"),
        F.col("b_track_id").alias("track_b"),
        F.col("a_object_type").alias("object_type"),
        "collision_iou",
        "speed_a",
        "speed_b",
    )


def pedestrian_struck(
    detections: DataFrame, contact_iou: float = 0.05, min_speed: float = 7.5
) -> DataFrame:
    """A moving vehicle overlapping a person."""
    vehicles = _rows(_tracked(detections, vocab.ANOMALY_VEHICLES), "vx", "vy").where(
        S.speed(F.col("vx"), F.col("vy")) >= min_speed
    )
    persons = _rows(_tracked(detections, ["person"]))
    hits = (
        near_box_pairs(vehicles, persons, FRAME)
        .withColumn("contact_iou", G.iou(G.box("a_"), G.box("b_")))
        .withColumn("vehicle_speed", S.speed(F.col("a_vx"), F.col("a_vy")))
        .where(F.col("contact_iou") >= contact_iou)
    )
    first = Window.partitionBy("frame_number", "a_track_id", "b_track_id", *SCENE).orderBy("a_det_id", "b_det_id")
    conf = (
        0.65
        + F.col("contact_iou") * 0.4
        + F.least(F.lit(0.15), F.col("vehicle_speed") / 300.0)
    )
    return (
        hits.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(
            *FRAME,
            F.lit("ANOMALY_PEDESTRIAN_STRUCK").alias("event_type"),
            F.col("a_ts").alias("start_time"),
            F.col("b_ts").alias("end_time"),
            S.clamp_confidence(F.least(F.lit(0.93), conf)).alias("confidence"),
            F.col("a_track_id").alias("vehicle_track"),
            F.col("b_track_id").alias("pedestrian_track"),
            F.col("a_object_type").alias("object_type"),
            "contact_iou",
            "vehicle_speed",
        )
    )


def crowd_panic(
    detections: DataFrame,
    min_persons: int = 5,
    min_spread_deg: float = 45.0,
    fast_share: float = 0.5,
) -> DataFrame:
    """Frames with many persons running apart: one pass of partial sums per frame."""
    persons = _tracked(detections, ["person"])
    fast = S.speed(F.col("vx"), F.col("vy")) > 10.0
    angle = F.atan2("vy", "vx")
    frames = (
        persons.groupBy(*FRAME)
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.count(F.lit(1)).alias("person_count"),
            F.count_if(fast).alias("fast_count"),
            F.sum(F.when(fast, F.sin(angle)).otherwise(0.0)).alias("_sin"),
            F.sum(F.when(fast, F.cos(angle)).otherwise(0.0)).alias("_cos"),
        )
        .where((F.col("person_count") >= min_persons) & (F.col("fast_count") >= 2))
        .where(F.col("fast_count") >= min_persons * fast_share)
        .withColumn(
            "spread_deg",
            S.circular_std_degrees(F.col("_sin"), F.col("_cos"), F.col("fast_count")),
        )
        .where(F.col("spread_deg") >= min_spread_deg)
    )
    conf = (
        0.45
        + F.least(F.lit(0.30), F.col("spread_deg") / 180.0)
        + F.col("person_count") * 0.03
    )
    return frames.select(
        *FRAME,
        F.lit("ANOMALY_CROWD_PANIC").alias("event_type"),
        "start_time",
        "end_time",
        S.clamp_confidence(F.least(F.lit(0.85), conf)).alias("confidence"),
        "person_count",
        "fast_count",
        "spread_deg",
    )


def _extent(df: DataFrame) -> list[Column]:
    return [
        F.min("x1").alias("x1"),
        F.min("y1").alias("y1"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
    ]


#: Microseconds of a slice of an object's rows.
VANDAL_SLICE_US = 16_000_000


def vandalism(
    detections: DataFrame,
    dwell_s: float = 3.0,
    max_displacement: float = 80.0,
    reach_px: float = 100.0,
) -> DataFrame:
    """A lingering person near an object whose box falls below half its size meanwhile.

    Track pairs are pruned on a grid by the extent of the object's whole track before the
    object's rows inside the person's interval are looked at.
    """
    seq = sequence_key(F.col("ts"), F.col("det_id"))
    tracked = _tracked(detections).withColumn("seq", seq).withColumn("us", F.unix_micros("ts"))
    ends = [
        f(c, "seq").alias(f"{n}{c}")
        for n, f in (("f_", F.min_by), ("l_", F.max_by))
        for c in ("x1", "y1", "x2", "y2")
    ]
    people = (
        tracked.where("object_type = 'person'")
        .groupBy(*TRACK)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min("us").alias("us0"),
            F.max("us").alias("us1"),
            *ends,
        )
        .withColumn("dwell_s", (F.col("us1") - F.col("us0")) / F.lit(1e6))
        .where((F.col("points") >= 2) & (F.col("dwell_s") >= dwell_s))
        .where(G.center_distance(G.box("f_"), G.box("l_")) <= max_displacement)
        .select(
            *SCENE,
            "track_id",
            "us0",
            "us1",
            "dwell_s",
            *(F.col(f"f_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")),
        )
    )
    things = tracked.where(F.col("object_type").isin(vocab.VANDALISM_OBJECTS))
    extents = things.groupBy(*TRACK).agg(
        F.min("us").alias("us0"), F.max("us").alias("us1"), F.min("seq").alias("first_seq"),
        *_extent(things),
    )
    pairs = near_box_pairs(people, extents, SCENE, reach_px / 2).where(
        (F.col("a_us0") <= F.col("b_us1")) & (F.col("b_us0") <= F.col("a_us1"))
    )
    rows = things.select(
        *SCENE, F.col("track_id").alias("b_track_id"), "us", "seq",
        *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")),
    )
    obox = G.box("o_")
    # the part of the person's stay in which the object was there
    start, end = F.greatest("a_us0", "b_us0"), F.least("a_us1", "b_us1")
    seen = (
        interval_rows(pairs, rows, start, end, "us", VANDAL_SLICE_US, [*SCENE, "b_track_id"])
        .groupBy(
            *SCENE, "a_track_id", "b_track_id", "b_first_seq", "a_us0", "a_us1", "a_dwell_s"
        )
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min_by(G.edge_distance(G.box("a_"), obox), "seq").alias("edge0"),
            F.min_by(G.area(obox), "seq").alias("area0"),
            F.max_by(G.area(obox), "seq").alias("area1"),
        )
        .where((F.col("points") >= 2) & (F.col("edge0") <= reach_px))
        .where(F.col("area1") < F.col("area0") * 0.50)
    )
    first = Window.partitionBy(*SCENE, "a_track_id").orderBy("b_first_seq")
    ratio = F.col("area1") / F.greatest(F.lit(1.0), F.col("area0"))
    conf = 0.45 + F.least(F.lit(0.30), F.col("a_dwell_s") / 30.0) + (1.0 - ratio) * 0.15
    return (
        seen.withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select(
            *SCENE,
            F.lit("ANOMALY_VANDALISM").alias("event_type"),
            F.timestamp_micros("a_us0").alias("start_time"),
            F.timestamp_micros("a_us1").alias("end_time"),
            S.clamp_confidence(F.least(F.lit(0.82), conf)).alias("confidence"),
            F.col("a_track_id").alias("track_id"),
            F.col("b_track_id").alias("object_track"),
            F.col("a_dwell_s").alias("dwell_s"),
            ratio.alias("object_area_ratio"),
        )
    )


def shoplifting(detections: DataFrame, min_aspect: float = 1.6) -> DataFrame:
    """First crouched posture of a person track; ends three rows later or at the last row."""
    persons = _rows(_tracked(detections, ["person"])).withColumn(
        "seq", sequence_key(F.col("ts"), F.col("det_id"))
    )
    ratio = G.aspect(G.box())
    hit = (
        persons.where(ratio >= min_aspect).groupBy(*TRACK).agg(F.min("seq").alias("hit"))
    )
    following = Window.partitionBy(*TRACK).orderBy("seq")
    window4 = (
        persons.withColumn("aspect_ratio", ratio)
        .join(hit, TRACK)
        .where(F.col("seq") >= F.col("hit"))
        .withColumn("_rn", F.row_number().over(following))
        .where("_rn <= 4")
        .groupBy(*TRACK)
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.min_by("aspect_ratio", "seq").alias("aspect_ratio"),
        )
    )
    conf = 0.42 + F.least(F.lit(0.30), (F.col("aspect_ratio") - min_aspect) * 0.2)
    return window4.select(
        *TRACK,
        F.lit("ANOMALY_SHOPLIFTING").alias("event_type"),
        "start_time",
        "end_time",
        S.clamp_confidence(F.least(F.lit(0.75), conf)).alias("confidence"),
        "aspect_ratio",
    )
