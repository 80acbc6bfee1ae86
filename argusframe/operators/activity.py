"""Sessions of detections, activity islands of events, motion, summaries and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions import geometry as G, scalars as S
from argusframe.operators import vocab
from argusframe.operators.slicing import (
    DEFAULT_SLICE_SECONDS,
    island_rows,
    islands,
    lag_in_slices,
    null_safe_join,
    range_slice,
    sequence_key,
    sessions,
    time_slice,
)

SCENE = ["video_id", "camera_id"]
OBJECT = [*SCENE, "object_type", "track_id"]

# ---- Fixed values: texts of the rebuilt activities and of the video summary ----
ACTIVITY_TITLES = {
    "POSSIBLE_VEHICLE_INTERACTION": "Possible vehicle interaction",
    "PERSON_VEHICLE_ACTIVITY": "Person and vehicle activity",
    "PERSON_OBJECT_ACTIVITY": "Person and object activity",
    "MOTION_ACTIVITY": "Motion activity detected",
    "GENERAL_ACTIVITY": "Detected activity",
}
HEADLINES = {
    "POSSIBLE_VEHICLE_INTERACTION": "Possible vehicle interaction detected",
    "PERSON_VEHICLE_ACTIVITY": "Person and vehicle activity detected",
    "PERSON_OBJECT_ACTIVITY": "Person and object activity detected",
    "MOTION_ACTIVITY": "Significant scene activity detected",
    "GENERAL_ACTIVITY": "Detected activity in video",
}
EMPTY_HEADLINE = "No significant activity detected"


def _session_inputs(detections: DataFrame) -> DataFrame:
    return detections.withColumn("us", F.unix_micros("ts"))


def session_sizes(
    detections: DataFrame, max_gap_s: float = 3.0, slice_seconds: int = DEFAULT_SLICE_SECONDS
) -> DataFrame:
    """Gap sessions per camera, class and track: start, end and number of rows."""
    gap = int(max_gap_s * 1_000_000)
    out = sessions(
        _session_inputs(detections),
        OBJECT,
        F.col("us"),
        horizon=gap,
        width=slice_seconds * 1_000_000,
        fields=["us"],
        opens=lambda prev: F.col("us") - prev["us"] > gap,
        values=lambda prev: {},
        partial={"n": F.count(F.lit(1)), "us1": F.max("us")},
        merge={"n": F.sum("n"), "us1": F.max("us1")},
        tie=("det_id",),
        island="us0",
    )
    return out.select(
        *OBJECT,
        F.timestamp_micros("us0").alias("start_time"),
        F.timestamp_micros("us1").alias("end_time"),
        F.col("n").alias("detection_count"),
    )


def velocity(prev: Column) -> tuple[Column, Column]:
    """Given velocity, or the centre shift since `prev` when it is nearly zero."""
    cx, cy = G.center(G.box())
    px, py = G.center(G.box_of(prev))
    dt = F.greatest(F.lit(0.05), S.seconds_between(F.col("ts"), prev["ts"]))
    still = (S.speed(F.col("vx"), F.col("vy")) < 0.1) & prev.isNotNull()
    return (
        F.when(still, (cx - px) / dt).otherwise(F.col("vx")),
        F.when(still, (cy - py) / dt).otherwise(F.col("vy")),
    )


def velocity_backfill(detections: DataFrame, slice_seconds: int = 900) -> DataFrame:
    """Detections with `ivx`, `ivy`, `speed`; the look back spans the whole track."""
    keyed = detections.withColumn("seq", sequence_key(F.col("ts"), F.col("det_id")))
    lagged = lag_in_slices(
        keyed,
        [*SCENE, "track_id"],
        ["seq"],
        ["ts", "x1", "y1", "x2", "y2"],
        time_slice(F.col("ts"), slice_seconds),
    )
    ivx, ivy = velocity(F.col("prev"))
    return (
        lagged.withColumn("ivx", ivx)
        .withColumn("ivy", ivy)
        .withColumn("speed", S.speed(F.col("ivx"), F.col("ivy")))
        .drop("prev")
    )


def _end_points() -> dict[str, Column]:
    cx, cy = G.center(G.box())
    return {
        "cx0": F.min_by(cx, "seq"),
        "cy0": F.min_by(cy, "seq"),
        "cx1": F.max_by(cx, "seq"),
        "cy1": F.max_by(cy, "seq"),
    }


def kinematics(df: DataFrame, loiter_types: list[str] | None) -> DataFrame:
    """Displacement, speed, heading and loitering from end points and speed sums."""
    dx, dy = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    dur = F.greatest(F.lit(0.1), (F.col("us1") - F.col("us0")) / F.lit(1e6))
    mean = F.when(F.col("n_speed") > 0, F.col("sum_speed") / F.col("n_speed")).otherwise(0.0)
    out = (
        df.withColumn("duration_s", dur)
        .withColumn("displacement", G.norm(dx, dy))
        .withColumn("avg_speed", F.greatest(F.col("displacement") / F.col("duration_s"), mean))
        .withColumn(
            "direction",
            F.when(
                (F.col("displacement") >= 15.0) | (F.col("avg_speed") >= 5.0),
                S.heading(dx / F.col("duration_s"), dy / F.col("duration_s")),
            ).otherwise(S.STATIONARY),
        )
    )
    lingering = (F.col("duration_s") >= 3.0) & (F.col("displacement") <= 60.0)
    if loiter_types is not None:
        lingering = lingering & F.col("object_type").isin(loiter_types)
    return out.withColumn("is_loitering", lingering)


def detection_events(
    detections: DataFrame,
    max_gap_s: float = 3.0,
    min_observations: int = 1,
    min_duration_s: float = 0.0,
    slice_seconds: int = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """One event per session of an object, with its kinematics.

    Untracked rows of a class form their own group per camera. `verified` is carried when the
    input has it.
    """
    gap = int(max_gap_s * 1_000_000)
    rows = _session_inputs(detections).withColumn(
        "seq", sequence_key(F.col("ts"), F.col("det_id"))
    )
    has_verified = "verified" in detections.columns

    def values(prev: Column) -> dict[str, Column]:
        ivx, ivy = velocity(prev)
        return {"speed": S.speed(ivx, ivy)}

    moving = F.col("speed") > 0
    partial = {
        "us1": F.max("us"),
        "n": F.count(F.lit(1)),
        "confidence": F.max("confidence"),
        "first_frame": F.min_by("frame_number", "seq"),
        "last_frame": F.max_by("frame_number", "seq"),
        "sum_speed": F.sum(F.when(moving, F.col("speed")).otherwise(0.0)),
        "n_speed": F.count_if(moving),
        "seq0": F.min("seq"),
        "seq1": F.max("seq"),
        **_end_points(),
    }
    merge = {
        "us1": F.max("us1"),
        "n": F.sum("n"),
        "confidence": F.max("confidence"),
        "first_frame": F.min_by("first_frame", "seq0"),
        "last_frame": F.max_by("last_frame", "seq1"),
        "sum_speed": F.sum("sum_speed"),
        "n_speed": F.sum("n_speed"),
        "cx0": F.min_by("cx0", "seq0"),
        "cy0": F.min_by("cy0", "seq0"),
        "cx1": F.max_by("cx1", "seq1"),
        "cy1": F.max_by("cy1", "seq1"),
    }
    if has_verified:
        partial["verified"] = F.bool_or("verified")
        merge["verified"] = F.bool_or("verified")
    grouped = sessions(
        rows,
        OBJECT,
        F.col("us"),
        horizon=gap,
        width=slice_seconds * 1_000_000,
        fields=["us", "ts", "x1", "y1", "x2", "y2"],
        opens=lambda prev: F.col("us") - prev["us"] > gap,
        values=values,
        partial=partial,
        merge=merge,
        tie=("det_id",),
        island="us0",
    ).where(
        (F.col("n") >= min_observations)
        & ((F.col("us1") - F.col("us0")) / F.lit(1e6) >= min_duration_s)
    )
    return kinematics(grouped, vocab.LOITERING_TYPES).select(
        *SCENE,
        F.concat(F.upper("object_type"), F.lit("_DETECTED")).alias("event_type"),
        F.timestamp_micros("us0").alias("start_time"),
        F.timestamp_micros("us1").alias("end_time"),
        "confidence",
        "track_id",
        "object_type",
        S.entity_id(F.col("object_type"), F.col("track_id")).alias("entity_id"),
        F.col("n").alias("detection_count"),
        "first_frame",
        "last_frame",
        "displacement",
        "avg_speed",
        "direction",
        "is_loitering",
        "cx0",
        "cy0",
        "cx1",
        "cy1",
        *(["verified"] if has_verified else []),
    )


def motion_events(
    samples: DataFrame,
    threshold: float = 0.01,
    min_event_s: float = 1.0,
    max_gap_s: float = 2.0,
    slice_seconds: float = 900,
) -> DataFrame:
    """Motion intervals: only a quiet sample late after the last hit closes one.

    `samples`: video_id, frame_number, pts (seconds), score.
    """
    flagged = samples.select(
        "video_id", "frame_number", "pts", "score", (F.col("score") >= threshold).alias("hit")
    )
    with_prev = lag_in_slices(
        flagged,
        ["video_id"],
        ["pts", "frame_number"],
        ["pts", "hit"],
        range_slice(F.col("pts"), slice_seconds),
    )
    hits = with_prev.where("hit").select(
        "video_id",
        "pts",
        "score",
        F.round(F.col("pts") * 1e6).cast("bigint").alias("us"),
        F.when(~F.col("prev.hit"), F.col("prev.pts")).alias("quiet_pts"),
    )
    found = islands(
        hits,
        ["video_id"],
        "us",
        ["pts"],
        lambda prev: F.coalesce(F.col("quiet_pts") - prev["pts"] > max_gap_s, F.lit(False)),
        range_slice(F.col("pts"), slice_seconds),
        {"s": F.min("pts"), "e": F.max("pts"), "peak": F.max("score")},
        {"s": F.min("s"), "e": F.max("e"), "peak": F.max("peak")},
    )
    return found.where(F.col("e") - F.col("s") >= min_event_s).select(
        "video_id",
        F.col("s").alias("start_seconds"),
        F.col("e").alias("end_seconds"),
        F.col("peak").alias("peak_score"),
    )


def _event_seq(events: DataFrame) -> DataFrame:
    return events.withColumn("seq", sequence_key(F.col("start_time"), F.col("event_id")))


def _breaks(gap_s: float):
    return lambda prev: S.seconds_between(F.col("start_time"), prev["end_time"]) > gap_s


def interval_islands(
    events: DataFrame, max_gap_s: float = 3.0, slice_seconds: float = 900
) -> DataFrame:
    """Runs of events of a video, compared with the end of the event before each."""
    return islands(
        _event_seq(events),
        ["video_id"],
        "seq",
        ["end_time"],
        _breaks(max_gap_s),
        time_slice(F.col("start_time"), slice_seconds),
        {"n": F.count(F.lit(1)), "s": F.min("start_time"), "e": F.max("end_time")},
        {"n": F.sum("n"), "s": F.min("s"), "e": F.max("e")},
    ).select(
        "video_id",
        F.col("s").alias("start_time"),
        F.col("e").alias("end_time"),
        F.col("n").alias("event_count"),
    )


def reconstruct_events(
    events: DataFrame,
    max_gap_s: float = 3.0,
    vehicle_gap_s: float = 1.5,
    vehicle_conf: float = 0.60,
    slice_seconds: float = 900,
) -> DataFrame:
    """Activities of a video: islands of events, each named by the first rule that matches.

    Two strong vehicle events are near when a later one starts at most `vehicle_gap_s` after
    an earlier one ends; as the next one in start order starts soonest, comparing neighbours
    decides it.
    """
    slice_by = time_slice(F.col("start_time"), slice_seconds)
    rows = island_rows(
        _event_seq(events), ["video_id"], "seq", ["end_time"], _breaks(max_gap_s), slice_by
    )
    is_vehicle = F.coalesce(F.col("object_type").isin(vocab.RULE_VEHICLES), F.lit(False))
    grouped = rows.groupBy("video_id", "island").agg(
        F.max(F.when(F.col("seq") == F.col("island"), F.col("camera_id"))).alias("camera_id"),
        F.min("start_time").alias("s"),
        F.max("end_time").alias("e"),
        F.max("confidence").alias("c"),
        F.min(F.when(is_vehicle, F.col("start_time"))).alias("vs"),
        F.max(F.when(is_vehicle, F.col("end_time"))).alias("ve"),
        F.max(F.when(is_vehicle, F.col("confidence"))).alias("vc"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_vehicle).alias("nv"),
        F.coalesce(F.bool_or(F.col("object_type") == "person"), F.lit(False)).alias("people"),
        F.bool_or(F.col("event_type") == "MOTION").alias("motion"),
        F.array_sort(F.collect_set(F.when(F.col("object_type") != "", F.col("object_type")))).alias(
            "objects"
        ),
    )
    strong = rows.where(is_vehicle & (F.col("confidence") >= vehicle_conf)).select(
        "video_id", "island", "seq", "start_time", "end_time"
    )
    near = (
        lag_in_slices(strong, ["video_id"], ["seq"], ["island", "end_time"], slice_by)
        .where(
            (F.col("prev.island") == F.col("island"))
            & (S.seconds_between(F.col("start_time"), F.col("prev.end_time")) <= vehicle_gap_s)
        )
        .groupBy("video_id", "island")
        .agg(F.lit(True).alias("interaction"))
    )
    out = grouped.join(near, ["video_id", "island"], "left")
    rule = (
        F.when(F.col("interaction"), "POSSIBLE_VEHICLE_INTERACTION")
        .when(F.col("people") & (F.col("nv") > 0), "PERSON_VEHICLE_ACTIVITY")
        .when(F.col("people") & (F.size("objects") >= 2), "PERSON_OBJECT_ACTIVITY")
        .when(F.col("motion"), "MOTION_ACTIVITY")
        .otherwise("GENERAL_ACTIVITY")
    )
    inter = F.coalesce("interaction", F.lit(False))
    titles = F.create_map(*(F.lit(x) for kv in ACTIVITY_TITLES.items() for x in kv))
    return out.withColumn("event_type", rule).select(
        "video_id",
        "camera_id",
        "event_type",
        titles[F.col("event_type")].alias("title"),
        F.when(inter, F.col("vs")).otherwise(F.col("s")).alias("start_time"),
        F.when(inter, F.col("ve")).otherwise(F.col("e")).alias("end_time"),
        F.coalesce(F.when(inter, F.col("vc")).otherwise(F.col("c")), F.lit(0.0)).alias("confidence"),
        "objects",
        F.when(inter, F.col("nv")).otherwise(F.col("n")).alias("evidence_count"),
    )


def video_summary(activities: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per video: headline by priority, span, objects, count and confidence label."""
    has = lambda t: F.bool_or(F.col("event_type") == t)
    kinds = list(HEADLINES)
    grouped = activities.groupBy("video_id").agg(
        F.min("start_time").alias("start_time"),
        F.max(F.struct("start_time", "end_time")).alias("_last"),
        F.count(F.lit(1)).alias("event_count"),
        F.max("confidence").alias("confidence"),
        *(has(k).alias(f"_has{i}") for i, k in enumerate(kinds)),
    )
    headline = F.lit(HEADLINES[kinds[-1]])
    for i in reversed(range(len(kinds) - 1)):
        headline = F.when(F.col(f"_has{i}"), HEADLINES[kinds[i]]).otherwise(headline)
    # one entry per object type, however many activities name it
    objects = (
        activities.select("video_id", F.explode("objects").alias("object"))
        .groupBy("video_id")
        .agg(F.array_sort(F.collect_set("object")).alias("objects"))
    )
    grouped = grouped.withColumn("end_time", F.col("_last.end_time"))
    joined = videos.select("video_id").distinct().join(grouped, "video_id", "left")
    joined = joined.join(objects, "video_id", "left")
    empty = F.col("event_count").isNull()
    return joined.select(
        "video_id",
        F.when(empty, EMPTY_HEADLINE).otherwise(headline).alias("headline"),
        "start_time",
        "end_time",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("objects", F.array().cast("array<string>")).alias("objects_detected"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(~empty, S.confidence_label(F.col("confidence"))).alias("confidence_label"),
    )


def summary_key_events(activities: DataFrame) -> DataFrame:
    """Lines of the summary, one row each, so that a long video needs no single array."""
    return activities.select(
        "video_id",
        "start_time",
        F.concat_ws(" - ", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"), "title").alias("line"),
    )


def track_spans(events: DataFrame) -> DataFrame:
    """Events condensed per camera, track and class, with the last moving heading.

    `events` has direction, avg_speed, is_loitering, and the first and last observed centre
    (cx0..cy1) with the number of observations for the fallback.
    """
    keyed = events.where(F.col("start_time").isNotNull()).select(
        F.coalesce("camera_id", F.lit("CH-0")).alias("camera_id"),
        F.coalesce(F.col("track_id").cast("string"), F.lit("0")).alias("track_id"),
        F.lower(F.coalesce("object_type", "event_type", F.lit("object"))).alias("object_type"),
        "start_time",
        F.coalesce("end_time", "start_time").alias("end_time"),
        F.unix_micros("start_time").alias("at"),
        "direction",
        "avg_speed",
        "is_loitering",
        "detection_count",
        "cx0",
        "cy0",
        "cx1",
        "cy1",
    )
    moving = F.when(F.col("direction") != S.STATIONARY, F.col("at"))
    grouped = (
        keyed.groupBy("camera_id", "track_id", "object_type")
        .agg(
            F.min("at").alias("us0"),
            F.max_by(F.unix_micros("end_time"), "at").alias("us1"),
            F.count(F.lit(1)).alias("observation_count"),
            F.max_by("direction", moving).alias("_dir"),
            F.coalesce(F.max("avg_speed"), F.lit(0.0)).alias("_speed"),
            F.coalesce(F.bool_or("is_loitering"), F.lit(False)).alias("_loiter"),
            F.sum("detection_count").alias("_boxes"),
            F.min_by("cx0", "at").alias("cx0"),
            F.min_by("cy0", "at").alias("cy0"),
            F.max_by("cx1", "at").alias("cx1"),
            F.max_by("cy1", "at").alias("cy1"),
        )
        .withColumn("duration_s", F.greatest(F.lit(0.1), (F.col("us1") - F.col("us0")) / F.lit(1e6)))
    )
    direction = F.coalesce("_dir", F.lit(S.STATIONARY))
    dx, dy = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    disp = G.norm(dx, dy)
    calc = disp / F.col("duration_s")
    fallback = ((direction == S.STATIONARY) | (F.col("_speed") == 0.0)) & (F.col("_boxes") >= 2)
    redo = fallback & ((disp >= 15.0) | (calc >= 5.0))
    linger = (
        fallback
        & (F.col("duration_s") >= 3.0)
        & (disp <= 60.0)
        & F.col("object_type").isin(vocab.LOITERING_TYPES)
    )
    return grouped.select(
        "camera_id",
        "track_id",
        "object_type",
        F.timestamp_micros("us0").alias("start_time"),
        F.timestamp_micros("us1").alias("end_time"),
        "duration_s",
        "observation_count",
        F.when(redo, S.heading(dx / F.col("duration_s"), dy / F.col("duration_s")))
        .otherwise(direction)
        .alias("direction"),
        F.when(redo, calc).otherwise(F.col("_speed")).alias("avg_speed"),
        (F.col("_loiter") | F.coalesce(linger, F.lit(False))).alias("is_loitering"),
    )


def _digest_flags(events: DataFrame) -> DataFrame:
    obj = F.coalesce("object_type", F.lit("object"))
    dur = S.seconds_between(F.col("end_time"), F.col("start_time"))
    direction = F.coalesce("direction", F.lit(S.STATIONARY))
    fast = F.coalesce("avg_speed", F.lit(0.0)) >= 5.0
    linger = F.coalesce("is_loitering", F.lit(False)) | (
        (dur >= 4.0) & (direction == S.STATIONARY) & obj.isin(vocab.LOITERING_TYPES)
    )
    review = F.col("event_type").rlike("REVIEW_FLAG|PROXIMITY|COLLISION")
    return (
        events.withColumn("_obj", obj)
        .withColumn("_dur", dur)
        .withColumn("_direction", direction)
        .withColumn("_linger", linger)
        .withColumn("_moves", ~F.col("_linger") & (direction != S.STATIONARY) & fast)
        .withColumn("_review", review)
    )


def activity_digest(events: DataFrame, suppressed_noise: int = 0) -> DataFrame:
    """Counts and time range of a video's events."""
    return (
        _digest_flags(events)
        .groupBy("video_id")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if("_linger").alias("loitering_events"),
            F.count_if("_moves").alias("movement_highlights"),
            F.count_if("_review").alias("review_flags"),
            F.date_format(F.min("start_time"), "HH:mm:ss").alias("range_start"),
            F.date_format(F.max("end_time"), "HH:mm:ss").alias("range_end"),
        )
        .withColumn("suppressed_noise", F.lit(suppressed_noise))
    )


def digest_entities(events: DataFrame) -> DataFrame:
    """Distinct tracks (or entity ids of untracked rows) per video and class."""
    ident = F.coalesce(F.col("track_id").cast("string"), "entity_id", F.concat("_obj", F.lit("#unknown")))
    return (
        _digest_flags(events)
        .select("video_id", F.col("_obj").alias("object_type"), ident.alias("ident"))
        .distinct()
        .groupBy("video_id", "object_type")
        .agg(F.count(F.lit(1)).alias("entities"))
    )


def digest_items(events: DataFrame) -> DataFrame:
    """Report lines of the digest, one row per listed event and section."""
    d = _digest_flags(events)
    s, e = F.date_format("start_time", "HH:mm:ss"), F.date_format("end_time", "HH:mm:ss")
    name = F.coalesce("entity_id", F.concat("_obj", F.lit("#unknown")))
    secs = S.fixed(F.col("_dur"))
    linger_line = F.concat(
        F.lit("- **"), name, F.lit("**: Loitering for "), secs, F.lit("s (`"), s, F.lit("` - `"),
        e, F.lit("` on "), F.col("camera_id"), F.lit(")"),
    )
    move_line = F.concat(
        F.lit("- **"), name, F.lit("**: "), F.col("_direction"), F.lit(" at ~"),
        S.fixed(F.coalesce("avg_speed", F.lit(0.0))),
        F.lit(" px/s (`"), s, F.lit("` - `"), e, F.lit("`)"),
    )
    flag_line = F.concat(F.lit("- `["), s, F.lit("]` **"), F.col("event_type"), F.lit("**"))
    sections = F.array(
        F.when(F.col("_linger"), F.struct(F.lit("loitering").alias("section"), linger_line.alias("line"))),
        F.when(F.col("_moves"), F.struct(F.lit("movement").alias("section"), move_line.alias("line"))),
        F.when(F.col("_review"), F.struct(F.lit("review").alias("section"), flag_line.alias("line"))),
    )
    return d.select("video_id", "start_time", F.explode(F.array_compact(sections)).alias("i")).select(
        "video_id", "start_time", "i.section", "i.line"
    )


def all_events(families: list[DataFrame]) -> DataFrame:
    """Union of event families on the shared event columns."""
    shared = ["video_id", "camera_id", "event_type", "start_time", "end_time", "confidence"]
    out = None
    for f in families:
        part = f.select(
            *(c if c in f.columns else F.lit(None).alias(c) for c in shared),
            (F.col("track_id") if "track_id" in f.columns else F.lit(None)).cast("bigint").alias("track_id"),
            (F.col("object_type") if "object_type" in f.columns else F.lit(None)).cast("string").alias("object_type"),
        )
        out = part if out is None else out.unionByName(part)
    return out
