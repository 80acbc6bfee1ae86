"""Whole-track summaries and the incidents drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions import geometry as G, scalars as S
from argusframe.operators import vocab
from argusframe.operators.activity import kinematics, velocity_backfill
from argusframe.operators.grid import near_box_pairs, point_cell, point_cells
from argusframe.operators.pairs import pair_rows
from argusframe.operators.slicing import SLICE, lag_in_slices, range_slice, sequence_key, time_slice

SCENE = ["video_id", "camera_id"]
TRACK = [*SCENE, "track_id"]
BAND_S = 0.6
#: Time buckets of a slice of a track.
PAIR_SLICE = 32


def sudden_changes(
    detections: DataFrame, min_delta: float = 40.0, slice_seconds: int = 900
) -> DataFrame:
    """Tracks with a jump between consecutive non-zero speeds."""
    moving = (
        velocity_backfill(detections.where("track_id IS NOT NULL"), slice_seconds)
        .where("speed > 0")
        .select(*TRACK, "seq", "ts", "speed")
    )
    return (
        lag_in_slices(moving, TRACK, ["seq"], ["speed"], time_slice(F.col("ts"), slice_seconds))
        .where(F.col("prev").isNotNull())
        .groupBy(*TRACK)
        .agg(F.max(F.abs(F.col("speed") - F.col("prev.speed"))).alias("max_speed_delta"))
        .where(F.col("max_speed_delta") >= min_delta)
    )


def track_summaries(detections: DataFrame, slice_seconds: int = 900) -> DataFrame:
    """One row per track; the class is that of its first row.

    A first aggregation per (track, class) keeps every buffer primitive, so it runs as a hash
    aggregation with map-side combine; the second one sees one row per track and class.
    """
    rows = velocity_backfill(detections.where("track_id IS NOT NULL"), slice_seconds)
    cx, cy = G.center(G.box())
    moving = F.col("speed") > 0
    per_class = rows.groupBy(*TRACK, F.lower("object_type").alias("object_type")).agg(
        F.min("seq").alias("seq0"),
        F.max("seq").alias("seq1"),
        F.min(F.unix_micros("ts")).alias("us0"),
        F.max(F.unix_micros("ts")).alias("us1"),
        F.count(F.lit(1)).alias("n"),
        F.max("confidence").alias("confidence"),
        F.sum(F.when(moving, F.col("speed")).otherwise(0.0)).alias("sum_speed"),
        F.count_if(moving).alias("n_speed"),
        F.min_by(cx, "seq").alias("cx0"),
        F.min_by(cy, "seq").alias("cy0"),
        F.max_by(cx, "seq").alias("cx1"),
        F.max_by(cy, "seq").alias("cy1"),
    )
    per_track = per_class.groupBy(*TRACK).agg(
        F.min_by("object_type", "seq0").alias("object_type"),
        F.min("seq0").alias("first_seq"),
        F.min("us0").alias("us0"),
        F.max("us1").alias("us1"),
        F.sum("n").alias("observations"),
        F.max("confidence").alias("confidence"),
        F.sum("sum_speed").alias("sum_speed"),
        F.sum("n_speed").alias("n_speed"),
        F.min_by("cx0", "seq0").alias("cx0"),
        F.min_by("cy0", "seq0").alias("cy0"),
        F.max_by("cx1", "seq1").alias("cx1"),
        F.max_by("cy1", "seq1").alias("cy1"),
    )
    jumps = sudden_changes(detections, slice_seconds=slice_seconds).select(
        *TRACK, F.lit(True).alias("has_sudden_change")
    )
    return (
        kinematics(per_track, None)
        .join(jumps, TRACK, "left")
        .withColumn("has_sudden_change", F.coalesce("has_sudden_change", F.lit(False)))
        .drop("sum_speed", "n_speed")
    )


def track_incidents(tracks: DataFrame) -> DataFrame:
    """Presence, loitering, fleeing, speed-shift and off-hours rows of each track."""

    def row(kind: Column | str, conf: Column | float) -> Column:
        k = F.lit(kind) if isinstance(kind, str) else kind
        c = F.lit(conf) if isinstance(conf, float) else conf
        return F.struct(k.alias("event_type"), c.alias("confidence"))

    cls = F.col("object_type")
    start = F.timestamp_micros("us0")
    rows = F.array_compact(
        F.array(
            row(F.concat(F.upper(cls), F.lit("_TRACK")), F.col("confidence")),
            F.when(
                F.col("is_loitering") & cls.isin("person", "vehicle"), row("LOITERING_DETECTED", 0.88)
            ),
            F.when(
                (cls == "person") & (F.col("avg_speed") >= 75.0) & (F.col("displacement") >= 80.0),
                row("RAPID_EGRESS_FLEEING", 0.85),
            ),
            F.when(F.col("has_sudden_change"), row("SUDDEN_VELOCITY_CHANGE", 0.80)),
            F.when(S.off_hours(start), row("OFF_HOURS_PERIMETER_BREACH", 0.85)),
        )
    )
    return tracks.select(
        *TRACK,
        "object_type",
        start.alias("start_time"),
        F.timestamp_micros("us1").alias("end_time"),
        F.explode(rows).alias("r"),
    ).select(*TRACK, "object_type", "r.event_type", "start_time", "end_time", "r.confidence")


def vehicle_crash(tracks: DataFrame) -> DataFrame:
    """Fast vehicle tracks with a sudden speed change."""
    return tracks.where(
        F.col("object_type").isin(vocab.TRACK_VEHICLES)
        & (F.col("avg_speed") >= 40.0)
        & F.col("has_sudden_change")
    ).select(
        *TRACK,
        "object_type",
        F.lit("VEHICLE_CRASH_IMPACT").alias("event_type"),
        F.timestamp_micros("us0").alias("start_time"),
        F.timestamp_micros("us1").alias("end_time"),
        F.lit(0.88).alias("confidence"),
        F.col("avg_speed").alias("pre_speed"),
        "first_seq",
    )


def _time_buckets(us: Column, reach_s: float) -> Column:
    """Buckets of width `2*reach` that an interval of +-reach around a time can touch (<= 2)."""
    size = 2 * int(reach_s * 1_000_000)
    return F.sequence(
        F.floor((us - size // 2) / F.lit(size)), F.floor((us + size // 2) / F.lit(size))
    )


def _time_bucket(us: Column, reach_s: float) -> Column:
    return F.floor(us / F.lit(2 * int(reach_s * 1_000_000)))


def _side(tracks: DataFrame, prefix: str, *cols: str) -> DataFrame:
    return tracks.select(*SCENE, *(F.col(c).alias(prefix + c) for c in cols))


def _with_tracks(pairs: DataFrame, tracks: DataFrame, *cols: str) -> DataFrame:
    """Attach the summaries of both tracks of a pair and put the first-seen one first."""
    need = ("track_id", "first_seq", "us0", "us1", *cols)
    joined = pairs.join(
        _side(tracks, "p_", *need).withColumnRenamed("p_track_id", "t1"), [*SCENE, "t1"]
    ).join(_side(tracks, "q_", *need).withColumnRenamed("q_track_id", "t2"), [*SCENE, "t2"])
    swap = F.col("p_first_seq") > F.col("q_first_seq")
    picks = [
        x
        for c in need[1:]
        for x in (
            F.when(swap, F.col(f"q_{c}")).otherwise(F.col(f"p_{c}")).alias(f"a_{c}"),
            F.when(swap, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}")).alias(f"b_{c}"),
        )
    ]
    rest = [c for c in pairs.columns if c not in (*SCENE, "t1", "t2")]
    return joined.select(
        *SCENE,
        F.when(swap, F.col("t2")).otherwise(F.col("t1")).alias("track_a"),
        F.when(swap, F.col("t1")).otherwise(F.col("t2")).alias("track_b"),
        *picks,
        *rest,
    )


def person_convergence(
    detections: DataFrame, tracks: DataFrame, max_px: float = 150.0
) -> DataFrame:
    """Person tracks that came within reach at nearly the same time.

    Band join on a time-and-space hash: the left side lists the at most eight cells its reach
    can touch, the right side sits in one, so every pair of observations meets once and only
    pairs that can qualify meet at all.
    """
    persons = (
        detections.where("track_id IS NOT NULL")
        .join(
            tracks.where("object_type = 'person'").select(*TRACK), TRACK, "left_semi"
        )
        .select(*TRACK, F.unix_micros("ts").alias("us"), *(c.alias(n) for c, n in zip(G.center(G.box()), ("cx", "cy"))))
    )
    left = (
        persons.withColumn("tb", F.explode(_time_buckets(F.col("us"), BAND_S)))
        .withColumn("cell", F.explode(point_cells(F.col("cx"), F.col("cy"), max_px)))
        .select(*SCENE, "tb", "cell", *(F.col(c).alias(f"a_{c}") for c in ("track_id", "us", "cx", "cy")))
    )
    right = (
        persons.withColumn("tb", _time_bucket(F.col("us"), BAND_S))
        .withColumn("cell", point_cell(F.col("cx"), F.col("cy"), max_px))
        .select(*SCENE, "tb", "cell", *(F.col(c).alias(f"b_{c}") for c in ("track_id", "us", "cx", "cy")))
    )
    dist = G.norm(F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy"))
    pairs = (
        left.hint("merge")
        .join(right, [*SCENE, "tb", "cell"])
        .where(F.col("a_track_id") < F.col("b_track_id"))
        .where(F.abs(F.col("a_us") - F.col("b_us")) <= int(BAND_S * 1_000_000))
        .withColumn("distance", dist)
        .where(F.col("distance") <= max_px)
        .groupBy(*SCENE, F.col("a_track_id").alias("t1"), F.col("b_track_id").alias("t2"))
        .agg(F.min("distance").alias("distance"))
    )
    both = _with_tracks(pairs, tracks)
    s, e = F.greatest("a_us0", "b_us0"), F.least("a_us1", "b_us1")
    return both.where(e >= s).select(
        *SCENE,
        F.lit("MULTI_PERSON_CONVERGENCE").alias("event_type"),
        F.timestamp_micros(s).alias("start_time"),
        F.timestamp_micros(e).alias("end_time"),
        F.lit(0.82).alias("confidence"),
        "track_a",
        "track_b",
        "distance",
    )


def suspect_vehicle(tracks: DataFrame, max_delta_s: float = 4.0) -> DataFrame:
    """Person and vehicle leaving within a few seconds of each other."""
    cols = ("track_id", "object_type", "us0", "us1", "direction", "avg_speed")
    people = _side(tracks.where("object_type = 'person'"), "a_", *cols).withColumn(
        "tb", F.explode(_time_buckets(F.col("a_us1"), max_delta_s))
    )
    vehicles = _side(
        tracks.where(F.col("object_type").isin(vocab.TRACK_VEHICLES)), "b_", *cols
    ).withColumn("tb", _time_bucket(F.col("b_us1"), max_delta_s))
    delta = F.abs(F.col("a_us1") - F.col("b_us1")) / F.lit(1e6)
    return (
        people.join(vehicles, [*SCENE, "tb"])
        .withColumn("departure_delta_s", delta)
        .where(F.col("departure_delta_s") <= max_delta_s)
        .select(
            *SCENE,
            F.lit("SUSPECT_VEHICLE_COORDINATION").alias("event_type"),
            F.timestamp_micros(F.least("a_us0", "b_us0")).alias("start_time"),
            F.timestamp_micros(F.greatest("a_us1", "b_us1")).alias("end_time"),
            F.lit(0.84).alias("confidence"),
            F.col("a_track_id").alias("person_track"),
            F.col("b_track_id").alias("vehicle_track"),
            F.col("b_object_type").alias("object_type"),
            "departure_delta_s",
            F.col("b_direction").alias("vehicle_heading"),
            F.col("b_avg_speed").alias("vehicle_speed"),
        )
    )


def asset_interaction(
    tracks: DataFrame, max_px: float = 100.0, slack_s: float = 2.0
) -> DataFrame:
    """Object last seen near where a person ended, not later than the person plus a slack."""
    cols = ("track_id", "object_type", "us0", "us1", "cx1", "cy1")
    people = _side(tracks.where("object_type = 'person'"), "a_", *cols).withColumn(
        "cell", F.explode(point_cells(F.col("a_cx1"), F.col("a_cy1"), max_px))
    )
    things = _side(
        tracks.where(~F.col("object_type").isin(vocab.TRACK_NON_OBJECTS)), "b_", *cols
    ).withColumn("cell", point_cell(F.col("b_cx1"), F.col("b_cy1"), max_px))
    dist = G.norm(F.col("a_cx1") - F.col("b_cx1"), F.col("a_cy1") - F.col("b_cy1"))
    return (
        people.join(things, [*SCENE, "cell"])
        .withColumn("distance", dist)
        .where(F.col("b_us1") <= F.col("a_us1") + int(slack_s * 1_000_000))
        .where(F.col("distance") <= max_px)
        .select(
            *SCENE,
            F.lit("SUSPICIOUS_ASSET_INTERACTION").alias("event_type"),
            F.timestamp_micros("b_us0").alias("start_time"),
            F.timestamp_micros("a_us1").alias("end_time"),
            F.lit(0.80).alias("confidence"),
            F.col("a_track_id").alias("person_track"),
            F.col("b_track_id").alias("object_track"),
            F.col("b_object_type").alias("object_type"),
            "distance",
        )
    )


def vehicle_collision(
    detections: DataFrame,
    tracks: DataFrame,
    min_iou: float = 0.05,
    max_px: float = 130.0,
    min_speed: float = 15.0,
) -> DataFrame:
    """Vehicle tracks that touched or came near while at least one was moving.

    Candidate track pairs come from a time-and-space hash that cannot miss a qualifying pair;
    exact minimum distance, maximum overlap and impact time are then computed over all their
    nearly simultaneous observations.
    """
    vehicles_t = tracks.where(F.col("object_type").isin(vocab.TRACK_VEHICLES))
    obs = (
        detections.where("track_id IS NOT NULL")
        .join(vehicles_t.select(*TRACK), TRACK, "left_semi")
        .select(*TRACK, F.unix_micros("ts").alias("us"), "x1", "y1", "x2", "y2")
    )
    band = int(BAND_S * 1_000_000)
    spread = obs.withColumn("tb", F.explode(_time_buckets(F.col("us"), BAND_S)))
    single = obs.withColumn("tb", _time_bucket(F.col("us"), BAND_S))
    a, b = G.box("a_"), G.box("b_")
    together = F.abs(F.col("a_us") - F.col("b_us")) <= band
    candidates = (
        near_box_pairs(spread, single, [*SCENE, "tb"], max_px / 2, self_join=True)
        .where((F.col("a_track_id") < F.col("b_track_id")) & together)
        .where((G.iou_floored(a, b) >= min_iou) | (G.center_distance(a, b) <= max_px))
        .select(*SCENE, F.col("a_track_id").alias("t1"), F.col("b_track_id").alias("t2"))
        .distinct()
    )
    pairs = _with_tracks(candidates, tracks, "object_type", "avg_speed", "direction").where(
        (F.least("a_us1", "b_us1") >= F.greatest("a_us0", "b_us0"))
        & (F.greatest("a_avg_speed", "b_avg_speed") >= min_speed)
    )
    def moments(rows: DataFrame, prefix: str) -> DataFrame:
        boxes = (F.col(c).alias(f"{prefix}{c}") for c in ("us", "x1", "y1", "x2", "y2"))
        return rows.select(*SCENE, "track_id", "tb", *boxes).withColumn(SLICE, range_slice(F.col("tb"), PAIR_SLICE))

    lb, rb = G.box("l_"), G.box("r_")
    measured = (
        pair_rows(pairs.select(*SCENE, "track_a", "track_b"), moments(spread, "l_"), moments(single, "r_"), ["tb"])
        .where(F.abs(F.col("l_us") - F.col("r_us")) <= band)
        .groupBy(*SCENE, "track_a", "track_b", "l_us")
        .agg(
            F.min(G.center_distance(lb, rb)).alias("d"),
            F.max(G.iou_floored(lb, rb)).alias("o"),
        )
        .groupBy(*SCENE, "track_a", "track_b")
        .agg(F.min(F.struct("d", "l_us")).alias("m"), F.max("o").alias("max_iou"))
    )
    return (
        measured.join(pairs, [*SCENE, "track_a", "track_b"])
        .where((F.col("max_iou") >= min_iou) | (F.col("m.d") <= max_px))
        .select(
            *SCENE,
            F.lit("VEHICLE_COLLISION_DETECTED").alias("event_type"),
            F.timestamp_micros("m.l_us").alias("start_time"),
            F.timestamp_micros(F.least("a_us1", "b_us1")).alias("end_time"),
            F.lit(0.92).alias("confidence"),
            "track_a",
            "track_b",
            F.col("a_object_type").alias("object_a"),
            F.col("b_object_type").alias("object_b"),
            F.col("m.d").alias("min_distance"),
            "max_iou",
            "a_first_seq",
            "b_first_seq",
        )
    )


def scene_summary(
    tracks: DataFrame, collisions: DataFrame, crashes: DataFrame, coordination: DataFrame
) -> DataFrame:
    """Headline, text and key findings of each scene."""
    vehicles = F.col("object_type").isin(vocab.TRACK_VEHICLES)
    fleeing = (
        (F.col("object_type") == "person")
        & (F.col("avg_speed") >= 75.0)
        & (F.col("displacement") >= 80.0)
    )
    base = tracks.groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("tracks"),
        F.count_if(F.col("object_type") == "person").alias("people"),
        F.count_if(vehicles).alias("vehicles"),
        F.count_if("is_loitering").alias("loitering"),
        F.count_if(fleeing).alias("fleeing"),
    )
    critical = collisions.select(
        *SCENE,
        F.lit(0).alias("grp"),
        F.col("a_first_seq").alias("o1"),
        F.col("b_first_seq").alias("o2"),
        "start_time",
        F.format_string(
            "CRITICAL INCIDENT: Vehicle Collision / Impact Detected (Vehicle #%d & #%d)",
            "track_a",
            "track_b",
        ).alias("title"),
    ).unionByName(
        crashes.select(
            *SCENE,
            F.lit(1).alias("grp"),
            F.col("first_seq").alias("o1"),
            F.lit(0).cast("bigint").alias("o2"),
            "start_time",
            F.format_string(
                "CRITICAL INCIDENT: Sudden Vehicle Crash / Impact: %s #%d",
                F.initcap("object_type"),
                "track_id",
            ).alias("title"),
        )
    )
    n_crash = critical.groupBy(*SCENE).agg(F.count(F.lit(1)).alias("crashes"))
    n_coord = coordination.groupBy(*SCENE).agg(F.count(F.lit(1)).alias("coordinated"))
    # bounded lists: three critical titles and five tracks per scene
    top = Window.partitionBy(*SCENE).orderBy("grp", "o1", "o2")
    first = Window.partitionBy(*SCENE).orderBy("first_seq")
    titles = (
        critical.withColumn("rn", F.row_number().over(top))
        .where("rn <= 3")
        .select(
            *SCENE,
            F.col("rn"),
            F.concat(
                F.lit("CRITICAL: "), "title", F.lit(" at "), F.date_format("start_time", "HH:mm:ss")
            ).alias("line"),
        )
    )
    moves = (
        tracks.withColumn("rn", F.row_number().over(first))
        .where("rn <= 5")
        .select(
            *SCENE,
            (F.col("rn") + 3).alias("rn"),
            F.format_string(
                "Tracked %s #%d moving %s (speed %s px/s)",
                "object_type",
                "track_id",
                "direction",
                S.fixed(F.col("avg_speed")),
            ).alias("line"),
        )
    )
    lines = (
        titles.unionByName(moves)
        .groupBy(*SCENE)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("ls"))
        .select(*SCENE, F.transform("ls", lambda x: x["line"]).alias("key_events"))
    )
    joined = (
        base.join(n_crash, SCENE, "left").join(n_coord, SCENE, "left").join(lines, SCENE, "left")
    ).withColumns(
        {
            "crashes": F.coalesce("crashes", F.lit(0)),
            "coordinated": F.coalesce("coordinated", F.lit(0)),
        }
    )
    part = lambda cond, text: F.when(cond, text)
    heads = F.concat_ws(
        ", ",
        part(F.col("crashes") > 0, F.format_string("CRITICAL: Traffic Collision Flagged (%d Incident(s))", "crashes")),
        part(F.col("people") > 0, F.format_string("%d Person(s)", "people")),
        part(F.col("vehicles") > 0, F.format_string("%d Vehicle(s)", "vehicles")),
        part(F.col("fleeing") > 0, F.lit("Rapid Fleeing Detected")),
    )
    return joined.select(
        *SCENE,
        F.concat(
            F.lit("Forensic Scene Analysis: "),
            F.when(heads == "", F.lit("Motion Activity")).otherwise(heads),
        ).alias("headline"),
        "tracks",
        "people",
        "vehicles",
        "loitering",
        "fleeing",
        F.col("coordinated").alias("coordination"),
        F.col("crashes").alias("crashes"),
        "key_events",
        F.when(F.col("crashes") > 0, 0.95).otherwise(0.90).alias("confidence"),
    )
