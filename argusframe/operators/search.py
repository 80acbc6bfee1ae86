"""Event search, timelines, rankings, question answering digests and disappearances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions import scalars as S
from argusframe.operators import vocab
from argusframe.operators.slicing import (
    lag_in_slices,
    running_rank,
    sequence_key,
    time_slice,
    value_at_rank,
)

# ---- Fixed values: question words and the event words they select ----
INTENTS = [
    (["person", "people", "human", "who", "pedestrian"], ["person"], ["person"]),
    (["car", "vehicle", "truck", "drive", "bus", "auto"], ["vehicle"], ["vehicle", "car", "truck"]),
    (["bike", "bicycle", "motorcycle", "cyclist"], ["bicycle"], ["bicycle", "motorcycle"]),
    (["motion", "movement", "move"], ["motion"], []),
    (["disappear", "lost", "missing", "gone", "stolen"], ["disappearance"], []),
    (["tamper", "integrity", "gap", "hash", "drop"], ["integrity", "tamper"], []),
]
# ---- Fixed values: parts of an event type that make it a critical observation ----
CRITICAL_PARTS = ["LOITER", "SUDDEN", "DISAPPEAR", "FLAG"]

TIE = "event_id"


def _any(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, cols, F.lit(False))


def search_events(
    events: DataFrame,
    case_id,
    event_types: list[str] | None = None,
    start=None,
    end=None,
    camera_id: str | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """Events of a case overlapping a span; empty arguments filter nothing."""
    out = events.where(F.col("case_id") == F.lit(case_id))
    if event_types:
        out = out.where(F.col("event_type").isin(event_types))
    if start is not None:
        out = out.where(F.col("end_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("start_time") <= F.lit(end).cast("timestamp"))
    if camera_id:
        out = out.where(F.col("camera_id") == camera_id)
    if min_confidence:
        out = out.where(F.col("confidence") >= min_confidence)
    return by_start(out)


def by_start(events: DataFrame) -> DataFrame:
    """Ascending start; rows without a start sort as time zero; ties by id."""
    return events.orderBy(F.coalesce(F.unix_micros("start_time"), F.lit(0)), TIE)


def saved_searches(events: DataFrame, filters: DataFrame) -> DataFrame:
    """Events matching each stored filter row; null fields of a filter match everything.

    `filters`: filter_id, case_id, event_types (array), from_time, to_time, camera_id,
    min_confidence. The join key is the case, so only same-case rows meet.
    """
    f = filters.select(
        "case_id", "filter_id", "event_types", "from_time", "to_time",
        F.col("camera_id").alias("f_camera"), F.col("min_confidence").alias("f_conf"),
    )
    ok = (
        (F.col("event_types").isNull() | (F.size("event_types") == 0) | F.array_contains("event_types", F.col("event_type")))
        & (F.col("from_time").isNull() | (F.col("end_time") >= F.col("from_time")))
        & (F.col("to_time").isNull() | (F.col("start_time") <= F.col("to_time")))
        & (F.col("f_camera").isNull() | (F.col("camera_id") == F.col("f_camera")))
        & (F.col("f_conf").isNull() | (F.col("f_conf") == 0) | (F.col("confidence") >= F.col("f_conf")))
    )
    return events.join(f, "case_id").where(ok).select("filter_id", TIE, "case_id", "start_time")


def timeline(events: DataFrame) -> DataFrame:
    return by_start(events).select(
        F.col("start_time").alias("timestamp"),
        F.col("end_time").alias("end_timestamp"),
        "camera_id",
        "event_type",
        "video_id",
        "confidence",
        "object_type",
        "track_id",
    )


def timeline_filter(
    events: DataFrame, start=None, end=None, camera_id=None, event_type=None
) -> DataFrame:
    out = events
    if start is not None:
        out = out.where(F.col("end_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("start_time") <= F.lit(end).cast("timestamp"))
    if camera_id is not None:
        out = out.where(F.col("camera_id") == camera_id)
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    return by_start(out)


def facet_condition(facet: str) -> Column:
    """ALL, PERSON, VEHICLE, MOTION or REVIEW as a condition over event and object type."""
    et, ot = F.col("event_type"), F.coalesce(F.lower("object_type"), F.lit(""))
    if facet == "PERSON":
        return F.contains(ot, F.lit("person")) | F.contains(F.lower(et), F.lit("person"))
    if facet == "VEHICLE":
        return _any([F.contains(ot, F.lit(w)) for w in ("car", "truck", "vehicle")])
    if facet == "MOTION":
        return F.contains(F.lower(et), F.lit("motion"))
    if facet == "REVIEW":
        return et.startswith("REVIEW_FLAG_") | F.contains(et, F.lit("PROXIMITY")) | F.contains(et, F.lit("STOP"))
    return F.lit(True)


def intent_condition(question: str) -> Column:
    """Events meant by a question: any keyword group of the question that the event matches."""
    q = question.lower()
    et = F.lower(F.coalesce("event_type", F.lit("none")))
    ot = F.lower(F.coalesce("object_type", F.lit("none")))
    conds = []
    for asked, in_event, in_object in INTENTS:
        if any(w in q for w in asked):
            conds += [F.contains(et, F.lit(w)) for w in in_event]
            conds += [F.contains(ot, F.lit(w)) for w in in_object]
    return _any(conds)


def _limited(rows: DataFrame, top: int | None) -> DataFrame:
    """All rows in order of start, or the first `top` with the number of rows left out."""
    if top is None:
        return by_start(rows)
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    first = by_start(rows).limit(top).withColumn("_one", F.lit(1))
    return first.join(total.withColumn("_one", F.lit(1)), "_one").select(
        *rows.columns, F.greatest(F.lit(0), F.col("_total") - top).alias("overflow")
    )


def intent_search(events: DataFrame, question: str, top: int | None = None) -> DataFrame:
    """Matching events of a question, or all events when none matches.

    top: report only the first so many, and `overflow`, how many more there are.
    """
    condition = intent_condition(question)
    some = events.where(condition).limit(1).select(F.lit(1).alias("_one"))
    none = events.withColumn("_one", F.lit(1)).join(some, "_one", "left_anti").drop("_one")
    return _limited(events.where(condition).unionByName(none), top)


def intent_count(events: DataFrame, question: str) -> DataFrame:
    """Number of events a "how many" question reports."""
    counts = events.agg(
        F.count_if(intent_condition(question)).alias("m"), F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        F.when(F.col("m") > 0, F.col("m")).otherwise(F.col("n")).alias("matched")
    )


def word_match(events: DataFrame, question: str, top: int | None = None) -> DataFrame:
    """Events whose type or object contains a word of the question (over 3 letters).

    top: report only the first so many, and `overflow`, how many more there are.
    """
    words = [w for w in question.lower().split() if len(w) > 3]
    et = F.lower(F.coalesce("event_type", F.lit("none")))
    ot = F.lower(F.coalesce("object_type", F.lit("none")))
    cond = _any([F.contains(c, F.lit(w)) for w in words for c in (et, ot)])
    return _limited(events.where(cond), top)


def event_offsets(events: DataFrame, fps: float) -> DataFrame:
    """Start and end seconds of events inside their video, from first and last frame."""
    rate = F.lit(fps if fps else 25.0)
    start = F.coalesce(F.round(F.col("first_frame") / rate, 2), F.lit(0.0))
    end = F.coalesce(F.round(F.col("last_frame") / rate, 2), start + 3.0)
    return events.withColumns({"start_seconds": start, "end_seconds": end})


def events_at_time(
    events: DataFrame, position_s: float, duration_s: float, reach_s: float = 1.25
) -> DataFrame:
    """Events shown at a play position: offset from metadata, else from the first event."""
    firsts = events.groupBy("video_id").agg(F.min("start_time").alias("_t0"))
    since = S.seconds_between(F.col("start_time"), F.col("_t0"))
    offset = F.coalesce("timestamp_seconds", "seconds", since)
    shown = F.pmod(offset, F.lit(float(duration_s))) if duration_s > 0 else offset
    return (
        events.join(firsts, "video_id")
        .withColumn("offset_s", shown)
        .where(F.abs(F.lit(float(position_s)) - F.col("offset_s")) <= reach_s)
        .drop("_t0")
    )


def top_with_overflow(
    rows: DataFrame, keys: list[str], order: list[Column | str], cap: int
) -> DataFrame:
    """First `cap` rows per key and how many more there are (row limit before the shuffle)."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    first = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("position", F.row_number().over(first))
        .where(F.col("position") <= cap)
        .join(totals, keys)
        .withColumn("overflow", F.greatest(F.lit(0), F.col("_total") - cap))
        .drop("_total")
    )


def critical_alerts(events: DataFrame, cap: int = 8) -> DataFrame:
    """First critical observations of each video and the number not listed."""
    hit = F.upper("event_type").rlike("|".join(CRITICAL_PARTS))
    return top_with_overflow(
        events.where(hit), ["video_id"], ["start_time", "track_id", "event_type"], cap
    )


def relevance(line: Column, question: str) -> Column:
    """Two points per question word (over 2 letters) and one per security word contained."""
    low = F.lower(line)
    words = [w.lower() for w in (question or "").split() if len(w) > 2]
    one = lambda w, p: F.when(F.contains(low, F.lit(w)), p).otherwise(0)
    parts = [one(w, 2) for w in words] + [one(w, 1) for w in vocab.SECURITY_WORDS]
    return reduce(lambda x, y: x + y, parts, F.lit(0))


def span_line(seconds_format: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Report line of a track span."""
    return F.concat(
        F.lit("- "), F.upper("object_type"), F.lit(" #"), F.col("track_id"), F.lit(" on "),
        F.col("camera_id"), F.lit(": "), F.date_format("start_time", seconds_format), F.lit(" -> "),
        F.date_format("end_time", seconds_format), F.lit(" ("), S.fixed(F.col("duration_s")),
        F.lit("s, "), F.col("observation_count").cast("string"), F.lit(" frames), Heading: "),
        F.col("direction"), F.lit(", Speed: "), S.fixed(F.col("avg_speed")), F.lit("px/s"),
        F.when(F.col("is_loitering"), F.lit(" [LOITERING]")).otherwise(F.lit("")),
    )


def ranked_spans(spans: DataFrame, keys: list[str], question: str, cap: int = 25) -> DataFrame:
    """Most relevant span lines per key; ties keep start order."""
    scored = spans.withColumn("line", span_line()).withColumn(
        "score",
        relevance(F.col("line"), question)
        + F.when(F.col("is_loitering"), 3).otherwise(0)
        + F.when(F.col("avg_speed") >= 75.0, 2).otherwise(0),
    )
    order = [F.desc("score"), "start_time", "object_type", "track_id"]
    return top_with_overflow(scored, keys, order, cap).select(
        *keys, "position", "score", "line", "overflow"
    )


def ranked_activities(events: DataFrame, keys: list[str], question: str, cap: int = 15) -> DataFrame:
    """Most relevant activity lines per key; incident types get three points more."""
    line = F.concat(
        F.lit("- ["), F.col("event_type"), F.lit("] "), F.col("event_type"), F.lit(" at "),
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"),
    )
    scored = events.withColumn("line", line).withColumn(
        "score",
        relevance(F.col("line"), question)
        + F.when(F.col("event_type").rlike("|".join(vocab.INCIDENT_TAGS)), 3).otherwise(0),
    )
    order = [F.desc("score"), "start_time", "track_id", "event_type"]
    return top_with_overflow(scored, keys, order, cap).select(
        *keys, "position", "score", "line", "overflow"
    )


def video_context(
    spans: DataFrame, activities: DataFrame, events: DataFrame, key: str, question: str
) -> DataFrame:
    """Bounded text context of each key: counts, at most 15 activity and 25 span lines."""
    raw = events.groupBy(key).agg(F.count(F.lit(1)).alias("raw"))
    n_spans = spans.groupBy(key).agg(F.count(F.lit(1)).alias("n_spans"))
    n_act = activities.groupBy(key).agg(F.count(F.lit(1)).alias("n_act"))

    def block(ranked: DataFrame, name: str) -> DataFrame:
        # at most 15 or 25 lines per key reach this list
        return ranked.groupBy(key).agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]
                ),
                "\n\n",
            ).alias(name),
            F.count(F.lit(1)).alias(f"k_{name}"),
        )

    spans_block = block(ranked_spans(spans, [key], question), "span_lines")
    act_block = block(ranked_activities(activities, [key], question), "act_lines")
    joined = raw
    for other in (n_spans, n_act, spans_block, act_block):
        joined = joined.join(other, key, "left")
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    act_head = F.concat(
        F.lit("Reconstructed Forensic Activities (Top "), n0("k_act_lines"), F.lit(" of "), n0("n_act"), F.lit("):")
    )
    span_head = F.concat(
        F.lit("Tracked Entity Spans (Top "), n0("k_span_lines"), F.lit(" of "), n0("n_spans"), F.lit("):")
    )
    none = F.col("act_lines").isNull() & F.col("span_lines").isNull()
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Video Evidence: "), F.col(key)),
        F.concat(
            F.lit("Total Raw Frame Detections: "), F.col("raw").cast("string"),
            F.lit(" (condensed into "), n0("n_spans"), F.lit(" entity tracks)"),
        ),
        F.when(F.col("act_lines").isNotNull(), act_head),
        F.col("act_lines"),
        F.when(F.col("span_lines").isNotNull(), span_head),
        F.col("span_lines"),
        F.when(none, F.lit("No significant motion or entity events recorded in timeline.")),
    )
    return joined.select(key, text.alias("context"), F.length(text).alias("context_chars"))


def type_histogram(events: DataFrame) -> DataFrame:
    """Count and share of each event type; the total is taken over the few type rows."""
    counts = events.groupBy(F.coalesce("event_type", F.lit("UNKNOWN")).alias("event_type")).agg(
        F.count(F.lit(1)).alias("n")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100.0
    return counts.withColumn("share_pct", share).orderBy(F.desc("n"), "event_type")


def entity_cards(events: DataFrame) -> DataFrame:
    """Count, first and last sighting and mean confidence of each object class."""
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0.0, 0.8).otherwise(F.col("confidence"))
    return (
        events.where(F.col("object_type").isNotNull())
        .groupBy(F.lower("object_type").alias("object_type"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("start_time").alias("first_seen"),
            F.max("start_time").alias("last_seen"),
            F.avg(conf).alias("avg_confidence"),
        )
    )


def qa_tracks(events: DataFrame, cap_tracks: int = 8, cap_other: int = 10) -> DataFrame:
    """Digest rows of a video: its first tracks and first untracked events, and how many more of each."""
    obj = F.coalesce("object_type", F.lit("object"))
    conf = F.coalesce("confidence", F.lit(0.0))
    at = F.unix_micros("start_time")
    speed = F.when(F.coalesce("avg_speed", F.lit(0.0)) != 0.0, F.col("avg_speed"))
    tracked = (
        events.where(F.col("track_id").isNotNull())
        .groupBy("video_id", obj.alias("object_type"), "track_id")
        .agg(
            F.min(at).alias("us0"),
            F.max(at).alias("us1"),
            F.count(F.lit(1)).alias("n"),
            F.max(conf).alias("max_confidence"),
            F.avg(speed).alias("mean_speed"),
        )
    )
    top = top_with_overflow(tracked, ["video_id"], ["us0", "object_type", "track_id"], cap_tracks)
    clock = lambda c: F.date_format(F.timestamp_micros(c), "HH:mm:ss")
    rows = top.select(
        "video_id", F.lit("track").alias("kind"), "position", "object_type", "track_id",
        clock("us0").alias("first_seen"), clock("us1").alias("last_seen"), "n", "max_confidence", "mean_speed",
        "overflow",
    )
    untracked = events.where(F.col("track_id").isNull()).select(
        "video_id", obj.alias("object_type"), at.alias("us0"), conf.alias("max_confidence"), "event_type"
    )
    other = top_with_overflow(untracked, ["video_id"], ["us0", "object_type", "event_type"], cap_other).select(
        "video_id", F.lit("event").alias("kind"), "position", F.col("event_type").alias("object_type"),
        F.lit(None).cast("bigint").alias("track_id"), clock("us0").alias("first_seen"),
        clock("us0").alias("last_seen"), F.lit(1).cast("bigint").alias("n"), "max_confidence",
        F.lit(None).cast("double").alias("mean_speed"), "overflow",
    )
    return rows.unionByName(other)


def last_turns(chat: DataFrame, k: int = 2, chars: int = 120) -> DataFrame:
    """Last k turns of each conversation, trimmed; blank turns are left out."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return (
        chat.withColumn("_rn", F.row_number().over(latest))
        .where(F.col("_rn") <= k)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"),
            F.substring(text, 1, chars).alias("content"),
        )
        .where("content <> ''")
    )


def disappearances(
    events: DataFrame,
    min_confidence: float | None = None,
    with_delay: bool = True,
    slice_seconds: float = 900,
) -> DataFrame:
    """Repeatedly seen classes of a camera and when they count as gone.

    The waiting time is three times the upper median of the gaps, at least two seconds. The
    median is found by counting, so that a camera and class with very many events is never
    sorted in one task. `min_confidence` lets null confidences pass.
    """
    obj = F.lower(F.trim("object_type"))
    rows = events.where(
        F.col("object_type").isNotNull() & ~obj.isin(vocab.NOT_AN_OBJECT) & F.col("start_time").isNotNull()
    )
    if min_confidence is not None:
        rows = rows.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    keyed = rows.select(
        F.coalesce("camera_id", F.lit("CH-UNKNOWN")).alias("camera_id"),
        obj.alias("object_type"),
        "start_time",
        F.coalesce("end_time", "start_time").alias("end_time"),
        sequence_key(F.col("start_time"), F.col(TIE)).alias("seq"),
    )
    keys = ["camera_id", "object_type"]
    base = (
        keyed.groupBy(*keys)
        .agg(
            F.min("start_time").alias("first_seen"),
            F.max("end_time").alias("last_seen"),
            F.count(F.lit(1)).alias("observation_count"),
        )
        .where("observation_count >= 2")
    )
    if not with_delay:
        return base
    gaps = (
        lag_in_slices(keyed, keys, ["seq"], ["end_time"], time_slice(F.col("start_time"), slice_seconds))
        .where(F.col("prev").isNotNull())
        .select(*keys, (F.unix_micros("start_time") - F.unix_micros("prev.end_time")).alias("gap_us"))
        .where("gap_us >= 0")
    )
    ranks = gaps.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("rank"))
    median = value_at_rank(gaps, keys, "gap_us", ranks, 1_000_000).select(
        *keys, (F.col("value") / F.lit(1e6)).alias("median_gap_s")
    )
    delay = F.greatest(F.lit(2.0), F.coalesce("median_gap_s", F.lit(1.0)) * 3.0)
    return base.join(median, keys, "left").select(
        *keys,
        "first_seen",
        "last_seen",
        S.plus_seconds(F.col("last_seen"), delay).alias("disappearance_time"),
        "observation_count",
    )


def disappearance_related(
    events: DataFrame, candidates: DataFrame, cap: int = 3, slice_seconds: float = 900
) -> DataFrame:
    """First `cap` events of the same camera at or after each disappearance.

    Events are numbered along each camera, slice by slice. A disappearance counts how many events
    begin before it by its place among events and disappearances together, less its place among the
    disappearances; the next `cap` numbers are looked up. A camera's events and disappearances
    never meet all with all.
    """
    by = time_slice(F.col("_at"), slice_seconds)
    e = events.select(
        F.coalesce("camera_id", F.lit("CH-UNKNOWN")).alias("camera_id"),
        TIE,
        "start_time",
        "event_type",
        F.col("object_type").alias("seen_type"),
        F.col("start_time").alias("_at"),
    ).where("_at IS NOT NULL")
    c = candidates.where("disappearance_time IS NOT NULL").select(
        "camera_id", "object_type", F.col("disappearance_time").alias("_at")
    )
    marks = e.select("camera_id", "_at", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("object_type")).unionByName(
        c.withColumn("_kind", F.lit(0))
    )
    among = running_rank(marks, ["camera_id"], ["_at", "_kind", "object_type"], by, "_among").where("_kind = 0")
    own = running_rank(c, ["camera_id"], ["_at", "object_type"], by, "_own").select("camera_id", "object_type", "_own")
    wanted = (
        among.join(own, ["camera_id", "object_type"])
        .withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(cap))))
        .select("camera_id", "object_type", "position", (F.col("_among") - F.col("_own") + F.col("position")).alias("_nth"))
    )
    numbered = running_rank(e, ["camera_id"], ["_at", TIE], by, "_nth")
    return numbered.join(wanted, ["camera_id", "_nth"]).select(
        "camera_id", "object_type", "position", TIE, "start_time", "event_type", "seen_type"
    )


def entity_disappeared(observations: DataFrame, min_observations: int = 2) -> DataFrame:
    """Last sighting of each entity seen at least twice, with the models that saw it.

    Aggregated per entity and source first, so the only list holds the few source names.
    """
    keys = ["video_id", "camera_id", "object_type", "track_id"]
    seq = sequence_key(F.col("ts"), F.col("det_id"))
    boxes = ("x1", "y1", "x2", "y2")
    per_source = (
        observations.withColumn("seq", seq)
        .groupBy(*keys, "source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("confidence").alias("confidence"),
            F.min("frame_number").alias("first_frame"),
            F.max("frame_number").alias("last_frame"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.max("seq").alias("seq1"),
            *(F.max_by(c, "seq").alias(c) for c in boxes),
        )
    )
    return (
        per_source.groupBy(*keys)
        .agg(
            F.sum("n").alias("observation_count"),
            F.max("confidence").alias("_c"),
            F.min("first_frame").alias("first_frame"),
            F.max("last_frame").alias("last_frame"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            *(F.max_by(c, "seq1").alias(c) for c in boxes),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )
        .where(F.col("observation_count") >= min_observations)
        .withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.30), F.col("_c"))))
        .withColumn("event_type", F.lit("OBJECT_DISAPPEARED"))
        .drop("_c")
    )


def min_hits(detections: DataFrame, hits: int) -> DataFrame:
    """Rows from the `hits`-th sighting of a track on; that row is found with a row limit."""
    keys = ["video_id", "camera_id", "track_id"]
    if hits <= 1:
        return detections.where("track_id IS NOT NULL")
    rows = detections.where("track_id IS NOT NULL").withColumn(
        "_seq", sequence_key(F.col("ts"), F.col("det_id"))
    )
    early = Window.partitionBy(*keys).orderBy("_seq")
    from_row = (
        rows.select(*keys, "_seq")
        .withColumn("_rn", F.row_number().over(early))
        .where(F.col("_rn") <= hits)
        .where(F.col("_rn") == hits)
        .select(*keys, F.col("_seq").alias("_from"))
    )
    return rows.join(from_row, keys).where("_seq >= _from").drop("_seq", "_from")
