"""Search, timelines, rankings, question digests and disappearances."""

from pyspark.sql import functions as F

from argusframe.checks.events_sql import DEV
from argusframe.checks.views import DET, VEV
from argusframe.operators import search as Q, vocab
from argusframe.plans.activity_queries import SPANS, detection_event_rows
from argusframe.plans.registry import query
from argusframe.plans.trajectory_queries import INCIDENTS, TRK, tracks
from argusframe.operators import activity as A, trajectories as TJ
from argusframe.sources import fixtures as X

EV = "event_id, video_id, camera_id, event_type, start_time, end_time, confidence, track_id, object_type, case_id"


@query(
    "search_events",
    f"""WITH {VEV} SELECT {EV} FROM vev WHERE case_id=3 AND event_type IN ('PERSON_DETECTED','CAR_DETECTED')
    AND end_time >= TIMESTAMP '2024-01-01 01:00:00' AND start_time <= TIMESTAMP '2024-01-01 05:00:00' AND confidence>=0.3""",
    "confidence",
)
def search_events(spark, sf):
    return Q.search_events(
        X.video_events(spark, sf), 3, ["PERSON_DETECTED", "CAR_DETECTED"],
        "2024-01-01 01:00:00", "2024-01-01 05:00:00", None, 0.3,
    )


@query(
    "saved_searches",
    f"""WITH {VEV}, f AS (SELECT n_nationkey AS filter_id, n_nationkey%10 AS case_id,
      CASE WHEN n_nationkey%4=0 THEN NULL ELSE 'CH-0' || (n_nationkey%4) END AS cam,
      CASE WHEN n_nationkey%3=0 THEN 0.0 ELSE n_nationkey/50.0 END AS mc,
      CASE WHEN n_nationkey%2=0 THEN ['PERSON_DETECTED','MOTION'] ELSE NULL END AS types,
      TIMESTAMP '2024-01-01 00:30:00' + INTERVAL 1 MINUTE * n_nationkey AS ft FROM nation)
    SELECT filter_id, event_id, v.case_id, start_time FROM vev v JOIN f ON v.case_id=f.case_id
    WHERE (types IS NULL OR list_contains(types, event_type)) AND end_time>=ft AND (cam IS NULL OR camera_id=cam) AND (mc=0 OR confidence>=mc)""",
)
def saved_searches(spark, sf):
    filters = X.table(spark, sf, "nation").selectExpr(
        "n_nationkey AS filter_id",
        "CAST(n_nationkey % 10 AS BIGINT) AS case_id",
        "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE concat('CH-0', CAST(n_nationkey % 4 AS STRING)) END AS camera_id",
        "CASE WHEN n_nationkey % 3 = 0 THEN 0.0D ELSE n_nationkey / 50.0D END AS min_confidence",
        "CASE WHEN n_nationkey % 2 = 0 THEN array('PERSON_DETECTED', 'MOTION') END AS event_types",
        "TIMESTAMP '2024-01-01 00:30:00' + make_interval(0,0,0,0,0,n_nationkey,0) AS from_time",
        "CAST(NULL AS TIMESTAMP) AS to_time",
    )
    return Q.saved_searches(X.video_events(spark, sf), filters)


@query(
    "timeline",
    f"""WITH {VEV} SELECT start_time AS timestamp, end_time AS end_timestamp, camera_id, event_type, video_id, confidence, object_type, track_id FROM vev""",
    "confidence",
)
def timeline(spark, sf):
    return Q.timeline(X.video_events(spark, sf))


@query(
    "timeline_filter",
    f"""WITH {VEV} SELECT {EV} FROM vev WHERE end_time>=TIMESTAMP '2024-01-01 02:00:00' AND start_time<=TIMESTAMP '2024-01-01 04:00:00'
    AND camera_id='CH-01' AND event_type='TRUCK_DETECTED'""",
    "confidence",
)
def timeline_filter(spark, sf):
    return Q.timeline_filter(
        X.video_events(spark, sf), "2024-01-01 02:00:00", "2024-01-01 04:00:00", "CH-01", "TRUCK_DETECTED"
    )


@query("events_sorted", f"WITH {VEV} SELECT {EV} FROM vev ORDER BY start_time, event_id", "confidence")
def events_sorted(spark, sf):
    return Q.by_start(X.video_events(spark, sf))


_OT, _ET = "coalesce(lower(object_type),'')", "lower(event_type)"


@query(
    "facet_filter",
    f"""WITH {VEV} SELECT event_id, true AS f_all, contains({_OT},'person') OR contains({_ET},'person') AS f_person,
    contains({_OT},'car') OR contains({_OT},'truck') OR contains({_OT},'vehicle') AS f_vehicle, contains({_ET},'motion') AS f_motion,
    starts_with(event_type,'REVIEW_FLAG_') OR contains(event_type,'PROXIMITY') OR contains(event_type,'STOP') AS f_review FROM vev""",
)
def facet_filter(spark, sf):
    names = ["ALL", "PERSON", "VEHICLE", "MOTION", "REVIEW"]
    return X.video_events(spark, sf).select(
        "event_id", *(Q.facet_condition(n).alias(f"f_{n.lower()}") for n in names)
    )


_INTENT = "(contains(lower(event_type),'person') OR contains(coalesce(lower(object_type),'none'),'person') OR contains(lower(event_type),'motion'))"


@query(
    "intent_search",
    f"WITH {VEV} SELECT {EV} FROM vev WHERE {_INTENT}",
    "confidence",
)
def intent_search(spark, sf):
    return Q.intent_search(X.video_events(spark, sf), "Who moved near the door, any movement?")


@query(
    "intent_search_default",
    f"WITH {VEV} SELECT {EV} FROM vev",
    "confidence",
)
def intent_search_default(spark, sf):
    return Q.intent_search(X.video_events(spark, sf), "Was any footage tampered with?")


@query("intent_count", f"WITH {VEV} SELECT count(*) AS matched FROM vev WHERE {_INTENT}")
def intent_count(spark, sf):
    return Q.intent_count(X.video_events(spark, sf), "How many people or movement events?")


@query(
    "word_match",
    f"""WITH {VEV} SELECT {EV} FROM vev WHERE contains(lower(event_type),'truck') OR contains(coalesce(lower(object_type),'none'),'truck')
    OR contains(lower(event_type),'backpack') OR contains(coalesce(lower(object_type),'none'),'backpack')""",
    "confidence",
)
def word_match(spark, sf):
    return Q.word_match(X.video_events(spark, sf), "any truck or backpack")


@query(
    "event_offsets",
    f"""WITH {DEV} SELECT video_id, camera_id, object_type, track_id, start_time, round(first_frame/4.0::DOUBLE,2) AS start_seconds,
    round(last_frame/4.0::DOUBLE,2) AS end_seconds FROM dev""",
)
def event_offsets(spark, sf):
    return Q.event_offsets(detection_event_rows(spark, sf), 4.0).select(
        "video_id", "camera_id", "object_type", "track_id", "start_time", "start_seconds", "end_seconds"
    )


@query(
    "events_at_time",
    f"""WITH {VEV}, t AS (SELECT video_id, min(s_us) AS t0 FROM vev GROUP BY 1), o AS (SELECT event_id, v.video_id,
      CASE WHEN event_id%5=0 THEN (event_id%1000)/2.0::DOUBLE ELSE (s_us-t0)/1e6 END AS off FROM vev v JOIN t USING (video_id))
    SELECT event_id, video_id, off - 600*floor(off/600) AS offset_s FROM o WHERE abs(42.0-(off - 600*floor(off/600)))<=1.25""",
    "offset_s",
)
def events_at_time(spark, sf):
    ev = X.video_events(spark, sf).withColumns(
        {
            "timestamp_seconds": F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 1000) / 2.0),
            "seconds": F.lit(None).cast("double"),
        }
    )
    return Q.events_at_time(ev, 42.0, 600.0).select("event_id", "video_id", "offset_s")


@query(
    "critical_alerts",
    f"""WITH {TRK}, i AS ({INCIDENTS}), c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_time, track_id, event_type) AS position,
      count(*) OVER (PARTITION BY video_id) AS total FROM i WHERE regexp_matches(upper(event_type),'LOITER|SUDDEN|DISAPPEAR|FLAG'))
    SELECT video_id, camera_id, track_id, object_type, event_type, start_time, end_time, confidence, position, greatest(0,total-8) AS overflow
    FROM c WHERE position<=8""",
    "confidence",
)
def critical_alerts(spark, sf):
    return Q.critical_alerts(TJ.track_incidents(tracks(spark, sf)))


QUESTION = "suspect person loitering near truck"
_WORDS = [w for w in QUESTION.split() if len(w) > 2]


def _score(line: str) -> str:
    parts = [f"(CASE WHEN contains(lower({line}),'{w}') THEN 2 ELSE 0 END)" for w in _WORDS]
    parts += [f"(CASE WHEN contains(lower({line}),'{w}') THEN 1 ELSE 0 END)" for w in vocab.SECURITY_WORDS]
    return "(" + "+".join(parts) + ")"


SPAN_RANK = f"""
rk_a AS (SELECT *, '- ' || upper(object_type) || ' #' || track_id || ' on ' || camera_id || ': ' || strftime(start_time,'%Y-%m-%d %H:%M:%S')
   || ' -> ' || strftime(end_time,'%Y-%m-%d %H:%M:%S') || ' (' || printf('%.1f',duration_s) || 's, ' || observation_count || ' frames), Heading: '
   || direction || ', Speed: ' || printf('%.1f',avg_speed) || 'px/s' || CASE WHEN is_loitering THEN ' [LOITERING]' ELSE '' END AS line FROM spans),
rk_b AS (SELECT *, {_score('line')} + CASE WHEN is_loitering THEN 3 ELSE 0 END + CASE WHEN avg_speed>=75 THEN 2 ELSE 0 END AS score FROM rk_a),
rk AS (SELECT camera_id, row_number() OVER (PARTITION BY camera_id ORDER BY score DESC, start_time, object_type, track_id) AS position, score, line,
   count(*) OVER (PARTITION BY camera_id) AS total FROM rk_b)"""


@query(
    "ranked_context",
    f"WITH {SPANS}, {SPAN_RANK} SELECT camera_id, position, score, line, greatest(0,total-25) AS overflow FROM rk WHERE position<=25",
)
def ranked_context(spark, sf):
    return Q.ranked_spans(A.track_spans(detection_event_rows(spark, sf)), ["camera_id"], QUESTION)


_TRK_TAIL = TRK.replace(DET + ",", "")
ACT_RANK = f"""
ai AS ({INCIDENTS}),
ra_a AS (SELECT *, '- [' || event_type || '] ' || event_type || ' at ' || strftime(start_time,'%Y-%m-%d %H:%M:%S') AS line FROM ai),
ra_b AS (SELECT *, {_score('line')} + CASE WHEN regexp_matches(event_type,'{"|".join(vocab.INCIDENT_TAGS)}') THEN 3 ELSE 0 END AS score FROM ra_a),
ra AS (SELECT camera_id, row_number() OVER (PARTITION BY camera_id ORDER BY score DESC, start_time, track_id, event_type) AS position, score, line,
   count(*) OVER (PARTITION BY camera_id) AS total FROM ra_b)"""


@query(
    "ranked_activities",
    f"WITH {TRK}, {ACT_RANK} SELECT camera_id, position, score, line, greatest(0,total-15) AS overflow FROM ra WHERE position<=15",
)
def ranked_activities(spark, sf):
    return Q.ranked_activities(TJ.track_incidents(tracks(spark, sf)), ["camera_id"], QUESTION)


@query(
    "video_context",
    f"""WITH {SPANS}, {_TRK_TAIL}, {SPAN_RANK}, {ACT_RANK},
    n AS (SELECT camera_id, count(*) AS raw FROM dev GROUP BY 1),
    s AS (SELECT camera_id, string_agg(line, chr(10) || chr(10) ORDER BY position) AS lines, count(*) AS k, max(total) AS total FROM rk WHERE position<=25 GROUP BY 1),
    a AS (SELECT camera_id, string_agg(line, chr(10) || chr(10) ORDER BY position) AS lines, count(*) AS k, max(total) AS total FROM ra WHERE position<=15 GROUP BY 1),
    t AS (SELECT n.camera_id, 'Video Evidence: ' || n.camera_id || chr(10) || chr(10) || 'Total Raw Frame Detections: ' || raw || ' (condensed into ' || s.total || ' entity tracks)'
      || chr(10) || chr(10) || 'Reconstructed Forensic Activities (Top ' || a.k || ' of ' || a.total || '):' || chr(10) || chr(10) || a.lines
      || chr(10) || chr(10) || 'Tracked Entity Spans (Top ' || s.k || ' of ' || s.total || '):' || chr(10) || chr(10) || s.lines AS context
      FROM n JOIN s USING (camera_id) JOIN a USING (camera_id))
    SELECT camera_id, context, length(context) AS context_chars FROM t""",
)
def video_context(spark, sf):
    events = detection_event_rows(spark, sf)
    return Q.video_context(
        A.track_spans(events), TJ.track_incidents(tracks(spark, sf)), events, "camera_id", QUESTION
    )


@query(
    "type_histogram",
    f"WITH {VEV} SELECT event_type, count(*) AS n, count(*)*100.0::DOUBLE/(SELECT count(*) FROM vev) AS share_pct FROM vev GROUP BY 1",
    "share_pct",
)
def type_histogram(spark, sf):
    return Q.type_histogram(X.video_events(spark, sf))


@query(
    "entity_cards",
    f"""WITH {VEV} SELECT lower(object_type) AS object_type, count(*) AS n, min(start_time) AS first_seen, max(start_time) AS last_seen,
    avg(CASE WHEN coalesce(confidence,0)=0 THEN 0.8 ELSE confidence END) AS avg_confidence FROM vev WHERE object_type IS NOT NULL GROUP BY 1""",
    "avg_confidence",
)
def entity_cards(spark, sf):
    return Q.entity_cards(X.video_events(spark, sf))


@query(
    "qa_tracks",
    f"""WITH {DEV}, t AS (SELECT video_id, object_type, track_id, min(start_time) AS s, max(start_time) AS e, count(*) AS n, max(confidence) AS max_confidence,
       avg(avg_speed) FILTER (avg_speed<>0) AS mean_speed FROM dev WHERE track_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s, object_type, track_id) AS position FROM t),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_time, object_type, event_type) AS position FROM dev WHERE track_id IS NULL)
    SELECT video_id, 'track' AS kind, position, object_type, track_id, strftime(s,'%H:%M:%S') AS first_seen, strftime(e,'%H:%M:%S') AS last_seen, n, max_confidence, mean_speed,
       greatest(0, (SELECT count(*) FROM r AS a WHERE a.video_id=r.video_id)-8) AS overflow FROM r WHERE position<=8
    UNION ALL SELECT video_id, 'event', position, event_type, NULL, strftime(start_time,'%H:%M:%S'), strftime(start_time,'%H:%M:%S'), 1, confidence, NULL,
       greatest(0, (SELECT count(*) FROM o AS a WHERE a.video_id=o.video_id)-10) FROM o WHERE position<=10""",
    "max_confidence mean_speed",
)
def qa_tracks(spark, sf):
    return Q.qa_tracks(detection_event_rows(spark, sf))


@query(
    "last_turns",
    r"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
    t AS (SELECT conv_id, turn, CASE WHEN role='user' THEN 'user' ELSE 'assistant' END AS role,
      substring(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 120) AS content FROM r WHERE rn<=2)
    SELECT * FROM t WHERE content <> ''""",
)
def last_turns(spark, sf):
    return Q.last_turns(X.chat(spark, sf))


def _gone(where: str, ot: str = "lower(object_type)") -> str:
    return f"""WITH {VEV}, f AS (SELECT *, {ot} AS ot FROM vev WHERE object_type IS NOT NULL {where}),
    l AS (SELECT *, s_us - lag(e_us) OVER (PARTITION BY camera_id, ot ORDER BY s_us, event_id) AS gap FROM f),
    g AS (SELECT camera_id, ot, gap, row_number() OVER (PARTITION BY camera_id, ot ORDER BY gap) AS rn, count(*) OVER (PARTITION BY camera_id, ot) AS n FROM l WHERE gap>=0),
    m AS (SELECT camera_id, ot, gap FROM g WHERE rn = n//2+1),
    b AS (SELECT camera_id, ot, min(start_time) AS first_seen, max(end_time) AS last_seen, count(*) AS observation_count FROM f GROUP BY ALL HAVING count(*)>=2),
    gone AS (SELECT b.camera_id, b.ot AS object_type, first_seen, last_seen,
      make_timestamp(epoch_us(last_seen) + CAST(round(greatest(2.0::DOUBLE, coalesce(gap/1e6, 1.0)*3)*1e6) AS BIGINT)) AS disappearance_time, observation_count
    FROM b LEFT JOIN m ON b.camera_id=m.camera_id AND b.ot=m.ot)"""


@query("disappearances", f"{_gone('')} SELECT * FROM gone")
def disappearances(spark, sf):
    return Q.disappearances(X.video_events(spark, sf))


@query("disappearances_confident", f"{_gone('AND (confidence IS NULL OR confidence>=0.5)')} SELECT * FROM gone")
def disappearances_confident(spark, sf):
    return Q.disappearances(X.video_events(spark, sf), min_confidence=0.5)


@query(
    "disappearances_seen",
    f"{_gone('AND (confidence IS NULL OR confidence>=0.5)')} SELECT * EXCLUDE (disappearance_time) FROM gone",
)
def disappearances_seen(spark, sf):
    return Q.disappearances(X.video_events(spark, sf), min_confidence=0.5, with_delay=False)


@query(
    "disappearance_related",
    f"""{_gone("", "lower(object_type) || ' ' || track_id")},
    r AS (SELECT v.camera_id, g.object_type, v.event_id, v.start_time, v.event_type, v.object_type AS seen_type,
      row_number() OVER (PARTITION BY v.camera_id, g.object_type ORDER BY v.start_time, v.event_id) AS position
      FROM vev v JOIN gone g ON v.camera_id=g.camera_id AND v.start_time>=g.disappearance_time)
    SELECT * FROM r WHERE position<=3""",
)
def disappearance_related(spark, sf):
    ev = X.video_events(spark, sf)
    # each tracked object by itself, so that objects are gone at all times of the table
    objects = ev.withColumn("object_type", F.concat_ws(" ", "object_type", "track_id")).where(ev["object_type"].isNotNull())
    return Q.disappearance_related(ev, Q.disappearances(objects))


@query(
    "entity_disappeared",
    f"""WITH {DET}, d AS (SELECT *, CASE WHEN det_id%3=0 THEN 'grounding_dino' ELSE 'vision' END AS source FROM det)
    SELECT video_id, camera_id, object_type, track_id, count(*) AS observation_count, min(frame_number) AS first_frame, max(frame_number) AS last_frame,
      min(ts) AS first_seen, max(ts) AS last_seen, arg_max(x1,us) AS x1, arg_max(y1,us) AS y1, arg_max(x2,us) AS x2, arg_max(y2,us) AS y2,
      array_to_string(list_sort(list(DISTINCT source)),'|') AS sources, least(1.0,greatest(0.30,max(confidence))) AS confidence, 'OBJECT_DISAPPEARED' AS event_type
    FROM d GROUP BY video_id, camera_id, object_type, track_id HAVING count(*)>=2""",
    "x1 y1 x2 y2 confidence",
)
def entity_disappeared(spark, sf):
    det = X.detections(spark, sf).withColumn(
        "source", F.when(F.col("det_id") % 3 == 0, "grounding_dino").otherwise("vision")
    )
    return Q.entity_disappeared(det)


@query(
    "min_hits",
    f"""WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id) AS rn FROM det WHERE track_id IS NOT NULL)
    SELECT det_id, video_id, camera_id, track_id FROM r WHERE rn>=3""",
)
def min_hits(spark, sf):
    return Q.min_hits(X.detections(spark, sf), 3).select("det_id", "video_id", "camera_id", "track_id")


@query(
    "entity_id",
    f"""WITH {DET} SELECT det_id, CASE WHEN track_id IS NULL THEN object_type ELSE object_type || '#' || track_id END AS entity_id FROM det""",
)
def entity_id(spark, sf):
    from argusframe.functions.scalars import entity_id as eid

    return X.detections(spark, sf).select("det_id", eid(F.col("object_type"), F.col("track_id")).alias("entity_id"))
