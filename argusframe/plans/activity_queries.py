"""Sessions, activities, summaries, digests and motion."""

from pyspark.sql import functions as F

from argusframe.checks.events_sql import ACT, DEV
from argusframe.checks.views import DET, FRAMES, VEV, sq_cx, sq_cy, sq_heading
from argusframe.operators import activity as A, incidents as I
from argusframe.plans import incident_queries as IQ
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X

KIN = "displacement avg_speed cx0 cy0 cx1 cy1"


def detection_event_rows(spark, sf):
    return A.detection_events(X.detections(spark, sf))


@query(
    "sessions_ts",
    f"WITH {DEV} SELECT video_id, camera_id, object_type, track_id, start_time, end_time, detection_count FROM dev",
)
def sessions_ts(spark, sf):
    return A.session_sizes(X.detections(spark, sf), slice_seconds=10)


@query("detection_events", f"WITH {DEV} SELECT * FROM dev", f"confidence {KIN}")
def detection_events(spark, sf):
    return detection_event_rows(spark, sf)


@query(
    "detection_events_confirmed",
    f"WITH {DEV} SELECT * FROM dev WHERE detection_count>=3 AND date_diff('microsecond', start_time, end_time)>=2000000",
    f"confidence {KIN}",
)
def detection_events_confirmed(spark, sf):
    return A.detection_events(
        X.detections(spark, sf), min_observations=3, min_duration_s=2.0, slice_seconds=5
    )


VELOCITY_SQL = f"""
WITH {DET}, v AS (SELECT *, {sq_cx('det')} AS cx, {sq_cy('det')} AS cy FROM det WHERE track_id IS NOT NULL),
l AS (SELECT *, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(us) OVER w AS pus FROM v
  WINDOW w AS (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id)),
s AS (SELECT *, sqrt(vx*vx+vy*vy)<0.1 AND pus IS NOT NULL AS still, greatest(0.05::DOUBLE,(us-pus)/1e6) AS dt FROM l)
SELECT det_id, video_id, camera_id, track_id,
  CASE WHEN still THEN (cx-pcx)/dt ELSE vx END AS ivx, CASE WHEN still THEN (cy-pcy)/dt ELSE vy END AS ivy
FROM s"""


@query("velocity_backfill", VELOCITY_SQL, "ivx ivy")
def velocity_backfill(spark, sf):
    rows = X.detections(spark, sf).where("track_id IS NOT NULL")
    return A.velocity_backfill(rows).select(
        "det_id", "video_id", "camera_id", "track_id", "ivx", "ivy"
    )


@query(
    "sessions_interval",
    f"WITH {ACT} SELECT video_id, s AS start_time, e AS end_time, n AS event_count FROM ac_g",
)
def sessions_interval(spark, sf):
    return A.interval_islands(X.video_events(spark, sf))


@query(
    "reconstruct_events",
    f"WITH {ACT} SELECT * REPLACE (array_to_string(objects, '|') AS objects) FROM act",
    "confidence",
)
def reconstruct_events(spark, sf):
    return A.reconstruct_events(X.video_events(spark, sf))


SUMMARY_SQL = f"""
WITH {ACT}, vids AS (SELECT DISTINCT 'CH-0' || (l_suppkey % 8) AS video_id FROM lineitem),
g AS (SELECT video_id, min(start_time) AS start_time, arg_max(end_time, start_time) AS end_time, count(*) AS n, max(confidence) AS c,
   bool_or(event_type='POSSIBLE_VEHICLE_INTERACTION') AS h1, bool_or(event_type='PERSON_VEHICLE_ACTIVITY') AS h2,
   bool_or(event_type='PERSON_OBJECT_ACTIVITY') AS h3, bool_or(event_type='MOTION_ACTIVITY') AS h4,
   list_sort(list_distinct(flatten(list(objects)))) AS objs FROM act GROUP BY video_id)
SELECT v.video_id,
  CASE WHEN n IS NULL THEN 'No significant activity detected' WHEN h1 THEN 'Possible vehicle interaction detected'
    WHEN h2 THEN 'Person and vehicle activity detected' WHEN h3 THEN 'Person and object activity detected'
    WHEN h4 THEN 'Significant scene activity detected' ELSE 'Detected activity in video' END AS headline,
  start_time, end_time, coalesce(n,0) AS event_count, coalesce(array_to_string(objs,'|'),'') AS objects_detected,
  coalesce(c,0.0) AS confidence,
  CASE WHEN n IS NULL THEN NULL WHEN c>=0.80 THEN 'HIGH' WHEN c>=0.60 THEN 'MEDIUM' WHEN c>=0.35 THEN 'LOW' ELSE 'VERY LOW' END AS confidence_label
FROM vids v LEFT JOIN g USING (video_id)"""


@query("video_summary", SUMMARY_SQL, "confidence")
def video_summary(spark, sf):
    videos = X.recordings(spark, sf).selectExpr("camera_id AS video_id")
    return A.video_summary(A.reconstruct_events(X.video_events(spark, sf)), videos)


@query(
    "summary_key_events",
    f"WITH {ACT} SELECT video_id, start_time, strftime(start_time, '%Y-%m-%d %H:%M:%S') || ' - ' || title AS line FROM act",
)
def summary_key_events(spark, sf):
    return A.summary_key_events(A.reconstruct_events(X.video_events(spark, sf)))


@query(
    "confidence_label",
    f"""WITH {VEV} SELECT event_id, CASE WHEN confidence>=0.80 THEN 'HIGH' WHEN confidence>=0.60 THEN 'MEDIUM'
    WHEN confidence>=0.35 THEN 'LOW' ELSE 'VERY LOW' END AS label FROM vev""",
)
def confidence_label(spark, sf):
    from argusframe.functions.scalars import confidence_label as label

    ev = X.video_events(spark, sf)
    return ev.select("event_id", label(F.coalesce(ev["confidence"], F.lit(0.0))).alias("label"))


SPANS = f"""{DEV},
sp_a AS (SELECT camera_id, coalesce(CAST(track_id AS VARCHAR),'0') AS track_id, lower(object_type) AS object_type,
    min(start_time) AS st, arg_max(end_time, start_time) AS et, count(*) AS observation_count,
    arg_max(direction, start_time) FILTER (direction<>'Stationary') AS dir, max(avg_speed) AS spd, bool_or(is_loitering) AS loi,
    sum(detection_count) AS boxes, arg_min(cx0,start_time) AS cx0, arg_min(cy0,start_time) AS cy0,
    arg_max(cx1,start_time) AS cx1, arg_max(cy1,start_time) AS cy1
  FROM dev GROUP BY ALL),
sp_b AS (SELECT *, greatest(0.1::DOUBLE, (epoch_us(et)-epoch_us(st))/1e6) AS duration_s,
    sqrt((cx1-cx0)*(cx1-cx0)+(cy1-cy0)*(cy1-cy0)) AS disp FROM sp_a),
sp_c AS (SELECT *, (dir IS NULL OR spd=0) AND boxes>=2 AS fb, (cx1-cx0)/duration_s AS ovx, (cy1-cy0)/duration_s AS ovy FROM sp_b),
spans AS (SELECT camera_id, track_id, object_type, st AS start_time, et AS end_time, duration_s, observation_count,
    CASE WHEN fb AND (disp>=15 OR disp/duration_s>=5) THEN {sq_heading('ovx','ovy')} ELSE coalesce(dir,'Stationary') END AS direction,
    CASE WHEN fb AND (disp>=15 OR disp/duration_s>=5) THEN disp/duration_s ELSE spd END AS avg_speed,
    loi OR (fb AND duration_s>=3 AND disp<=60 AND object_type IN ('person','vehicle','car')) AS is_loitering
  FROM sp_c)"""


@query("track_spans", f"WITH {SPANS} SELECT * FROM spans", "duration_s avg_speed")
def track_spans(spark, sf):
    return A.track_spans(detection_event_rows(spark, sf))


def digest_input(spark, sf):
    """Detection events together with the looming and stop flags of the same detections."""
    det = X.detections(spark, sf)
    base = A.detection_events(det)
    flags = I.ego_looming(det).unionByName(I.sudden_stops(det), allowMissingColumns=True)
    return base.unionByName(
        flags.select("video_id", "camera_id", "event_type", "start_time", "end_time", "confidence", "track_id", "object_type"),
        allowMissingColumns=True,
    )


def _inner(sql: str) -> str:
    """A registered statement as a derived table beside an already defined `det`."""
    return "(" + sql.replace(f"WITH {DET}, ", "WITH ") + ")"


DIGEST = f"""{DEV},
dg_u AS (SELECT video_id, camera_id, event_type, start_time, end_time, track_id, object_type, entity_id, avg_speed, direction, is_loitering FROM dev
  UNION ALL BY NAME SELECT video_id, camera_id, event_type, start_time, end_time, track_id, object_type FROM {_inner(IQ.LOOMING_SQL)}
  UNION ALL BY NAME SELECT video_id, camera_id, event_type, start_time, end_time, track_id, object_type FROM {_inner(IQ.STOPS_SQL)}),
dg_a AS (SELECT *, coalesce(object_type,'object') AS obj, (epoch_us(end_time)-epoch_us(start_time))/1e6 AS dur,
    coalesce(direction,'Stationary') AS dir, coalesce(avg_speed,0) AS spd FROM dg_u),
dg_b AS (SELECT *, coalesce(is_loitering,false) OR (dur>=4 AND dir='Stationary' AND obj IN ('person','vehicle','car')) AS linger,
    regexp_matches(event_type,'REVIEW_FLAG|PROXIMITY|COLLISION') AS review FROM dg_a),
dg AS (SELECT *, NOT linger AND dir<>'Stationary' AND spd>=5 AS moves FROM dg_b)"""


@query(
    "activity_digest",
    f"""WITH {DIGEST} SELECT video_id, count(*) AS total_events, count(*) FILTER (linger) AS loitering_events,
    count(*) FILTER (moves) AS movement_highlights, count(*) FILTER (review) AS review_flags,
    strftime(min(start_time),'%H:%M:%S') AS range_start, strftime(max(end_time),'%H:%M:%S') AS range_end, 0 AS suppressed_noise
    FROM dg GROUP BY video_id""",
)
def activity_digest(spark, sf):
    return A.activity_digest(digest_input(spark, sf))


@query(
    "digest_entities",
    f"""WITH {DIGEST} SELECT video_id, obj AS object_type,
    count(DISTINCT coalesce(CAST(track_id AS VARCHAR), entity_id, obj || '#unknown')) AS entities FROM dg GROUP BY ALL""",
)
def digest_entities(spark, sf):
    return A.digest_entities(digest_input(spark, sf))


_NAME = "coalesce(entity_id, obj || '#unknown')"
_S, _E = "strftime(start_time,'%H:%M:%S')", "strftime(end_time,'%H:%M:%S')"


@query(
    "digest_items",
    f"""WITH {DIGEST}
SELECT video_id, start_time, 'loitering' AS section, '- **' || {_NAME} || '**: Loitering for ' || printf('%.1f', dur) || 's (`' || {_S} || '` - `' || {_E} || '` on ' || camera_id || ')' AS line FROM dg WHERE linger
UNION ALL SELECT video_id, start_time, 'movement', '- **' || {_NAME} || '**: ' || dir || ' at ~' || printf('%.1f', spd) || ' px/s (`' || {_S} || '` - `' || {_E} || '`)' FROM dg WHERE moves
UNION ALL SELECT video_id, start_time, 'review', '- `[' || {_S} || ']` **' || event_type || '**' FROM dg WHERE review""",
)
def digest_items(spark, sf):
    return A.digest_items(digest_input(spark, sf))


MOTION_SQL = f"""
WITH {FRAMES}, s AS (SELECT *, mean_luma/10000 AS score, mean_luma/10000>=0.01 AS hit FROM frames),
h AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY video_id ORDER BY pts, frame_number) AS hn FROM s),
m AS (SELECT video_id, hn, max(pts) FILTER (NOT hit) AS miss, max(pts) FILTER (hit) AS hitp FROM h GROUP BY ALL),
k AS (SELECT video_id, hn AS prev_hn, miss-hitp>2 AS cut FROM m WHERE hn>0),
r AS (SELECT h.*, coalesce(k.cut,false) AS opens FROM h LEFT JOIN k ON h.video_id=k.video_id AND h.hn-1=k.prev_hn WHERE hit),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY video_id ORDER BY pts, frame_number) AS grp FROM r),
f AS (SELECT video_id, grp, min(pts) AS start_seconds, max(pts) AS end_seconds, max(score) AS peak_score FROM g GROUP BY ALL)
SELECT video_id, start_seconds, end_seconds, peak_score FROM f WHERE end_seconds-start_seconds>=1"""


@query("motion_events", MOTION_SQL, "start_seconds end_seconds peak_score")
def motion_events(spark, sf):
    return A.motion_events(motion_samples(spark, sf), slice_seconds=4)


def motion_samples(spark, sf):
    return X.frames(spark, sf).selectExpr(
        "video_id", "frame_number", "pts", "mean_luma / 10000 AS score"
    )


_FAMS = {
    "proximity": IQ.PROXIMITY_SQL, "looming": IQ.LOOMING_SQL, "stops": IQ.STOPS_SQL,
    "assault": IQ.ASSAULT_SQL, "fighting": IQ.FIGHT_SQL, "robbery": IQ.ROBBERY_SQL,
    "road": IQ.ROAD_SQL, "ped": IQ.PED_SQL, "crowd": IQ.CROWD_SQL, "vandal": IQ.VANDAL_SQL,
    "shop": IQ.SHOP_SQL,
}
_COLS = "video_id, camera_id, event_type, start_time, end_time, confidence"
ALL_SQL = f"WITH {DEV} SELECT {_COLS} FROM dev " + " ".join(
    f"UNION ALL SELECT {_COLS} FROM {_inner(s)}" for s in _FAMS.values()
)


@query("all_events", ALL_SQL, "confidence")
def all_events(spark, sf):
    det = X.detections(spark, sf)
    rows = A.all_events(
        [
            A.detection_events(det), I.proximity_flags(det), I.ego_looming(det),
            I.sudden_stops(det), I.assault(det), I.fighting(det), I.robbery(det),
            I.road_accident(det), I.pedestrian_struck(det), I.crowd_panic(det),
            I.vandalism(det), I.shoplifting(det),
        ]
    )
    return rows.drop("track_id", "object_type")
