"""Track summaries and the pair incidents built from them."""

from argusframe.checks.views import DET, sq_cx, sq_cy, sq_dist, sq_heading
from argusframe.operators import trajectories as TJ
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X
from argusframe.sources.session import materialize

_W = "PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id"
TRK = f"""{DET},
tk_a AS (SELECT *, {sq_cx('det')} AS cx, {sq_cy('det')} AS cy FROM det WHERE track_id IS NOT NULL),
tk_b AS (SELECT *, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(us) OVER w AS pus FROM tk_a WINDOW w AS ({_W})),
tk_c AS (SELECT *, CASE WHEN sqrt(vx*vx+vy*vy)<0.1 AND pus IS NOT NULL
    THEN sqrt((cx-pcx)*(cx-pcx)+(cy-pcy)*(cy-pcy))/greatest(0.05::DOUBLE,(us-pus)/1e6) ELSE sqrt(vx*vx+vy*vy) END AS sp FROM tk_b),
tk_j AS (SELECT *, sp-lag(sp) OVER ({_W}) AS d FROM tk_c WHERE sp>0),
jumps AS (SELECT video_id, camera_id, track_id, max(abs(d)) AS max_speed_delta FROM tk_j GROUP BY ALL HAVING max(abs(d))>=40),
tk_d AS (SELECT video_id, camera_id, track_id, arg_min(object_type,us) AS object_type, min(us) AS us0, max(us) AS us1, arg_min(det_id,us) AS d0,
    count(*) AS observations, max(confidence) AS confidence, avg(sp) FILTER (sp>0) AS msp,
    arg_min(cx,us) AS cx0, arg_min(cy,us) AS cy0, arg_max(cx,us) AS cx1, arg_max(cy,us) AS cy1 FROM tk_c GROUP BY ALL),
tk_e AS (SELECT *, greatest(0.1::DOUBLE,(us1-us0)/1e6) AS duration_s, sqrt((cx1-cx0)*(cx1-cx0)+(cy1-cy0)*(cy1-cy0)) AS displacement FROM tk_d),
tk_f AS (SELECT *, greatest(displacement/duration_s, coalesce(msp,0)) AS avg_speed, (cx1-cx0)/duration_s AS ovx, (cy1-cy0)/duration_s AS ovy FROM tk_e),
trk AS (SELECT t.*, CASE WHEN displacement>=15 OR avg_speed>=5 THEN {sq_heading('ovx','ovy')} ELSE 'Stationary' END AS direction,
    (duration_s>=3 AND displacement<=60) AS is_loitering, j.track_id IS NOT NULL AS has_sudden_change
  FROM tk_f t LEFT JOIN jumps j ON t.video_id=j.video_id AND t.camera_id=j.camera_id AND t.track_id=j.track_id)"""
TV = "('vehicle','car','truck','motorcycle')"


def tracks(spark, sf):
    return TJ.track_summaries(X.detections(spark, sf))


@query(
    "track_kinematics",
    f"""WITH {TRK} SELECT video_id, camera_id, track_id, object_type, us0, us1, observations, confidence, cx0, cy0, cx1, cy1,
    duration_s, displacement, avg_speed, direction, is_loitering, has_sudden_change FROM trk""",
    "confidence cx0 cy0 cx1 cy1 duration_s displacement avg_speed",
)
def track_kinematics(spark, sf):
    return tracks(spark, sf).drop("first_seq")


@query("sudden_change", f"WITH {TRK} SELECT * FROM jumps", "max_speed_delta")
def sudden_change(spark, sf):
    return TJ.sudden_changes(X.detections(spark, sf))


_INC = lambda k, c, w: (
    f"SELECT video_id, camera_id, track_id, object_type, {k} AS event_type, make_timestamp(us0) AS start_time, "
    f"make_timestamp(us1) AS end_time, {c} AS confidence FROM trk WHERE {w}"
)
INCIDENTS = " UNION ALL ".join(
    [
        _INC("upper(object_type) || '_TRACK'", "confidence", "true"),
        _INC("'LOITERING_DETECTED'", "0.88::DOUBLE", "is_loitering AND object_type IN ('person','vehicle')"),
        _INC("'RAPID_EGRESS_FLEEING'", "0.85::DOUBLE", "object_type='person' AND avg_speed>=75 AND displacement>=80"),
        _INC("'SUDDEN_VELOCITY_CHANGE'", "0.80::DOUBLE", "has_sudden_change"),
        _INC("'OFF_HOURS_PERIMETER_BREACH'", "0.85::DOUBLE", "hour(make_timestamp(us0))<6 OR hour(make_timestamp(us0))>=22"),
    ]
)


@query("track_incidents", f"WITH {TRK} {INCIDENTS}", "confidence")
def track_incidents(spark, sf):
    return TJ.track_incidents(tracks(spark, sf))


@query(
    "off_hours",
    f"WITH {TRK} {_INC(chr(39) + 'OFF_HOURS_PERIMETER_BREACH' + chr(39), '0.85::DOUBLE', 'hour(make_timestamp(us0))<6 OR hour(make_timestamp(us0))>=22')}",
    "confidence",
)
def off_hours(spark, sf):
    return TJ.track_incidents(tracks(spark, sf)).where("event_type = 'OFF_HOURS_PERIMETER_BREACH'")


CRASH = f"""SELECT video_id, camera_id, track_id, object_type, 'VEHICLE_CRASH_IMPACT' AS event_type, make_timestamp(us0) AS start_time,
  make_timestamp(us1) AS end_time, 0.88::DOUBLE AS confidence, avg_speed AS pre_speed FROM trk
  WHERE object_type IN {TV} AND avg_speed>=40 AND has_sudden_change"""


@query("vehicle_crash", f"WITH {TRK} {CRASH}", "confidence pre_speed")
def vehicle_crash(spark, sf):
    return TJ.vehicle_crash(tracks(spark, sf)).drop("first_seq")


CONV = f"""cv AS (SELECT a.video_id, a.camera_id, a.track_id AS track_a, b.track_id AS track_b, min({sq_dist('oa','ob')}) AS distance,
    greatest(a.us0,b.us0) AS s, least(a.us1,b.us1) AS e
  FROM trk a JOIN trk b ON a.video_id=b.video_id AND a.camera_id=b.camera_id AND (a.us0,a.d0)<(b.us0,b.d0)
  JOIN tk_a oa ON oa.video_id=a.video_id AND oa.camera_id=a.camera_id AND oa.track_id=a.track_id
  JOIN tk_a ob ON ob.video_id=b.video_id AND ob.camera_id=b.camera_id AND ob.track_id=b.track_id AND abs(oa.us-ob.us)<=600000
  WHERE a.object_type='person' AND b.object_type='person' AND least(a.us1,b.us1)>=greatest(a.us0,b.us0) GROUP BY ALL)"""


@query(
    "person_convergence",
    f"""WITH {TRK}, {CONV} SELECT video_id, camera_id, 'MULTI_PERSON_CONVERGENCE' AS event_type, make_timestamp(s) AS start_time,
    make_timestamp(e) AS end_time, 0.82::DOUBLE AS confidence, track_a, track_b, distance FROM cv WHERE distance<=150""",
    "confidence distance",
)
def person_convergence(spark, sf):
    return TJ.person_convergence(X.detections(spark, sf), materialize(tracks(spark, sf)))


COORD = f"""SELECT a.video_id, a.camera_id, 'SUSPECT_VEHICLE_COORDINATION' AS event_type, make_timestamp(least(a.us0,b.us0)) AS start_time,
  make_timestamp(greatest(a.us1,b.us1)) AS end_time, 0.84::DOUBLE AS confidence, a.track_id AS person_track, b.track_id AS vehicle_track,
  b.object_type, abs(a.us1-b.us1)/1e6 AS departure_delta_s, b.direction AS vehicle_heading, b.avg_speed AS vehicle_speed
  FROM trk a JOIN trk b ON a.video_id=b.video_id AND a.camera_id=b.camera_id
  WHERE a.object_type='person' AND b.object_type IN {TV} AND abs(a.us1-b.us1)/1e6<=4"""


@query("suspect_vehicle", f"WITH {TRK} {COORD}", "confidence departure_delta_s vehicle_speed")
def suspect_vehicle(spark, sf):
    return TJ.suspect_vehicle(tracks(spark, sf))


@query(
    "asset_interaction",
    f"""WITH {TRK} SELECT a.video_id, a.camera_id, 'SUSPICIOUS_ASSET_INTERACTION' AS event_type, make_timestamp(b.us0) AS start_time,
    make_timestamp(a.us1) AS end_time, 0.80::DOUBLE AS confidence, a.track_id AS person_track, b.track_id AS object_track, b.object_type,
    sqrt((a.cx1-b.cx1)*(a.cx1-b.cx1)+(a.cy1-b.cy1)*(a.cy1-b.cy1)) AS distance
    FROM trk a JOIN trk b ON a.video_id=b.video_id AND a.camera_id=b.camera_id
    WHERE a.object_type='person' AND b.object_type NOT IN ('person','vehicle','car','truck','motorcycle','motion') AND b.us1<=a.us1+2000000
      AND sqrt((a.cx1-b.cx1)*(a.cx1-b.cx1)+(a.cy1-b.cy1)*(a.cy1-b.cy1))<=100""",
    "confidence distance",
)
def asset_interaction(spark, sf):
    return TJ.asset_interaction(tracks(spark, sf))


_FI = (
    "(greatest(0.0,least(oa.x2,ob.x2)-greatest(oa.x1,ob.x1))*greatest(0.0,least(oa.y2,ob.y2)-greatest(oa.y1,ob.y1)))"
)
_FU = f"(greatest(1.0,(oa.x2-oa.x1)*(oa.y2-oa.y1))+greatest(1.0,(ob.x2-ob.x1)*(ob.y2-ob.y1))-{_FI})"
COLL = f"""cl_a AS (SELECT a.video_id, a.camera_id, a.track_id AS track_a, b.track_id AS track_b, a.object_type AS object_a, b.object_type AS object_b,
    least(a.us1,b.us1) AS e, {sq_dist('oa','ob')} AS d, CASE WHEN {_FU}>0 THEN {_FI}/{_FU} ELSE 0 END AS o, oa.us AS ous,
    greatest(a.avg_speed,b.avg_speed) AS sp, a.us0 AS au, a.d0 AS ad, b.us0 AS bu, b.d0 AS bd
  FROM trk a JOIN trk b ON a.video_id=b.video_id AND a.camera_id=b.camera_id AND (a.us0,a.d0)<(b.us0,b.d0)
  JOIN tk_a oa ON oa.video_id=a.video_id AND oa.camera_id=a.camera_id AND oa.track_id=a.track_id
  JOIN tk_a ob ON ob.video_id=b.video_id AND ob.camera_id=b.camera_id AND ob.track_id=b.track_id AND abs(oa.us-ob.us)<=600000
  WHERE a.object_type IN {TV} AND b.object_type IN {TV} AND least(a.us1,b.us1)>=greatest(a.us0,b.us0)),
cl AS (SELECT video_id, camera_id, track_a, track_b, object_a, object_b, e, min(d) AS min_distance, max(o) AS max_iou,
    arg_min(ous, (d, ous)) AS ius, sp, au, ad, bu, bd FROM cl_a GROUP BY ALL),
coll AS (SELECT * FROM cl WHERE (max_iou>=0.05 OR min_distance<=130) AND sp>=15)"""


@query(
    "vehicle_collision",
    f"""WITH {TRK}, {COLL} SELECT video_id, camera_id, 'VEHICLE_COLLISION_DETECTED' AS event_type, make_timestamp(ius) AS start_time,
    make_timestamp(e) AS end_time, 0.92::DOUBLE AS confidence, track_a, track_b, object_a, object_b, min_distance, max_iou FROM coll""",
    "confidence min_distance max_iou",
)
def vehicle_collision(spark, sf):
    t = materialize(tracks(spark, sf))
    return TJ.vehicle_collision(X.detections(spark, sf), t).drop(
        "a_first_seq", "b_first_seq"
    )


SCENE_SQL = f"""
WITH {TRK}, {COLL}, crash AS ({CRASH}), coord AS ({COORD}),
b AS (SELECT video_id, camera_id, count(*) AS tracks, count(*) FILTER (object_type='person') AS people,
   count(*) FILTER (object_type IN {TV}) AS vehicles, count(*) FILTER (is_loitering) AS loitering,
   count(*) FILTER (object_type='person' AND avg_speed>=75 AND displacement>=80) AS fleeing FROM trk GROUP BY ALL),
cr AS (SELECT video_id, camera_id, 0 AS grp, au AS o1, ad AS o2, bu AS o3, bd AS o4,
    'CRITICAL: CRITICAL INCIDENT: Vehicle Collision / Impact Detected (Vehicle #' || track_a || ' & #' || track_b || ') at ' || strftime(make_timestamp(ius),'%H:%M:%S') AS line FROM coll
  UNION ALL SELECT t.video_id, t.camera_id, 1, t.us0, t.d0, 0, 0,
    'CRITICAL: CRITICAL INCIDENT: Sudden Vehicle Crash / Impact: ' || upper(t.object_type[1]) || t.object_type[2:] || ' #' || t.track_id || ' at ' || strftime(make_timestamp(t.us0),'%H:%M:%S')
    FROM trk t WHERE object_type IN {TV} AND avg_speed>=40 AND has_sudden_change),
nc AS (SELECT video_id, camera_id, count(*) AS crashes FROM cr GROUP BY ALL),
no AS (SELECT video_id, camera_id, count(*) AS coordination FROM coord GROUP BY ALL),
ln AS (SELECT video_id, camera_id, row_number() OVER (PARTITION BY video_id, camera_id ORDER BY grp,o1,o2,o3,o4) AS rn, 3 AS cap, 0 AS off, line FROM cr
  UNION ALL SELECT video_id, camera_id, row_number() OVER (PARTITION BY video_id, camera_id ORDER BY us0,d0), 5, 3,
    'Tracked ' || object_type || ' #' || track_id || ' moving ' || direction || ' (speed ' || printf('%.1f', avg_speed) || ' px/s)' FROM trk),
ke AS (SELECT video_id, camera_id, string_agg(line, '|' ORDER BY off, rn) AS key_events FROM ln WHERE rn<=cap GROUP BY ALL)
SELECT b.video_id, b.camera_id, 'Forensic Scene Analysis: ' || coalesce(nullif(concat_ws(', ',
   CASE WHEN crashes>0 THEN 'CRITICAL: Traffic Collision Flagged (' || crashes || ' Incident(s))' END,
   CASE WHEN people>0 THEN people || ' Person(s)' END, CASE WHEN vehicles>0 THEN vehicles || ' Vehicle(s)' END,
   CASE WHEN fleeing>0 THEN 'Rapid Fleeing Detected' END), ''), 'Motion Activity') AS headline,
  tracks, people, vehicles, loitering, fleeing, coalesce(coordination,0) AS coordination, coalesce(crashes,0) AS crashes, key_events,
  CASE WHEN crashes>0 THEN 0.95::DOUBLE ELSE 0.90::DOUBLE END AS confidence
FROM b LEFT JOIN nc USING (video_id, camera_id) LEFT JOIN no USING (video_id, camera_id) LEFT JOIN ke USING (video_id, camera_id)"""


@query("scene_summary", SCENE_SQL, "confidence")
def scene_summary(spark, sf):
    t = materialize(tracks(spark, sf))
    return TJ.scene_summary(
        t,
        TJ.vehicle_collision(X.detections(spark, sf), t),
        TJ.vehicle_crash(t),
        TJ.suspect_vehicle(t),
    )
