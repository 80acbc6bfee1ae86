"""Same-frame, track and interval incidents over the detections view."""

from argusframe.checks.views import (
    DET, sq_clamp, sq_cx, sq_cy, sq_dist, sq_edge, sq_iou,
)
from argusframe.operators import incidents as I
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X

VEH = "('car','truck','bus','motorcycle','vehicle','bicycle')"
_IOU, _EDGE = sq_iou("a", "b"), sq_edge("a", "b")

PROXIMITY_SQL = f"""
WITH {DET}, p AS (
  SELECT a.video_id, a.camera_id, a.frame_number, a.ts, a.track_id AS track_a, a.object_type AS object_a,
         b.track_id AS track_b, b.object_type AS object_b, {_IOU} AS iou, {_EDGE} AS edge_distance_px
  FROM det a JOIN det b ON a.video_id=b.video_id AND a.camera_id=b.camera_id AND a.frame_number=b.frame_number
   AND a.det_id < b.det_id AND a.track_id <> b.track_id)
SELECT video_id, camera_id, frame_number,
  CASE WHEN iou>=0.15 OR edge_distance_px<=15 THEN 'REVIEW_FLAG_POSSIBLE_CONTACT' ELSE 'REVIEW_FLAG_PROXIMITY' END AS event_type,
  ts AS start_time, ts AS end_time,
  greatest(0.5::DOUBLE, iou, 1-edge_distance_px/40) AS confidence,
  track_a, object_a, track_b, object_b, iou, edge_distance_px
FROM p WHERE iou>=0.05 OR edge_distance_px<=40"""


@query("proximity_flags", PROXIMITY_SQL, "confidence iou edge_distance_px")
def proximity_flags(spark, sf):
    return I.proximity_flags(X.detections(spark, sf))


LOOMING_SQL = f"""
WITH {DET}, v AS (
  SELECT *, lag(ts) OVER w AS pts, lag(us) OVER w AS pus, lag(x2-x1) OVER w AS pw, lag(y2-y1) OVER w AS ph
  FROM det WHERE track_id IS NOT NULL AND object_type IN ('car','vehicle','truck','bus','motorcycle')
  WINDOW w AS (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id)),
m AS (
  SELECT *, (greatest(1.0,x2-x1)*greatest(1.0,y2-y1)) / greatest(1.0, greatest(1.0,pw)*greatest(1.0,ph)) AS ratio,
    (greatest(1.0,x2-x1)-greatest(1.0,pw)) / greatest(0.05::DOUBLE,(us-pus)/1e6) AS rate,
    greatest(1.0,x2-x1)*greatest(1.0,y2-y1) AS ar
  FROM v WHERE pts IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id) AS rn
  FROM m WHERE (ratio>=1.35 OR rate>=25) AND (y2>=180 OR ar>=15000))
SELECT video_id, camera_id, track_id, object_type, 'REVIEW_FLAG_EGO_COLLISION_WARNING' AS event_type,
  pts AS start_time, ts AS end_time,
  least(0.95::DOUBLE, 0.55::DOUBLE + least(0.40::DOUBLE, (ratio-1)*0.3::DOUBLE)) AS confidence,
  ratio AS area_growth_ratio, rate AS expansion_px_s
FROM h WHERE rn=1"""


@query("ego_looming", LOOMING_SQL, "confidence area_growth_ratio expansion_px_s")
def ego_looming(spark, sf):
    return I.ego_looming(X.detections(spark, sf))


STOPS_SQL = f"""
WITH {DET}, v AS (
  SELECT *, lag(us) OVER w AS pus, {sq_cx('det')} AS cx, {sq_cy('det')} AS cy,
    lag({sq_cx('det')}) OVER w AS px, lag({sq_cy('det')}) OVER w AS py
  FROM det WHERE track_id IS NOT NULL
  WINDOW w AS (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id)),
s AS (SELECT *, sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py))/((us-pus)/1e6) AS sp FROM v WHERE us>pus),
q AS (SELECT *, lag(sp) OVER w AS psp, lag(ts) OVER w AS pts FROM s
  WINDOW w AS (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id))
SELECT video_id, camera_id, track_id, object_type, 'REVIEW_FLAG_SUDDEN_STOP' AS event_type,
  pts AS start_time, ts AS end_time, confidence, psp AS speed_before, sp AS speed_after
FROM q WHERE psp>=3 AND sp<=psp*0.5"""


@query("sudden_stops", STOPS_SQL, "confidence speed_before speed_after")
def sudden_stops(spark, sf):
    return I.sudden_stops(X.detections(spark, sf))


ASSAULT_SQL = f"""
WITH {DET}, p AS (SELECT *, {sq_cx('det')} AS cx, {sq_cy('det')} AS cy FROM det
  WHERE object_type='person' AND track_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, camera_id, track_id ORDER BY ts DESC, det_id DESC) AS rn FROM p),
e AS (SELECT r1.video_id, r1.camera_id, r1.track_id, r1.cx AS cx1, r1.cy AS cy1, r2.cx AS cx2, r2.cy AS cy2, r2.us AS us2
  FROM r r1 JOIN r r2 USING (video_id, camera_id, track_id) WHERE r1.rn=1 AND r2.rn=2),
o AS (SELECT a.video_id, a.camera_id, a.frame_number, a.track_id, b.track_id AS victim_track,
    a.ts AS start_time, b.ts AS end_time, a.us, b.cx AS vx, b.cy AS vy, {_IOU} AS iou
  FROM p a JOIN p b ON a.video_id=b.video_id AND a.camera_id=b.camera_id AND a.frame_number=b.frame_number AND a.track_id<>b.track_id
  WHERE {_IOU}>=0.12),
c AS (SELECT o.*, (sqrt((vx-cx2)*(vx-cx2)+(vy-cy2)*(vy-cy2)) - sqrt((vx-cx1)*(vx-cx1)+(vy-cy1)*(vy-cy1)))
    / greatest(0.05::DOUBLE,(us-us2)/1e6) AS ap
  FROM o JOIN e USING (video_id, camera_id, track_id))
SELECT video_id, camera_id, frame_number, 'ANOMALY_ASSAULT' AS event_type, start_time, end_time,
  {sq_clamp("least(0.90::DOUBLE, 0.55::DOUBLE+least(0.35::DOUBLE,ap/200)+iou*0.2::DOUBLE)")} AS confidence,
  track_id, victim_track, ap AS approach_px_s, iou AS contact_iou
FROM c WHERE ap>=60"""


@query("anomaly_assault", ASSAULT_SQL, "confidence approach_px_s contact_iou")
def anomaly_assault(spark, sf):
    return I.assault(X.detections(spark, sf))


FIRSTS = """p AS (SELECT * FROM det WHERE object_type='person' AND track_id IS NOT NULL),
f AS (SELECT video_id, camera_id, track_id, min(us) AS fus, arg_min(det_id, us) AS fid, count(*) AS n
  FROM p GROUP BY ALL),
pf AS (SELECT p.*, fus, fid, n FROM p JOIN f USING (video_id, camera_id, track_id))"""
PAIRJ = """a.video_id=b.video_id AND a.camera_id=b.camera_id AND a.frame_number=b.frame_number
  AND (a.fus, a.fid) < (b.fus, b.fid)"""

FIGHT_SQL = f"""
WITH {DET}, {FIRSTS},
j AS (SELECT a.video_id, a.camera_id, a.track_id AS track_a, b.track_id AS track_b, a.frame_number, a.us,
    {_EDGE} AS ed, sqrt((a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy)) AS rs
  FROM pf a JOIN pf b ON {PAIRJ}),
g AS (SELECT video_id, camera_id, track_a, track_b, count(*) AS common, count(*) FILTER (ed<=50) AS close_frames,
    avg(rs) FILTER (ed<=50) AS avg_relative_speed, arg_min(us, frame_number) AS us0, arg_max(us, frame_number) AS us1
  FROM j GROUP BY ALL)
SELECT video_id, camera_id, 'ANOMALY_FIGHTING' AS event_type, make_timestamp(us0) AS start_time, make_timestamp(us1) AS end_time,
  {sq_clamp("least(0.88::DOUBLE, 0.50::DOUBLE+least(0.35::DOUBLE,avg_relative_speed/200)+least(0.15::DOUBLE,((us1-us0)/1e6)/20))")} AS confidence,
  track_a, track_b, (us1-us0)/1e6 AS duration_s, avg_relative_speed, close_frames
FROM g WHERE common>=3 AND close_frames>=3 AND avg_relative_speed>=30 AND (us1-us0)/1e6>=1.5"""


@query("anomaly_fighting", FIGHT_SQL, "confidence duration_s avg_relative_speed")
def anomaly_fighting(spark, sf):
    return I.fighting(X.detections(spark, sf))


_AREA = lambda a: f"(greatest(0.0,{a}.x2-{a}.x1)*greatest(0.0,{a}.y2-{a}.y1))"
ROBBERY_SQL = f"""
WITH {DET}, {FIRSTS},
j AS (SELECT a.video_id, a.camera_id, a.frame_number, a.track_id AS track_a, b.track_id AS track_b,
    a.ts AS start_time, b.ts AS end_time, a.us, {sq_cx('a')} AS ax, {sq_cy('a')} AS ay, {sq_cx('b')} AS bx, {sq_cy('b')} AS by_,
    {_AREA('b')} AS ab
  FROM pf a JOIN pf b ON {PAIRJ} WHERE a.n>=3 AND b.n>=3),
l AS (SELECT *, lag(us) OVER w AS pus, lag(ax) OVER w AS pax, lag(ay) OVER w AS pay, lag(ab) OVER w AS pab FROM j
  WINDOW w AS (PARTITION BY video_id, camera_id, track_a, track_b ORDER BY frame_number)),
c AS (SELECT *, (sqrt((bx-pax)*(bx-pax)+(by_-pay)*(by_-pay)) - sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))
     / greatest(0.05::DOUBLE,(us-pus)/1e6) AS ap,
    CASE WHEN pab>0 THEN ab/greatest(1.0,pab) ELSE 1.0 END AS sr FROM l WHERE pus IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY video_id, camera_id, track_a, track_b ORDER BY frame_number) AS rn
  FROM c WHERE ap>=50 AND sr<=0.60)
SELECT video_id, camera_id, frame_number, 'ANOMALY_ROBBERY' AS event_type, start_time, end_time,
  {sq_clamp("least(0.85::DOUBLE, 0.48::DOUBLE+least(0.30::DOUBLE,ap/200)+(1-sr)*0.20::DOUBLE)")} AS confidence,
  track_a, track_b, ap AS approach_px_s, sr AS shrink_ratio
FROM h WHERE rn=1"""


@query("anomaly_robbery", ROBBERY_SQL, "confidence approach_px_s shrink_ratio")
def anomaly_robbery(spark, sf):
    return I.robbery(X.detections(spark, sf))


ROAD_SQL = f"""
WITH {DET}, p AS (SELECT *, sqrt(vx*vx+vy*vy) AS sp FROM det WHERE track_id IS NOT NULL AND object_type IN {VEH}),
j AS (SELECT a.video_id, a.camera_id, a.frame_number, a.ts AS start_time, b.ts AS end_time, a.track_id AS track_a,
    b.track_id AS track_b, a.object_type, {_IOU} AS collision_iou, a.sp AS speed_a, b.sp AS speed_b
  FROM p a JOIN p b ON a.video_id=b.video_id AND a.camera_id=b.camera_id AND a.frame_number=b.frame_number
   AND a.det_id<b.det_id AND a.track_id<>b.track_id)
SELECT video_id, camera_id, frame_number, 'ANOMALY_ROAD_ACCIDENT' AS event_type, start_time, end_time,
  {sq_clamp("least(0.92::DOUBLE, 0.60::DOUBLE+collision_iou*0.5::DOUBLE+least(0.15::DOUBLE,greatest(speed_a,speed_b)/300))")} AS confidence,
  track_a, track_b, object_type, collision_iou, speed_a, speed_b
FROM j WHERE collision_iou>=0.10 AND greatest(speed_a,speed_b)>=15"""


@query("anomaly_road_accident", ROAD_SQL, "confidence collision_iou speed_a speed_b")
def anomaly_road_accident(spark, sf):
    return I.road_accident(X.detections(spark, sf))


PED_SQL = f"""
WITH {DET}, p AS (SELECT *, sqrt(vx*vx+vy*vy) AS sp FROM det WHERE track_id IS NOT NULL),
j AS (SELECT a.video_id, a.camera_id, a.frame_number, a.ts AS start_time, b.ts AS end_time, a.track_id AS vehicle_track,
    b.track_id AS pedestrian_track, a.object_type, {_IOU} AS contact_iou, a.sp AS vehicle_speed
  FROM p a JOIN p b ON a.video_id=b.video_id AND a.camera_id=b.camera_id AND a.frame_number=b.frame_number
  WHERE a.object_type IN {VEH} AND b.object_type='person')
SELECT video_id, camera_id, frame_number, 'ANOMALY_PEDESTRIAN_STRUCK' AS event_type, start_time, end_time,
  {sq_clamp("least(0.93::DOUBLE, 0.65::DOUBLE+contact_iou*0.4::DOUBLE+least(0.15::DOUBLE,vehicle_speed/300))")} AS confidence,
  vehicle_track, pedestrian_track, object_type, contact_iou, vehicle_speed
FROM j WHERE contact_iou>=0.05 AND vehicle_speed>=7.5"""


@query("anomaly_pedestrian", PED_SQL, "confidence contact_iou vehicle_speed")
def anomaly_pedestrian(spark, sf):
    return I.pedestrian_struck(X.detections(spark, sf))


CROWD_SQL = f"""
WITH {DET}, g AS (
  SELECT video_id, camera_id, frame_number, min(ts) AS start_time, max(ts) AS end_time, count(*) AS person_count,
    count(*) FILTER (sqrt(vx*vx+vy*vy)>10) AS fast_count,
    sum(sin(atan2(vy,vx))) FILTER (sqrt(vx*vx+vy*vy)>10) AS ss, sum(cos(atan2(vy,vx))) FILTER (sqrt(vx*vx+vy*vy)>10) AS cc
  FROM det WHERE object_type='person' AND track_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, degrees(sqrt(-2*ln(greatest(1e-9::DOUBLE, sqrt(ss*ss+cc*cc)/fast_count)))) AS spread_deg
  FROM g WHERE person_count>=5 AND fast_count>=2.5)
SELECT video_id, camera_id, frame_number, 'ANOMALY_CROWD_PANIC' AS event_type, start_time, end_time,
  {sq_clamp("least(0.85::DOUBLE, 0.45::DOUBLE+least(0.30::DOUBLE,spread_deg/180)+person_count*0.03::DOUBLE)")} AS confidence,
  person_count, fast_count, spread_deg
FROM s WHERE spread_deg>=45"""


@query("anomaly_crowd", CROWD_SQL, "confidence spread_deg")
def anomaly_crowd(spark, sf):
    return I.crowd_panic(X.detections(spark, sf))


VANDAL_SQL = f"""
WITH {DET}, t AS (SELECT * FROM det WHERE track_id IS NOT NULL),
pp AS (SELECT video_id, camera_id, track_id, count(*) AS n, min(us) AS us0, max(us) AS us1,
    arg_min(x1,us) AS x1, arg_min(y1,us) AS y1, arg_min(x2,us) AS x2, arg_min(y2,us) AS y2,
    arg_max(x1,us) AS lx1, arg_max(y1,us) AS ly1, arg_max(x2,us) AS lx2, arg_max(y2,us) AS ly2
  FROM t WHERE object_type='person' GROUP BY ALL),
pc AS (SELECT * FROM pp WHERE n>=2 AND us1-us0>=3000000
  AND sqrt(((x1+x2)/2-(lx1+lx2)/2)*((x1+x2)/2-(lx1+lx2)/2)+((y1+y2)/2-(ly1+ly2)/2)*((y1+y2)/2-(ly1+ly2)/2))<=80),
ob AS (SELECT *, min(us) OVER (PARTITION BY video_id, camera_id, track_id) AS ofirst FROM t
  WHERE object_type IN ('car','vehicle','truck','bus','motorcycle','object','motion')),
g AS (SELECT a.video_id, a.camera_id, a.track_id, b.track_id AS object_track, a.us0, a.us1, b.ofirst, count(*) AS n,
    arg_min({_EDGE}, b.us) AS e0, arg_min({_AREA('b')}, b.us) AS a0, arg_max({_AREA('b')}, b.us) AS a1
  FROM pc a JOIN ob b ON a.video_id=b.video_id AND a.camera_id=b.camera_id AND b.us BETWEEN a.us0 AND a.us1 GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY video_id, camera_id, track_id ORDER BY ofirst, object_track) AS rn
  FROM g WHERE n>=2 AND e0<=100 AND a1<a0*0.5)
SELECT video_id, camera_id, 'ANOMALY_VANDALISM' AS event_type, make_timestamp(us0) AS start_time, make_timestamp(us1) AS end_time,
  {sq_clamp("least(0.82::DOUBLE, 0.45::DOUBLE+least(0.30::DOUBLE,((us1-us0)/1e6)/30)+(1-a1/greatest(1.0,a0))*0.15::DOUBLE)")} AS confidence,
  track_id, object_track, (us1-us0)/1e6 AS dwell_s, a1/greatest(1.0,a0) AS object_area_ratio
FROM h WHERE rn=1"""


@query("anomaly_vandalism", VANDAL_SQL, "confidence dwell_s object_area_ratio")
def anomaly_vandalism(spark, sf):
    return I.vandalism(X.detections(spark, sf))


SHOP_SQL = f"""
WITH {DET}, p AS (SELECT *, greatest(1.0,x2-x1)/greatest(1.0,y2-y1) AS ar,
    coalesce(lead(ts,3) OVER w, last_value(ts) OVER (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ets
  FROM det WHERE object_type='person' AND track_id IS NOT NULL
  WINDOW w AS (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY video_id, camera_id, track_id ORDER BY ts, det_id) AS rn FROM p WHERE ar>=1.6)
SELECT video_id, camera_id, track_id, 'ANOMALY_SHOPLIFTING' AS event_type, ts AS start_time, ets AS end_time,
  {sq_clamp("least(0.75::DOUBLE, 0.42::DOUBLE+least(0.30::DOUBLE,(ar-1.6::DOUBLE)*0.2::DOUBLE))")} AS confidence,
  ar AS aspect_ratio
FROM h WHERE rn=1"""


@query("anomaly_shoplifting", SHOP_SQL, "confidence aspect_ratio")
def anomaly_shoplifting(spark, sf):
    return I.shoplifting(X.detections(spark, sf))
