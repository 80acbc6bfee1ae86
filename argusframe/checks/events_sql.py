"""Shared statements: detection events and activity islands."""

from argusframe.checks.views import DET, VEV, sq_cx, sq_cy, sq_heading

_W = "PARTITION BY video_id, camera_id, object_type, track_id ORDER BY ts, det_id"

DEV = f"""{DET},
dv_a AS (SELECT *, {sq_cx('det')} AS cx, {sq_cy('det')} AS cy, lag(us) OVER ({_W}) AS pus FROM det),
dv_b AS (SELECT *, sum(CASE WHEN pus IS NULL OR us-pus>3000000 THEN 1 ELSE 0 END) OVER ({_W}) AS sid FROM dv_a),
dv_c AS (SELECT *, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(us) OVER w AS sus FROM dv_b
  WINDOW w AS (PARTITION BY video_id, camera_id, object_type, track_id, sid ORDER BY ts, det_id)),
dv_d AS (SELECT *, CASE WHEN sqrt(vx*vx+vy*vy)<0.1 AND sus IS NOT NULL
    THEN sqrt(((cx-pcx)/greatest(0.05::DOUBLE,(us-sus)/1e6))*((cx-pcx)/greatest(0.05::DOUBLE,(us-sus)/1e6))
            +((cy-pcy)/greatest(0.05::DOUBLE,(us-sus)/1e6))*((cy-pcy)/greatest(0.05::DOUBLE,(us-sus)/1e6)))
    ELSE sqrt(vx*vx+vy*vy) END AS sp FROM dv_c),
dv_e AS (SELECT video_id, camera_id, object_type, track_id, sid, min(us) AS us0, max(us) AS us1, count(*) AS n,
    max(confidence) AS confidence, arg_min(frame_number,us) AS first_frame, arg_max(frame_number,us) AS last_frame,
    avg(sp) FILTER (sp>0) AS msp, arg_min(cx,us) AS cx0, arg_min(cy,us) AS cy0, arg_max(cx,us) AS cx1, arg_max(cy,us) AS cy1
  FROM dv_d GROUP BY ALL),
dv_f AS (SELECT *, greatest(0.1::DOUBLE,(us1-us0)/1e6) AS dur, sqrt((cx1-cx0)*(cx1-cx0)+(cy1-cy0)*(cy1-cy0)) AS displacement FROM dv_e),
dv_g AS (SELECT *, greatest(displacement/dur, coalesce(msp,0)) AS avg_speed, (cx1-cx0)/dur AS ovx, (cy1-cy0)/dur AS ovy FROM dv_f),
dev AS (SELECT video_id, camera_id, upper(object_type) || '_DETECTED' AS event_type,
    make_timestamp(us0) AS start_time, make_timestamp(us1) AS end_time, confidence, track_id, object_type,
    CASE WHEN track_id IS NULL THEN object_type ELSE object_type || '#' || track_id END AS entity_id,
    n AS detection_count, first_frame, last_frame, displacement, avg_speed,
    CASE WHEN displacement>=15 OR avg_speed>=5 THEN {sq_heading('ovx', 'ovy')} ELSE 'Stationary' END AS direction,
    (dur>=3 AND displacement<=60 AND object_type IN ('person','vehicle','car')) AS is_loitering, cx0, cy0, cx1, cy1
  FROM dv_g)"""

_RV = "('car','truck','bus','motorcycle','bicycle')"
ACT = f"""{VEV},
ac_a AS (SELECT *, lag(e_us) OVER w AS pe FROM vev WINDOW w AS (PARTITION BY video_id ORDER BY s_us, event_id)),
ac_b AS (SELECT *, sum(CASE WHEN pe IS NULL OR s_us-pe>3000000 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s_us, event_id) AS isl FROM ac_a),
ac_s AS (SELECT video_id, isl, s_us, e_us, event_id FROM ac_b WHERE object_type IN {_RV} AND confidence>=0.60),
ac_n AS (SELECT DISTINCT a.video_id, a.isl FROM ac_s a JOIN ac_s b ON a.video_id=b.video_id AND a.isl=b.isl AND a.event_id<>b.event_id
  WHERE greatest(0, b.s_us-a.e_us, a.s_us-b.e_us) <= 1500000),
ac_g AS (SELECT video_id, isl, arg_min(camera_id, (s_us, event_id)) AS camera_id, min(start_time) AS s, max(end_time) AS e, max(confidence) AS c,
    min(start_time) FILTER (object_type IN {_RV}) AS vs, max(end_time) FILTER (object_type IN {_RV}) AS ve,
    max(confidence) FILTER (object_type IN {_RV}) AS vc, count(*) AS n, count(*) FILTER (object_type IN {_RV}) AS nv,
    coalesce(bool_or(object_type='person'), false) AS people, bool_or(event_type='MOTION') AS motion,
    coalesce(list_sort(list(DISTINCT object_type) FILTER (object_type IS NOT NULL)), []) AS objs
  FROM ac_b GROUP BY ALL),
ac_r AS (SELECT g.*, n.isl IS NOT NULL AS inter,
    CASE WHEN n.isl IS NOT NULL THEN 'POSSIBLE_VEHICLE_INTERACTION' WHEN people AND nv>0 THEN 'PERSON_VEHICLE_ACTIVITY'
      WHEN people AND len(objs)>=2 THEN 'PERSON_OBJECT_ACTIVITY' WHEN motion THEN 'MOTION_ACTIVITY' ELSE 'GENERAL_ACTIVITY' END AS event_type
  FROM ac_g g LEFT JOIN ac_n n ON g.video_id=n.video_id AND g.isl=n.isl),
act AS (SELECT video_id, camera_id, event_type,
    CASE event_type WHEN 'POSSIBLE_VEHICLE_INTERACTION' THEN 'Possible vehicle interaction'
      WHEN 'PERSON_VEHICLE_ACTIVITY' THEN 'Person and vehicle activity' WHEN 'PERSON_OBJECT_ACTIVITY' THEN 'Person and object activity'
      WHEN 'MOTION_ACTIVITY' THEN 'Motion activity detected' ELSE 'Detected activity' END AS title,
    CASE WHEN inter THEN vs ELSE s END AS start_time, CASE WHEN inter THEN ve ELSE e END AS end_time,
    coalesce(CASE WHEN inter THEN vc ELSE c END, 0) AS confidence, objs AS objects,
    CASE WHEN inter THEN nv ELSE n END AS evidence_count
  FROM ac_r)"""
