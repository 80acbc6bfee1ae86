"""The fixture views as common table expressions for an ANSI SQL engine."""

EPOCH = 1704067200000000

DET = f"""
det_a AS (
  SELECT event_id AS n, CAST(event_id % 8 AS INT) AS slot,
         CAST(event_id // 8 AS BIGINT) AS frame_number, user_id AS u, value AS v, event_type AS et
  FROM events),
det_b AS (SELECT *, frame_number // 50 AS scene, frame_number % 50 AS k FROM det_a),
det_c AS (
  SELECT *,
    CASE WHEN slot < 5 THEN 100 + 45*slot + u % 60 + (CASE WHEN slot = 4 AND scene % 4 = 3 THEN 400 ELSE 0 END)
         WHEN slot < 7 THEN 380 + (slot-5)*90 + u % 50
         ELSE (CASE WHEN k < 25 THEN 300 ELSE 310 END) END AS x1i,
    CASE WHEN slot < 5 THEN 100 + u % 20 WHEN slot < 7 THEN 150 + u % 30 ELSE 140 END AS y1i,
    CASE WHEN slot < 5 THEN (CASE WHEN v > 150 THEN 160 ELSE 40 END)
         WHEN slot < 7 THEN 80 + (u % 5)*20 ELSE (CASE WHEN k < 40 THEN 40 ELSE 20 END) END AS wi,
    CASE WHEN slot < 5 THEN 60 + (u % 3)*40
         WHEN slot < 7 THEN 60 + (u % 5)*15 ELSE (CASE WHEN k < 40 THEN 40 ELSE 20 END) END AS hi
  FROM det_b WHERE NOT (slot = 6 AND scene % 3 = 0 AND k >= 20)),
det AS (
  SELECT n AS det_id, 'vid-' || scene AS video_id, 'CH-0' || (scene % 4) AS camera_id, frame_number,
    make_timestamp({EPOCH} + scene*3600000000 + k*250000 + (CASE WHEN k >= 30 THEN 5000000 ELSE 0 END)) AS ts,
    CASE WHEN slot < 5 THEN 'person' WHEN slot = 5 THEN 'car'
         WHEN slot = 6 AND scene % 5 = 4 THEN 'bicycle' WHEN slot = 6 THEN 'truck'
         WHEN scene % 2 = 0 THEN 'object' ELSE 'backpack' END AS object_type,
    CAST(30 + u % 70 AS DOUBLE) / 100 AS confidence,
    CAST(x1i AS DOUBLE) AS x1, CAST(y1i AS DOUBLE) AS y1,
    CAST(x1i + wi AS DOUBLE) AS x2, CAST(y1i + hi AS DOUBLE) AS y2,
    CAST(CASE WHEN slot = 7 AND et = 'error' THEN NULL ELSE slot + 1 END AS BIGINT) AS track_id,
    CAST(u % 121 - 60 AS DOUBLE) AS vx, CAST((n*7) % 121 - 60 AS DOUBLE) AS vy,
    {EPOCH} + scene*3600000000 + k*250000 + (CASE WHEN k >= 30 THEN 5000000 ELSE 0 END) AS us
  FROM det_c)"""

VEV = f"""
vev_a AS (
  SELECT event_id, {EPOCH} + ((epoch_us(ts) - {EPOCH}) // 100) AS us, user_id, event_type AS et, value
  FROM events),
vev AS (
  SELECT event_id, 'CH-0' || (user_id % 4) AS video_id, 'CH-0' || (user_id % 4) AS camera_id,
    CASE et WHEN 'click' THEN 'PERSON_DETECTED' WHEN 'view' THEN 'CAR_DETECTED'
            WHEN 'purchase' THEN 'TRUCK_DETECTED' WHEN 'signup' THEN 'MOTION'
            ELSE 'BACKPACK_DETECTED' END AS event_type,
    make_timestamp(us) AS start_time,
    make_timestamp(us + CAST(floor(value / 10) AS BIGINT) * 1000000) AS end_time,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(user_id % 100 AS DOUBLE) / 100 END AS confidence,
    user_id AS track_id,
    CASE et WHEN 'click' THEN 'person' WHEN 'view' THEN 'car' WHEN 'purchase' THEN 'truck'
            WHEN 'signup' THEN NULL ELSE 'backpack' END AS object_type,
    user_id % 10 AS case_id,
    us AS s_us, us + CAST(floor(value / 10) AS BIGINT) * 1000000 AS e_us
  FROM vev_a)"""

CASES = """
cases AS (
  SELECT c_custkey AS case_id, c_name AS name, c_mktsegment AS investigator,
    'CASE-' || c_custkey AS case_number,
    CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'open' END AS status, c_nationkey AS owner_id
  FROM customer)"""

EVIDENCE = """
evidence AS (
  SELECT o_orderkey AS evidence_id, o_custkey AS case_id, o_orderpriority AS vendor,
    o_orderdate AS acquired_at,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS sha256
  FROM orders)"""

RECORDINGS = """
recordings AS (
  SELECT l_orderkey AS evidence_id, l_linenumber AS recording_identifier, l_partkey AS version,
    'CH-0' || (l_suppkey % 8) AS camera_id, l_shipdate AS original_timestamp,
    l_quantity AS duration_seconds, l_extendedprice AS file_size,
    CASE l_returnflag WHEN 'N' THEN 'ORIGINAL' WHEN 'A' THEN 'PARTIAL' ELSE 'RECOVERED' END AS recovery_status
  FROM lineitem)"""

FRAMES = """
fr_a AS (SELECT event_id // 8 AS frame_number, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1),
frames AS (
  SELECT 'vid-' || (frame_number // 50) AS video_id, frame_number, frame_number % 50 AS k,
    CAST((frame_number % 50)*250 + (CASE WHEN frame_number % 50 >= 30 THEN 5000 ELSE 0 END) AS DOUBLE) / 1000 AS pts,
    CAST(4 AS DOUBLE) AS nominal_fps, CASE WHEN frame_number % 50 = 45 THEN 1280 ELSE 1920 END AS width,
    1080 AS height, hi AS mean_luma, hi - lo AS std_luma
  FROM fr_a)"""

SIGNATURES = """
sigs AS (SELECT 'vid-' || label AS video_id, vec_id AS frame_number, embedding AS signature FROM embeddings)"""

BLOBS = """
blobs AS (SELECT page_id AS evidence_id, url AS path, html AS content FROM pages)"""

PACKED = """
pk_a AS (
  SELECT event_id // 500 AS evidence_id, event_id % 500 AS idx, user_id % 16 AS channel, event_type,
    CAST(floor(value) AS BIGINT) + 32 AS length, ts AS t, user_id FROM events),
packed AS (
  SELECT evidence_id, idx*8192 + 2000000 * (idx // (20 + evidence_id % 7)) AS "offset", channel,
    CASE event_type WHEN 'click' THEN 240 WHEN 'view' THEN 253 WHEN 'purchase' THEN 241 ELSE 252 END AS frame_type,
    length,
    CASE WHEN user_id % 11 = 0 THEN 0 ELSE
      (year(t) - 2000) * 67108864 + month(t) * 4194304 + day(t) * 131072
      + hour(t) * 4096 + minute(t) * 64 + second(t) END AS date_raw
  FROM pk_a)"""

INDEX = """
idx_entries AS (
  SELECT l_orderkey % 64 AS evidence_id, l_linenumber AS channel,
    (l_partkey % 512) * 1048576 AS offset_datablock FROM lineitem)"""


def sq_box_terms(a: str, b: str) -> tuple[str, str]:
    inter = (
        f"(greatest(0.0::DOUBLE, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))"
        f"*greatest(0.0::DOUBLE, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    )
    areas = (
        f"(greatest(0.0::DOUBLE,{a}.x2-{a}.x1)*greatest(0.0::DOUBLE,{a}.y2-{a}.y1)"
        f"+greatest(0.0::DOUBLE,{b}.x2-{b}.x1)*greatest(0.0::DOUBLE,{b}.y2-{b}.y1))"
    )
    return inter, areas


def sq_iou(a: str, b: str) -> str:
    inter, areas = sq_box_terms(a, b)
    return f"(CASE WHEN {areas}-{inter} > 0 THEN {inter}/({areas}-{inter}) ELSE 0.0::DOUBLE END)"


def sq_edge(a: str, b: str) -> str:
    dx = f"greatest(0.0::DOUBLE, greatest({a}.x1,{b}.x1)-least({a}.x2,{b}.x2))"
    dy = f"greatest(0.0::DOUBLE, greatest({a}.y1,{b}.y1)-least({a}.y2,{b}.y2))"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def sq_cx(a: str) -> str:
    return f"(({a}.x1+{a}.x2)/2)"


def sq_cy(a: str) -> str:
    return f"(({a}.y1+{a}.y2)/2)"


def sq_dist(a: str, b: str) -> str:
    dx, dy = f"({sq_cx(a)}-{sq_cx(b)})", f"({sq_cy(a)}-{sq_cy(b)})"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def sq_contain(a: str, b: str) -> str:
    inter, _ = sq_box_terms(a, b)
    return f"({inter}/greatest(1.0::DOUBLE,({a}.x2-{a}.x1)*({a}.y2-{a}.y1)))"


def sq_inside(a: str, b: str) -> str:
    return f"({a}.x1>={b}.x1 AND {a}.y1>={b}.y1 AND {a}.x2<={b}.x2 AND {a}.y2<={b}.y2)"


def sq_heading(vx: str, vy: str) -> str:
    ang = f"(CASE WHEN degrees(atan2({vy},{vx})) < 0 THEN degrees(atan2({vy},{vx}))+360 ELSE degrees(atan2({vy},{vx})) END)"
    return (
        f"(CASE WHEN sqrt({vx}*{vx}+{vy}*{vy}) < 5 THEN 'Stationary' "
        f"WHEN {ang} >= 337.5 OR {ang} < 22.5 THEN 'Eastbound (→)' "
        f"WHEN {ang} < 67.5 THEN 'South-East (↘)' WHEN {ang} < 112.5 THEN 'Southbound (↓)' "
        f"WHEN {ang} < 157.5 THEN 'South-West (↙)' WHEN {ang} < 202.5 THEN 'Westbound (←)' "
        f"WHEN {ang} < 247.5 THEN 'North-West (↖)' WHEN {ang} < 292.5 THEN 'Northbound (↑)' "
        f"ELSE 'North-East (↗)' END)"
    )


def sq_clamp(c: str) -> str:
    return f"round(least(0.97::DOUBLE, greatest(0.30::DOUBLE, {c})), 3)"
