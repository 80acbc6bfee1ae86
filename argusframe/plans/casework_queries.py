"""Cases, evidence, recordings and their status."""

from pyspark.sql import functions as F

from argusframe.checks.views import BLOBS, CASES, DET, EVIDENCE, RECORDINGS, VEV
from argusframe.functions import scalars as S
from argusframe.operators import casework as C
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X


@query("visible_cases", f"WITH {CASES} SELECT * FROM cases WHERE owner_id=7")
def visible_cases(spark, sf):
    return C.visible_cases(X.cases(spark, sf), 7)


@query(
    "text_filter",
    f"""WITH {CASES} SELECT * FROM cases WHERE contains(lower(name),'build') OR contains(lower(case_number),'build')
    OR contains(lower(investigator),'build')""",
)
def text_filter(spark, sf):
    return C.text_filter(X.cases(spark, sf), ["name", "case_number", "investigator"], "BuilD")


@query("cases_recent", f"WITH {EVIDENCE} SELECT * FROM evidence ORDER BY acquired_at DESC, evidence_id DESC")
def cases_recent(spark, sf):
    return C.newest_first(X.evidence(spark, sf), "acquired_at", "evidence_id")


@query(
    "evidence_per_case",
    f"""WITH {CASES}, {EVIDENCE} SELECT c.case_id, c.name, count(e.evidence_id) AS evidence_count
    FROM cases c LEFT JOIN evidence e ON c.case_id=e.case_id GROUP BY 1,2""",
)
def evidence_per_case(spark, sf):
    return C.evidence_per_case(X.cases(spark, sf), X.evidence(spark, sf))


@query(
    "overview_stats",
    f"""WITH {CASES}, {EVIDENCE}, {VEV}, mine AS (SELECT * FROM cases WHERE owner_id < 12),
    s AS (SELECT (SELECT count(*) FROM mine) AS total_cases, (SELECT count(*) FROM mine WHERE status<>'closed') AS active_cases,
      (SELECT count(*) FROM evidence WHERE case_id IN (SELECT case_id FROM mine)) AS total_evidence,
      (SELECT count(sha256) FROM evidence WHERE case_id IN (SELECT case_id FROM mine)) AS hashed,
      (SELECT count(*) FROM vev WHERE case_id IN (SELECT case_id FROM mine)) AS total_events,
      (SELECT count(DISTINCT object_type) FROM vev WHERE case_id IN (SELECT case_id FROM mine)) AS tracked_entities_count)
    SELECT total_cases, active_cases, total_evidence, total_events, tracked_entities_count,
      CASE WHEN total_evidence>0 THEN round_even(hashed/total_evidence*100, 0) END AS integrity_score,
      CASE WHEN total_evidence=0 THEN 'NONE' WHEN round_even(hashed/total_evidence*100, 0)>=90 THEN 'PASS' ELSE 'VERIFIED' END AS integrity_status
    FROM s""",
    "integrity_score",
)
def overview_stats(spark, sf):
    mine = X.cases(spark, sf).where("owner_id < 12")
    return C.overview_stats(mine, X.evidence(spark, sf), X.video_events(spark, sf))


@query(
    "evidence_nested",
    f"""WITH {CASES}, {EVIDENCE}, {RECORDINGS}, n AS (SELECT evidence_id, count(*) AS rc FROM recordings GROUP BY 1)
    SELECT e.evidence_id, c.case_id, c.name AS case_name, e.vendor, e.acquired_at, r.recording_identifier, r.version, r.camera_id,
      r.original_timestamp, r.duration_seconds, r.file_size, r.recovery_status, coalesce(n.rc,0) AS recording_count
    FROM cases c LEFT JOIN evidence e ON c.case_id=e.case_id LEFT JOIN recordings r ON r.evidence_id=e.evidence_id
    LEFT JOIN n ON n.evidence_id=e.evidence_id""",
    "duration_seconds file_size",
)
def evidence_nested(spark, sf):
    return C.evidence_tree(X.cases(spark, sf), X.evidence(spark, sf), X.recordings(spark, sf))


@query(
    "analyzable_recordings",
    f"""WITH {RECORDINGS}, r AS (SELECT evidence_id, recording_identifier,
      CASE WHEN duration_seconds<5 THEN NULL ELSE original_timestamp END AS st,
      CASE WHEN version%3=0 THEN NULL ELSE '/extracted/' || version END AS ex,
      CASE WHEN version%7=0 THEN NULL ELSE '/images/' || evidence_id END AS src,
      CASE WHEN version%2=0 THEN 'generic' ELSE 'hikvision' END AS vendor FROM recordings)
    SELECT evidence_id, recording_identifier, st AS video_start, coalesce(ex, src) AS target_path,
      CASE WHEN st IS NULL THEN 'no timestamp available' WHEN coalesce(ex,src) IS NULL THEN 'video file not found'
        WHEN ex IS NULL AND vendor<>'generic' THEN vendor || ' raw image has not been extracted yet' END AS reason FROM r""",
)
def analyzable_recordings(spark, sf):
    rec = X.recordings(spark, sf).selectExpr(
        "evidence_id",
        "recording_identifier",
        "CAST(NULL AS TIMESTAMP) AS normalized_timestamp",
        "CASE WHEN duration_seconds < 5 THEN NULL ELSE original_timestamp END AS original_timestamp",
        "CASE WHEN version % 3 = 0 THEN NULL ELSE concat('/extracted/', CAST(version AS STRING)) END AS extracted_path",
        "CASE WHEN version % 7 = 0 THEN NULL ELSE concat('/images/', CAST(evidence_id AS STRING)) END AS source_path",
        "CASE WHEN version % 2 = 0 THEN 'generic' ELSE 'hikvision' END AS vendor",
    )
    return C.analyzable_recordings(rec)


@query(
    "upsert_recordings",
    f"""WITH {RECORDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY evidence_id, recording_identifier
      ORDER BY version DESC, camera_id DESC, duration_seconds DESC, file_size DESC) AS rn FROM recordings)
    SELECT * EXCLUDE (rn) FROM r WHERE rn=1""",
    "duration_seconds file_size",
)
def upsert_recordings(spark, sf):
    rec = X.recordings(spark, sf)
    base, delta = rec.where("version % 2 = 0"), rec.where("version % 2 = 1")
    order = ["version", "camera_id", "duration_seconds", "file_size"]
    return C.latest_by_key(base, delta, ["evidence_id", "recording_identifier"], order)


@query(
    "persist_events",
    f"""WITH {VEV}, {EVIDENCE} SELECT e.evidence_id, d.case_id, camera_id, event_type, start_time, end_time, confidence,
    CAST(track_id AS VARCHAR) AS track_id, object_type
    FROM (SELECT *, event_id % 5000 AS evidence_id FROM vev) e JOIN evidence d ON e.evidence_id=d.evidence_id""",
    "confidence",
)
def persist_events(spark, sf):
    ev = X.video_events(spark, sf).withColumn("evidence_id", F.pmod("event_id", F.lit(5000))).drop("case_id")
    return C.stored_events(ev, X.evidence(spark, sf))


@query(
    "hash_manifest",
    f"""WITH {BLOBS} SELECT evidence_id, octet_length(encode(content)) AS size_bytes, sha256(content) AS sha256, md5(content) AS md5,
    'hashed' AS status FROM blobs""",
)
def hash_manifest(spark, sf):
    return C.hash_manifest(X.blobs(spark, sf))


@query(
    "verify_manifest",
    f"""WITH {BLOBS} SELECT evidence_id, CASE WHEN evidence_id%9=0 THEN 'tampered' ELSE 'verified' END AS status FROM blobs""",
)
def verify_manifest(spark, sf):
    blobs = X.blobs(spark, sf)
    recorded = C.hash_manifest(blobs)
    touched = blobs.withColumn(
        "content", F.when(F.col("evidence_id") % 9 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    )
    return C.verify_manifest(C.hash_manifest(touched), recorded)


@query(
    "json_safe",
    f"""WITH {EVIDENCE} SELECT evidence_id, '{{"evidence_id":' || evidence_id || ',"vendor":"' || vendor || '","acquired_at":"'
    || strftime(acquired_at,'%Y-%m-%dT%H:%M:%S') || '","raw":"' || lower(hex(encode(vendor))) || '"}}' AS payload FROM evidence""",
)
def json_safe(spark, sf):
    ev = X.evidence(spark, sf).withColumn("raw", F.encode("vendor", "UTF-8"))
    return C.json_safe(ev, ["evidence_id", "vendor", "acquired_at", "raw"], binary_as_hex=True).select(
        "evidence_id", "payload"
    )


@query(
    "clock_normalize",
    f"""WITH {VEV}, o AS (SELECT 'CH-0' || r_regionkey AS camera_id, r_regionkey*60.5::DOUBLE AS off FROM region WHERE r_regionkey<3)
    SELECT event_id, v.camera_id, make_timestamp(s_us + CAST(coalesce(off,0)*1000000 AS BIGINT)) AS start_time,
    make_timestamp(e_us + CAST(coalesce(off,0)*1000000 AS BIGINT)) AS end_time FROM vev v LEFT JOIN o ON v.camera_id=o.camera_id""",
)
def clock_normalize(spark, sf):
    offsets = X.table(spark, sf, "region").where("r_regionkey < 3").selectExpr(
        "concat('CH-0', CAST(r_regionkey AS STRING)) AS camera_id", "r_regionkey * 60.5D AS offset_seconds"
    )
    return C.clock_normalize(X.video_events(spark, sf), offsets)


@query(
    "abs_timestamp",
    f"""WITH {RECORDINGS} SELECT evidence_id, recording_identifier, version,
    make_timestamp(epoch_us(original_timestamp) + CAST(greatest(0, duration_seconds-10)*1000000 AS BIGINT)) AS at FROM recordings""",
)
def abs_timestamp(spark, sf):
    rec = X.recordings(spark, sf).withColumn("rel", F.col("duration_seconds") - 10.0)
    return rec.select(
        "evidence_id", "recording_identifier", "version",
        C.absolute_times(rec, "original_timestamp", "rel").alias("at"),
    )


@query(
    "human_size",
    f"""WITH {RECORDINGS}, s AS (SELECT evidence_id, recording_identifier, version, CAST(floor(file_size) AS BIGINT) * (1 + version % 5000) AS b FROM recordings)
    SELECT evidence_id, recording_identifier, version, CASE WHEN b>=1099511627776 THEN printf('%.1f TB', b/1099511627776)
      WHEN b>=1073741824 THEN printf('%.1f GB', b/1073741824) WHEN b>=1048576 THEN printf('%.1f MB', b/1048576)
      WHEN b>=1024 THEN printf('%.1f KB', b/1024) ELSE b || ' B' END AS size FROM s""",
)
def human_size(spark, sf):
    rec = X.recordings(spark, sf)
    size = F.floor("file_size").cast("bigint") * (1 + F.col("version") % 5000)
    return rec.select("evidence_id", "recording_identifier", "version", S.human_size(size).alias("size"))


@query(
    "load_detections",
    f"""WITH {DET} SELECT det_id, video_id, frame_number, object_type, track_id, confidence, x1, y1, x2, y2,
    make_timestamp(1704067200000000 + CAST((frame_number % 50) * 250000 AS BIGINT)) AS ts FROM det""",
    "confidence x1 y1 x2 y2",
)
def load_detections(spark, sf):
    from argusframe.sources import readers as R

    det = X.detections(spark, sf)
    as_json = det.select(
        "det_id",
        "video_id",
        F.to_json(
            F.struct(
                (F.pmod("frame_number", F.lit(50)) * 0.25).alias("timestamp_seconds"),
                F.array("x1", "y1", "x2", "y2").alias("bbox"),
                "frame_number",
                F.col("object_type").alias("class_name"),
                "confidence",
                "track_id",
            )
        ).alias("line"),
    )
    start = F.timestamp_micros(F.lit(X.EPOCH_US))
    return R.detections_from_json(as_json, "line", start).select(
        "det_id", "video_id", "frame_number", "object_type", "track_id", "confidence",
        "x1", "y1", "x2", "y2", "ts",
    )


PROBE = """
pr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem)"""


@query(
    "probe_rows",
    f"""WITH {PROBE} SELECT l_orderkey AS evidence_id, l_linenumber AS recording_identifier, l_partkey AS version, 'mov,mp4' AS format_name,
    l_quantity AS duration_seconds, 1920 AS width, 1080 AS height,
    CASE WHEN l_partkey%5=0 THEN NULL WHEN l_partkey%5=1 THEN 25.0 ELSE (24000+l_partkey%1000)/1001.0::DOUBLE END AS fps,
    CASE WHEN l_partkey%4=0 THEN NULL ELSE l_partkey%10000 END AS frame_count, 'h264' AS codec, l_returnflag='R' AS has_audio FROM pr""",
    "duration_seconds fps",
)
def probe_rows(spark, sf):
    from argusframe.sources import readers as R

    rec = X.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS evidence_id",
        "l_linenumber AS recording_identifier",
        "l_partkey AS version",
        """concat('{"format":{"format_name":"mov,mp4","duration":"', CAST(l_quantity AS STRING), '"},"streams":[',
           CASE WHEN l_returnflag = 'R' THEN '{"codec_type":"audio","codec_name":"aac"},' ELSE '' END,
           '{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"',
           CASE l_partkey % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '25' ELSE concat(CAST(24000 + l_partkey % 1000 AS STRING), '/1001') END,
           '","nb_frames":"', CASE WHEN l_partkey % 4 = 0 THEN 'N/A' ELSE CAST(l_partkey % 10000 AS STRING) END, '"}]}') AS probe""",
    )
    return R.probe_rows(rec, "probe").select(
        "evidence_id", "recording_identifier", "version", "format_name", "duration_seconds",
        "width", "height", "fps", "frame_count", "codec", "has_audio",
    )
