"""Deterministic evidence-shaped views over the benchmark tables.

Each function reads one or two parquet tables and projects them; there is no shuffle except
where a view needs one row per frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from argusframe.sources.session import prepare

EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame object detections: eight object slots per frame, fifty frames per video."""
    return detections_of(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def detections_of(events: DataFrame) -> DataFrame:
    """The detections view over a batch or streaming event table."""
    base = (
        events.selectExpr(
            "event_id AS n",
            "CAST(pmod(event_id, 8) AS INT) AS slot",
            "CAST(floor(event_id / 8) AS BIGINT) AS frame_number",
            "user_id AS u",
            "value AS v",
            "event_type AS et",
        )
        .selectExpr(
            "*",
            "CAST(floor(frame_number / 50) AS BIGINT) AS scene",
            "CAST(pmod(frame_number, 50) AS BIGINT) AS k",
        )
        .where("NOT (slot = 6 AND pmod(scene, 3) = 0 AND k >= 20)")
        .selectExpr(
            "*",
            """CASE WHEN slot < 5 THEN 100 + 45 * slot + pmod(u, 60)
                    + (CASE WHEN slot = 4 AND pmod(scene, 4) = 3 THEN 400 ELSE 0 END)
                    WHEN slot < 7 THEN 380 + (slot - 5) * 90 + pmod(u, 50)
                    ELSE (CASE WHEN k < 25 THEN 300 ELSE 310 END) END AS x1i""",
            """CASE WHEN slot < 5 THEN 100 + pmod(u, 20)
                    WHEN slot < 7 THEN 150 + pmod(u, 30) ELSE 140 END AS y1i""",
            """CASE WHEN slot < 5 THEN (CASE WHEN v > 150 THEN 160 ELSE 40 END)
                    WHEN slot < 7 THEN 80 + pmod(u, 5) * 20
                    ELSE (CASE WHEN k < 40 THEN 40 ELSE 20 END) END AS wi""",
            """CASE WHEN slot < 5 THEN 60 + pmod(u, 3) * 40
                    WHEN slot < 7 THEN 60 + pmod(u, 5) * 15
                    ELSE (CASE WHEN k < 40 THEN 40 ELSE 20 END) END AS hi""",
        )
    )
    return base.selectExpr(
        "n AS det_id",
        "concat('vid-', CAST(scene AS STRING)) AS video_id",
        "concat('CH-0', CAST(pmod(scene, 4) AS STRING)) AS camera_id",
        "frame_number",
        f"""timestamp_micros({EPOCH_US} + scene * 3600000000 + k * 250000
            + (CASE WHEN k >= 30 THEN 5000000 ELSE 0 END)) AS ts""",
        """CASE WHEN slot < 5 THEN 'person' WHEN slot = 5 THEN 'car'
            WHEN slot = 6 AND pmod(scene, 5) = 4 THEN 'bicycle' WHEN slot = 6 THEN 'truck'
            WHEN pmod(scene, 2) = 0 THEN 'object' ELSE 'backpack' END AS object_type""",
        "CAST(30 + pmod(u, 70) AS DOUBLE) / 100D AS confidence",
        "CAST(x1i AS DOUBLE) AS x1",
        "CAST(y1i AS DOUBLE) AS y1",
        "CAST(x1i + wi AS DOUBLE) AS x2",
        "CAST(y1i + hi AS DOUBLE) AS y2",
        "CAST(CASE WHEN slot = 7 AND et = 'error' THEN NULL ELSE slot + 1 END AS BIGINT) AS track_id",
        "CAST(pmod(u, 121) - 60 AS DOUBLE) AS vx",
        "CAST(pmod(n * 7, 121) - 60 AS DOUBLE) AS vy",
    )


def video_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval events of four cameras, a hundred times denser than the source clock."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id",
            "unix_micros(CAST(ts AS TIMESTAMP)) AS us",
            "user_id",
            "event_type AS et",
            "value",
        )
        .selectExpr(
            "event_id",
            "concat('CH-0', CAST(pmod(user_id, 4) AS STRING)) AS video_id",
            "concat('CH-0', CAST(pmod(user_id, 4) AS STRING)) AS camera_id",
            """CASE et WHEN 'click' THEN 'PERSON_DETECTED' WHEN 'view' THEN 'CAR_DETECTED'
                WHEN 'purchase' THEN 'TRUCK_DETECTED' WHEN 'signup' THEN 'MOTION'
                ELSE 'BACKPACK_DETECTED' END AS event_type""",
            f"timestamp_micros({EPOCH_US} + CAST(floor((us - {EPOCH_US}) / 100) AS BIGINT)) AS start_time",
            f"""timestamp_micros({EPOCH_US} + CAST(floor((us - {EPOCH_US}) / 100) AS BIGINT)
                + CAST(floor(value / 10) AS BIGINT) * 1000000) AS end_time""",
            """CASE WHEN pmod(event_id, 17) = 0 THEN NULL
                ELSE CAST(pmod(user_id, 100) AS DOUBLE) / 100D END AS confidence""",
            "user_id AS track_id",
            """CASE et WHEN 'click' THEN 'person' WHEN 'view' THEN 'car'
                WHEN 'purchase' THEN 'truck' WHEN 'signup' THEN NULL
                ELSE 'backpack' END AS object_type""",
            "pmod(user_id, 10) AS case_id",
        )
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS case_id",
        "c_name AS name",
        "c_mktsegment AS investigator",
        "concat('CASE-', CAST(c_custkey AS STRING)) AS case_number",
        "CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'open' END AS status",
        "c_nationkey AS owner_id",
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS evidence_id",
        "o_custkey AS case_id",
        "o_orderpriority AS vendor",
        "CAST(o_orderdate AS TIMESTAMP) AS acquired_at",
        "CASE WHEN pmod(o_orderkey, 5) = 0 THEN NULL ELSE sha2(CAST(o_orderkey AS STRING), 256) END AS sha256",
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS evidence_id",
        "l_linenumber AS recording_identifier",
        "l_partkey AS version",
        "concat('CH-0', CAST(pmod(l_suppkey, 8) AS STRING)) AS camera_id",
        "CAST(l_shipdate AS TIMESTAMP) AS original_timestamp",
        "l_quantity AS duration_seconds",
        "l_extendedprice AS file_size",
        """CASE l_returnflag WHEN 'N' THEN 'ORIGINAL' WHEN 'A' THEN 'PARTIAL'
            ELSE 'RECOVERED' END AS recovery_status""",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame with timing, size and brightness."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr("CAST(floor(event_id / 8) AS BIGINT) AS frame_number", "value")
        .groupBy("frame_number")
        .agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
        .selectExpr(
            "frame_number",
            "CAST(floor(frame_number / 50) AS BIGINT) AS scene",
            "CAST(pmod(frame_number, 50) AS BIGINT) AS k",
            "hi",
            "lo",
        )
        .selectExpr(
            "concat('vid-', CAST(scene AS STRING)) AS video_id",
            "frame_number",
            "k",
            "CAST(k * 250 + (CASE WHEN k >= 30 THEN 5000 ELSE 0 END) AS DOUBLE) / 1000D AS pts",
            "4.0D AS nominal_fps",
            "CASE WHEN k = 45 THEN 1280 ELSE 1920 END AS width",
            "1080 AS height",
            "hi AS mean_luma",
            "hi - lo AS std_luma",
        )
    )


def frame_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('vid-', CAST(label AS STRING)) AS video_id",
        "vec_id AS frame_number",
        "embedding AS signature",
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS evidence_id", "url AS path", "html AS content"
    )


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level frame headers of several evidence images."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "CAST(floor(event_id / 500) AS BIGINT) AS evidence_id",
            "CAST(pmod(event_id, 500) AS BIGINT) AS idx",
            "CAST(pmod(user_id, 16) AS BIGINT) AS channel",
            "event_type",
            "CAST(floor(value) AS BIGINT) + 32 AS length",
            "CAST(ts AS TIMESTAMP) AS t",
            "user_id",
        )
        .selectExpr(
            "evidence_id",
            "idx * 8192 + 2000000 * CAST(floor(idx / (20 + pmod(evidence_id, 7))) AS BIGINT) AS offset",
            "channel",
            """CASE event_type WHEN 'click' THEN 240 WHEN 'view' THEN 253
                WHEN 'purchase' THEN 241 ELSE 252 END AS frame_type""",
            "length",
            """CASE WHEN pmod(user_id, 11) = 0 THEN 0L ELSE
                CAST(year(t) - 2000 AS BIGINT) * 67108864 + month(t) * 4194304 + day(t) * 131072
                + hour(t) * 4096 + minute(t) * 64 + second(t) END AS date_raw""",
        )
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(pmod(l_orderkey, 64) AS BIGINT) AS evidence_id",
        "l_linenumber AS channel",
        "CAST(pmod(l_partkey, 512) AS BIGINT) * 1048576 AS offset_datablock",
    )
