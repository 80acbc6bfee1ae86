"""Sources with explicit schemas: raw images, probe JSON, detection JSON, relational tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argusframe.functions import scalars as S

PROBE_SCHEMA = """
format STRUCT<format_name: STRING, duration: STRING, size: STRING, tags: MAP<STRING, STRING>>,
streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT,
  pix_fmt: STRING, avg_frame_rate: STRING, r_frame_rate: STRING, nb_frames: STRING,
  start_time: STRING, tags: MAP<STRING, STRING>>>
"""

DETECTION_SCHEMA = """
timestamp_seconds DOUBLE, bbox ARRAY<DOUBLE>, frame_number BIGINT, class_name STRING,
confidence DOUBLE, track_id BIGINT
"""

TABLE_SCHEMAS = {
    "cases": "case_id BIGINT, name STRING, investigator STRING, case_number STRING, "
    "description STRING, status STRING, owner_id STRING, created_at TIMESTAMP",
    "evidence": "evidence_id BIGINT, case_id BIGINT, filename STRING, sha256 STRING, md5 STRING, "
    "status STRING, acquired_at TIMESTAMP, vendor STRING, detection_confidence DOUBLE, "
    "detection_info MAP<STRING, STRING>, parse_warnings ARRAY<STRING>, parse_errors ARRAY<STRING>",
    "devices": "evidence_id BIGINT, vendor STRING, model STRING, serial_number STRING, "
    "firmware_version STRING, raw_metadata MAP<STRING, STRING>",
    "recordings": "evidence_id BIGINT, recording_identifier STRING, camera_id STRING, "
    "source_path STRING, extracted_path STRING, original_timestamp TIMESTAMP, "
    "normalized_timestamp TIMESTAMP, duration_seconds DOUBLE, resolution STRING, fps DOUBLE, "
    "codec STRING, file_size BIGINT, recovery_status STRING, raw_metadata MAP<STRING, STRING>",
    "events": "evidence_id BIGINT, recording_id BIGINT, case_id BIGINT, camera_id STRING, "
    "event_type STRING, start_time TIMESTAMP, end_time TIMESTAMP, confidence DOUBLE, "
    "track_id STRING, object_type STRING, raw_metadata MAP<STRING, STRING>",
}


def relational(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the case tables from Parquet, with its declared schema."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)


def relational_jdbc(
    spark: SparkSession,
    url: str,
    name: str,
    key: str,
    bounds: tuple[int, int],
    partitions: int,
    **options: str,
) -> DataFrame:
    """One of the case tables over JDBC, read in parallel by ranges of a numeric key."""
    lo, hi = bounds
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=name,
            partitionColumn=key,
            lowerBound=str(lo),
            upperBound=str(hi),
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def _typed_detections(rows: DataFrame, keep: list[str], start: Column) -> DataFrame:
    """Typed detections from parsed objects in `_d`, relative seconds made absolute."""
    return rows.select(
        *keep,
        "_d.frame_number",
        F.col("_d.class_name").alias("object_type"),
        "_d.track_id",
        "_d.confidence",
        *(F.get("_d.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))),
        S.plus_seconds(start, F.greatest(F.lit(0.0), F.col("_d.timestamp_seconds"))).alias("ts"),
    )


def detections_from_json(rows: DataFrame, column: str, start: Column) -> DataFrame:
    """Typed detections from one JSON object per row."""
    parsed = rows.withColumn("_d", F.from_json(F.col(column), DETECTION_SCHEMA))
    return _typed_detections(parsed, [c for c in rows.columns if c != column], start)


def detection_files(
    spark: SparkSession, path: str, start: Column, layout: str = "lines"
) -> DataFrame:
    """Detections from JSON files; layout: `lines` (an object per line) or `list` (one array)."""
    if layout not in ("lines", "list"):
        raise ValueError(f"layout is lines or list, not {layout}")
    raw = spark.read.schema(DETECTION_SCHEMA).option("multiLine", layout == "list").json(path)
    return _typed_detections(raw.select(F.struct("*").alias("_d")), [], start)


def probe_rows(rows: DataFrame, column: str) -> DataFrame:
    """Container metadata: first video stream, any audio, frame rate, nullable casts."""
    p = rows.withColumn("_p", F.from_json(F.col(column), PROBE_SCHEMA)).withColumn(
        "_v", F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    )
    rate = S.parse_rate(
        F.coalesce(F.nullif("_v.avg_frame_rate", F.lit("")), F.col("_v.r_frame_rate"))
    )
    keep = [c for c in rows.columns if c != column]
    return p.where(F.col("_v").isNotNull()).select(
        *keep,
        F.col("_p.format.format_name").alias("format_name"),
        F.col("_p.format.duration").try_cast("double").alias("duration_seconds"),
        F.col("_v.width").alias("width"),
        F.col("_v.height").alias("height"),
        rate.alias("fps"),
        F.col("_v.nb_frames").try_cast("bigint").alias("frame_count"),
        F.col("_v.codec_name").alias("codec"),
        F.col("_v.pix_fmt").alias("pixel_format"),
        F.col("_v.start_time").try_cast("double").alias("start_time_seconds"),
        F.exists("_p.streams", lambda s: s["codec_type"] == "audio").alias("has_audio"),
    )


CHUNK_SCHEMA = "path STRING, size BIGINT, base_offset BIGINT, bytes BINARY"


def chunk_ranges(files: DataFrame, chunk: int) -> DataFrame:
    """(path, base_offset) of every chunk of every image; no bytes move here."""
    return files.select(
        "path",
        "size",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - 1), F.lit(chunk))).alias(
            "base_offset"
        ),
    )


def image_chunks(
    spark: SparkSession, path: str, chunk: int = 64 << 20, overlap: int = 64 << 10, glob: str = "*"
) -> DataFrame:
    """Overlapping chunks of raw images, read where they are needed.

    File listing carries no content, the chunk ranges are spread over tasks, and each task
    opens the image and reads only its ranges, so an image of any size is read in parallel
    and never held whole. Paths must be reachable by every executor.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", F.col("length").alias("size"))
    )
    ranges = chunk_ranges(listing, chunk)
    spread = ranges.repartition("path", "base_offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                uri = row["path"].replace("file:///", "/").replace("file:/", "/")
                if "://" in uri:
                    source, name = fs.FileSystem.from_uri(uri)
                else:
                    source, name = fs.LocalFileSystem(), uri
                with source.open_input_file(name) as f:
                    f.seek(row["base_offset"])
                    data = f.read(chunk + overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"]]),
                        pa.array([row["size"]], pa.int64()),
                        pa.array([row["base_offset"]], pa.int64()),
                        pa.array([data], pa.binary()),
                    ],
                    names=["path", "size", "base_offset", "bytes"],
                )

    return spread.mapInArrow(read, CHUNK_SCHEMA)


def text_chunks(rows: DataFrame, column: str, chunk: int, overlap: int) -> DataFrame:
    """The same cutting for content already held in a column."""
    return rows.select(
        "evidence_id",
        F.length(column).cast("bigint").alias("size"),
        column,
        F.explode(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(column) - 1), F.lit(chunk))
        ).alias("base_offset"),
    ).select(
        "evidence_id",
        "size",
        F.col("base_offset").cast("bigint").alias("base_offset"),
        F.substring(F.col(column), F.col("base_offset") + 1, F.lit(chunk + overlap)).alias("bytes"),
    )


def byte_slice(content: Column, offset: int, size: int) -> Column:
    """Bounds-checked read: fewer or no bytes beyond the end."""
    return F.substring(content, offset + 1, size)
