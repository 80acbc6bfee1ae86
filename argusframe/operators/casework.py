"""Cases, evidence, recordings: reads, gates, statistics, upserts and integrity status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions import scalars as S


def visible_cases(cases: DataFrame, owner: int | str | None = None) -> DataFrame:
    """Cases of one owner, or all when no owner is given."""
    return cases if owner is None else cases.where(F.col("owner_id") == F.lit(owner))


def text_filter(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with the text in at least one column, ignoring case."""
    hits = [F.contains(F.lower(c), F.lit(text.lower())) for c in columns]
    return df.where(reduce(lambda x, y: x | y, (F.coalesce(h, F.lit(False)) for h in hits)))


def newest_first(df: DataFrame, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie))


def evidence_per_case(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    counts = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return cases.join(counts, "case_id", "left").select(
        "case_id", "name", F.coalesce("n", F.lit(0)).alias("evidence_count")
    )


def overview_stats(cases: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """One row of platform counts; the partial rows of three tables are summed, not joined."""
    case_ids = cases.select("case_id")
    zero = F.lit(0).cast("bigint")

    def row(df: DataFrame, **cols: Column) -> DataFrame:
        names = ("total_cases", "active_cases", "total_evidence", "hashed", "total_events", "tracked_entities_count")
        return df.agg(*(cols.get(n, F.max(zero)).alias(n) for n in names))

    one = F.count(F.lit(1))
    ev = events.join(case_ids, "case_id", "left_semi")
    parts = [
        row(cases, total_cases=one, active_cases=F.count_if(F.col("status") != "closed")),
        row(
            evidence.join(case_ids, "case_id", "left_semi"),
            total_evidence=one,
            hashed=F.count("sha256"),
        ),
        row(ev, total_events=one),
        row(
            ev.where(F.col("object_type").isNotNull()).select("object_type").distinct(),
            tracked_entities_count=one,
        ),
    ]
    total = reduce(DataFrame.unionByName, parts)
    summed = total.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in total.columns))
    score = F.when(
        F.col("total_evidence") > 0, F.bround(F.col("hashed") / F.col("total_evidence") * 100)
    )
    return summed.withColumn("integrity_score", score).select(
        "total_cases",
        "active_cases",
        "total_evidence",
        "total_events",
        "tracked_entities_count",
        "integrity_score",
        F.when(F.col("total_evidence") == 0, "NONE")
        .when(F.col("integrity_score") >= 90, "PASS")
        .otherwise("VERIFIED")
        .alias("integrity_status"),
    )


def evidence_tree(cases: DataFrame, evidence: DataFrame, recordings: DataFrame) -> DataFrame:
    """Case, evidence and recordings as rows, with the recording count of each evidence.

    Kept flat: an evidence item with very many recordings never becomes one array.
    """
    counts = recordings.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("recording_count"))
    return (
        cases.select("case_id", F.col("name").alias("case_name"))
        .join(evidence.select("case_id", "evidence_id", "vendor", "acquired_at"), "case_id", "left")
        .join(recordings, "evidence_id", "left")
        .join(counts, "evidence_id", "left")
        .withColumn("recording_count", F.coalesce("recording_count", F.lit(0)))
    )


def analyzable_recordings(recordings: DataFrame) -> DataFrame:
    """Recordings with the path and start to analyse, or the reason they cannot be."""
    start = F.coalesce("normalized_timestamp", "original_timestamp")
    path = F.coalesce("extracted_path", "source_path")
    reason = (
        F.when(start.isNull(), "no timestamp available")
        .when(path.isNull(), "video file not found")
        .when(
            F.col("extracted_path").isNull() & (F.col("vendor") != "generic"),
            F.concat(F.col("vendor"), F.lit(" raw image has not been extracted yet")),
        )
    )
    return recordings.select(
        "evidence_id",
        "recording_identifier",
        start.alias("video_start"),
        path.alias("target_path"),
        reason.alias("reason"),
    )


def latest_by_key(
    base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Idempotent upsert: per key the row with the highest `order` wins.

    Both sides carry the order columns; ties are not allowed. Re-applying a delta changes
    nothing. The one-row limit is applied before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return (
        base.unionByName(delta, allowMissingColumns=True)
        .withColumn("_rn", F.row_number().over(newest))
        .where("_rn = 1")
        .drop("_rn")
    )


def stored_events(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Events with the case of their evidence and a text track id, ready for the event table."""
    return events.join(evidence.select("evidence_id", "case_id"), "evidence_id", "inner").select(
        "evidence_id",
        "case_id",
        "camera_id",
        "event_type",
        "start_time",
        "end_time",
        "confidence",
        F.col("track_id").cast("string").alias("track_id"),
        "object_type",
    )


def append_events(rows: DataFrame, path: str) -> None:
    """Append to the event table, partitioned by case and clustered by start time."""
    rows.sortWithinPartitions("case_id", "start_time").write.mode("append").partitionBy(
        "case_id"
    ).parquet(path)


def hash_manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 and MD5 of each file's bytes."""
    raw = F.col(content).cast("binary")
    return files.select(
        "evidence_id",
        F.length(raw).cast("bigint").alias("size_bytes"),
        F.sha2(raw, 256).alias("sha256"),
        F.md5(raw).alias("md5"),
        F.lit("hashed").alias("status"),
    )


def verify_manifest(current: DataFrame, expected: DataFrame) -> DataFrame:
    """Status of each file against the recorded hash."""
    want = expected.select("evidence_id", F.col("sha256").alias("expected_sha256"))
    return current.join(want, "evidence_id", "inner").select(
        "evidence_id",
        F.when(F.col("sha256") == F.col("expected_sha256"), "verified")
        .otherwise("tampered")
        .alias("status"),
    )


def json_safe(df: DataFrame, columns: list[str], binary_as_hex: bool = False) -> DataFrame:
    """Columns as one JSON text: ISO times, bytes as lossy UTF-8 or as hex."""

    def enc(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        c = F.col(name)
        if kind == "binary":
            return F.lower(F.hex(c)) if binary_as_hex else S.utf8_lossy(c)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c

    return df.withColumn("payload", F.to_json(F.struct(*(enc(c).alias(c) for c in columns))))


def clock_normalize(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """Shift events by the clock offset of their camera; cameras without one keep their time."""
    shift = F.coalesce("offset_seconds", F.lit(0.0))
    return events.join(offsets, "camera_id", "left").select(
        "event_id",
        "camera_id",
        S.plus_seconds(F.col("start_time"), shift).alias("start_time"),
        S.plus_seconds(F.col("end_time"), shift).alias("end_time"),
    )


def absolute_times(rows: DataFrame, start: str, relative: str) -> Column:
    """Absolute time of a relative second count, never before the start."""
    return S.plus_seconds(F.col(start), F.greatest(F.lit(0.0), F.col(relative)))
