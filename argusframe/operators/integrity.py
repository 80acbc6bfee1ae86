"""Frame timing, duplicates, discontinuities and the two integrity roll-ups of a video.

Frames: video_id, frame_number, pts (seconds), nominal_fps, width, height, mean_luma, std_luma.
All look back uses time slices, so one very long video is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.functions import scalars as S
from argusframe.operators.slicing import islands, lag_in_slices, range_slice, value_at_rank

VIDEO = ["video_id"]
SLICE_FRAMES = 20_000


def _lag(frames: DataFrame, fields: list[str], slice_frames: int) -> DataFrame:
    return lag_in_slices(
        frames, VIDEO, ["frame_number"], fields, range_slice(F.col("frame_number"), slice_frames)
    )


def pts_gaps(
    frames: DataFrame, rule: str = "decoder", slice_frames: int = SLICE_FRAMES
) -> DataFrame:
    """Jumps between consecutive frame times.

    `decoder`: longer than 2.75 expected intervals. `report`: longer than max(2.5 intervals,
    0.15 s), or backwards by more than a millisecond.
    """
    expected = F.when(F.col("nominal_fps") > 0, 1.0 / F.col("nominal_fps"))
    lagged = _lag(frames, ["pts"], slice_frames).withColumn(
        "delta_s", F.col("pts") - F.col("prev.pts")
    )
    if rule == "decoder":
        kind = F.when(F.col("delta_s") > expected * 2.75, "gap")
    else:
        tolerance = F.coalesce(F.greatest(expected * 2.5, F.lit(0.150)), F.lit(0.150))
        kind = F.when(F.col("delta_s") < -0.001, "backwards").when(
            F.col("delta_s") > tolerance, "gap"
        )
    return lagged.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "video_id", "frame_number", "pts", "delta_s", "kind"
    )


def fps_samples(frames: DataFrame, slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """Instant frame rate of each frame that comes after its predecessor."""
    delta = F.col("pts") - F.col("prev.pts")
    return (
        _lag(frames, ["pts"], slice_frames)
        .where(delta > 0)
        .select("video_id", "frame_number", (1.0 / delta).alias("fps"))
    )


def fps_changes(frames: DataFrame, slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """Frames whose rate differs from the last one by more than 20 % and 5 fps."""
    samples = fps_samples(frames, slice_frames)
    lagged = _lag(samples, ["fps"], slice_frames)
    return lagged.where(
        F.abs(F.col("fps") - F.col("prev.fps")) > F.greatest(F.col("prev.fps") * 0.20, F.lit(5.0))
    ).select("video_id", "frame_number", "fps", F.col("prev.fps").alias("previous_fps"))


def fps_consistency(frames: DataFrame, slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """Median rate, outliers and verdict per video; the median is found by counting."""
    samples = fps_samples(frames, slice_frames)
    counts = samples.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("n"))
    middles = F.array_distinct(
        F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    )
    ranks = counts.select(*VIDEO, F.explode(middles).alias("rank"))
    median = (
        value_at_rank(samples, VIDEO, "fps", ranks, 0.05)
        .groupBy(*VIDEO)
        .agg(F.avg("value").alias("median_fps"))
    )
    off = F.abs(F.col("fps") - F.col("median_fps")) > F.greatest(
        F.lit(0.75), F.col("median_fps") * 0.15
    )
    return (
        samples.join(median, VIDEO)
        .groupBy(*VIDEO, "median_fps")
        .agg(F.count(F.lit(1)).alias("samples"), F.count_if(off).alias("outliers"))
        .withColumn(
            "consistent",
            F.col("outliers") <= F.greatest(F.lit(3), F.floor(F.col("samples") / 20)),
        )
    )


def resolution_changes(frames: DataFrame) -> DataFrame:
    """Number of distinct picture sizes and of changes between them."""
    return (
        frames.select("video_id", "width", "height")
        .distinct()
        .groupBy(*VIDEO)
        .agg(F.count(F.lit(1)).alias("resolutions"))
        .withColumn("changes", F.col("resolutions") - 1)
    )


def off_size_frames(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Frames that differ from the declared picture size."""
    return frames.where((F.col("width") != width) | (F.col("height") != height)).select(
        "video_id", "frame_number", "width", "height"
    )


def visual_jumps(
    frames: DataFrame,
    mean_jump: float = 70.0,
    std_jump: float = 35.0,
    slice_frames: int = SLICE_FRAMES,
) -> DataFrame:
    """Per video: brightness discontinuities and whether they are too many."""
    lagged = _lag(frames, ["mean_luma", "std_luma"], slice_frames)
    jump = (F.abs(F.col("mean_luma") - F.col("prev.mean_luma")) > mean_jump) & (
        F.abs(F.col("std_luma") - F.col("prev.std_luma")) > std_jump
    )
    return (
        lagged.groupBy(*VIDEO)
        .agg(
            F.count(F.lit(1)).alias("frames_checked"),
            F.count_if(F.coalesce(jump, F.lit(False))).alias("jumps"),
        )
        .withColumn(
            "consistent",
            F.col("jumps") <= F.greatest(F.lit(5), F.floor(F.col("frames_checked") * 0.08)),
        )
    )


def duplicate_runs(
    frames: DataFrame,
    fields: list[str],
    difference: Callable[[Column], Column],
    below: float = 1.0,
    min_run: int = 5,
    slice_frames: int = SLICE_FRAMES,
) -> DataFrame:
    """Runs of frames nearly equal to the one before; `difference(prev)` measures a pair."""
    marked = (
        _lag(frames, [*fields, "frame_number"], slice_frames)
        .withColumn("dup", F.coalesce(difference(F.col("prev")) < below, F.lit(False)))
        .select("video_id", "frame_number", "dup", F.col("prev.frame_number").alias("before"))
    )
    flagged = _lag(marked, ["dup"], slice_frames).where("dup")
    flagged = flagged.withColumn("opens", ~F.coalesce(F.col("prev.dup"), F.lit(False))).drop("prev")
    runs = islands(
        flagged,
        VIDEO,
        "frame_number",
        ["frame_number"],
        lambda prev: F.col("opens"),
        range_slice(F.col("frame_number"), slice_frames),
        {"first": F.min("before"), "last": F.max("frame_number"), "run": F.count(F.lit(1))},
        {"first": F.min("first"), "last": F.max("last"), "run": F.sum("run")},
    )
    return runs.where(F.col("run") >= min_run).select(
        "video_id",
        F.col("first").alias("start_frame"),
        F.col("last").alias("end_frame"),
        F.col("run").alias("duplicates"),
    )


def similar_signatures(
    signatures: DataFrame, every: int = 5, at_least: float = 0.995, slice_frames: int = SLICE_FRAMES
) -> DataFrame:
    """Sampled frames whose signature is nearly parallel to the sample before."""
    sampled = signatures.where(F.pmod("frame_number", F.lit(every)) == 0)
    return (
        _lag(sampled, ["signature"], slice_frames)
        .withColumn("similarity", S.cosine(F.col("signature"), F.col("prev.signature")))
        .where(F.col("similarity") >= at_least)
        .select("video_id", "frame_number", "similarity")
    )


def change_scores(
    signatures: DataFrame, delta: float = 25.0, slice_frames: int = SLICE_FRAMES
) -> DataFrame:
    """Share of signature cells that changed since the frame before."""
    return (
        _lag(signatures, ["signature"], slice_frames)
        .where(F.col("prev").isNotNull())
        .select(
            "video_id",
            "frame_number",
            S.changed_fraction(F.col("prev.signature"), F.col("signature"), delta).alias("score"),
        )
    )


CHECKS = [
    "timestamp_continuity",
    "frame_continuity",
    "fps_consistency",
    "duplicate_frames",
    "metadata_consistency",
    "resolution_consistency",
    "compression_consistency",
]


def _frame_facts(frames: DataFrame, slice_frames: int) -> DataFrame:
    """What both roll-ups need of a video's frames, from one look back."""
    expected = F.when(F.col("nominal_fps") > 0, 1.0 / F.col("nominal_fps"))
    delta = F.col("pts") - F.col("prev.pts")
    lagged = _lag(frames, ["pts", "mean_luma", "std_luma"], slice_frames)
    report = F.coalesce(F.greatest(expected * 2.5, F.lit(0.150)), F.lit(0.150))
    jump = (F.abs(F.col("mean_luma") - F.col("prev.mean_luma")) > 70.0) & (
        F.abs(F.col("std_luma") - F.col("prev.std_luma")) > 35.0
    )
    size = F.col("width") * 100_000 + F.col("height")
    return lagged.groupBy(*VIDEO).agg(
        F.count(F.lit(1)).alias("frames_checked"),
        F.count_if(F.coalesce(delta > report, F.lit(False))).alias("report_gaps"),
        F.count_if(F.coalesce(delta > expected * 2.75, F.lit(False))).alias("decoder_gaps"),
        F.count_if(F.coalesce(delta < -0.001, F.lit(False))).alias("backwards"),
        F.count_if(F.coalesce(jump, F.lit(False))).alias("visual_jumps"),
        F.count_if(F.col("mean_luma").isNull()).alias("corrupted_frames"),
        (F.max(size) == F.min(size)).alias("resolution_consistency"),
        ((F.min("width") > 0) & (F.min("height") > 0) & F.max("nominal_fps").isNotNull()).alias(
            "metadata_consistency"
        ),
    )


def _found_in(videos: DataFrame, findings: DataFrame, name: str) -> DataFrame:
    """Number of findings of each video, 0 where there are none."""
    counts = findings.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias(name))
    return videos.join(counts, VIDEO, "left").fillna({name: 0})


def decoder_checks(
    frames: DataFrame, signatures: DataFrame, slice_frames: int = SLICE_FRAMES
) -> DataFrame:
    """The seven checks of the percent score, one row per video.

    Gaps are longer than 2.75 intervals, duplicates are sampled signatures nearly parallel to the
    sample before, only undecoded frames break the frame continuity, and compression is not judged.
    """
    rate = fps_consistency(frames, slice_frames).select("video_id", "consistent")
    facts = _found_in(_frame_facts(frames, slice_frames), similar_signatures(signatures), "similar")
    return facts.join(rate, VIDEO, "left").select(
        "video_id",
        "frames_checked",
        F.col("decoder_gaps").alias("timestamp_gaps"),
        "corrupted_frames",
        (F.col("decoder_gaps") == 0).alias("timestamp_continuity"),
        (F.col("corrupted_frames") == 0).alias("frame_continuity"),
        F.coalesce("consistent", F.lit(True)).alias("fps_consistency"),
        (F.col("similar") == 0).alias("duplicate_frames"),
        "metadata_consistency",
        "resolution_consistency",
        F.lit(True).alias("compression_consistency"),
    )


def report_checks(
    frames: DataFrame,
    fields: list[str] | None = None,
    difference: Callable[[Column], Column] | None = None,
    slice_frames: int = SLICE_FRAMES,
) -> DataFrame:
    """The checks of the penalty score, one row per video.

    Gaps are longer than max(2.5 intervals, 0.15 s), the rate fails on any change between
    neighbours, and duplicates are runs of five or more; `difference(prev)` over `fields` compares
    a frame with the one before (mean brightness if not given).
    """
    fields = fields or ["mean_luma"]
    difference = difference or (lambda prev: F.abs(F.col("mean_luma") - prev["mean_luma"]))
    facts = _frame_facts(frames, slice_frames)
    facts = _found_in(facts, fps_changes(frames, slice_frames), "rate_changes")
    runs = duplicate_runs(frames, fields, difference, 1.0, 5, slice_frames)
    return _found_in(facts, runs, "runs").select(
        "video_id",
        "frames_checked",
        F.col("report_gaps").alias("timestamp_gaps"),
        "corrupted_frames",
        ((F.col("report_gaps") == 0) & (F.col("backwards") == 0)).alias("timestamp_continuity"),
        ((F.col("report_gaps") == 0) & (F.col("corrupted_frames") == 0)).alias("frame_continuity"),
        (F.col("rate_changes") == 0).alias("fps_consistency"),
        (F.col("runs") == 0).alias("duplicate_frames"),
        "metadata_consistency",
        "resolution_consistency",
        (
            F.col("visual_jumps")
            <= F.greatest(F.lit(5), F.floor(F.col("frames_checked") * 0.08))
        ).alias("compression_consistency"),
    )


def score_percent(checks: DataFrame) -> DataFrame:
    """Share of passed checks; a warning if any of them reports an anomaly (duplicates do not)."""
    passed = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in CHECKS), F.lit(0))
    quiet = reduce(
        lambda x, y: x & y,
        (F.coalesce(F.col(c), F.lit(False)) for c in CHECKS if c != "duplicate_frames"),
    )
    return checks.select(
        "video_id",
        F.round(passed / len(CHECKS) * 100.0, 1).alias("integrity_score"),
        F.when(quiet, "PASS").otherwise("WARNING").alias("overall_status"),
    )


def score_penalty(checks: DataFrame) -> DataFrame:
    """100 minus the penalties of failed checks, kept within 0..100."""
    # ---- Fixed values: points lost per finding ----
    lost = [
        (~F.col("timestamp_continuity"), 15),
        (~F.col("frame_continuity"), 15),
        (~F.col("fps_consistency"), 10),
        (~F.col("duplicate_frames"), 15),
        (F.col("corrupted_frames") > 0, 20),
        (F.col("timestamp_gaps") > 0, 15),
        (~F.col("metadata_consistency"), 10),
        (~F.col("resolution_consistency"), 10),
        (~F.col("compression_consistency"), 10),
    ]
    penalty = sum((F.when(c, p).otherwise(0) for c, p in lost), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty))
    return checks.withColumn("integrity_score", score).select(
        "video_id",
        "integrity_score",
        F.when(F.col("integrity_score") >= 90, "PASS")
        .when(F.col("integrity_score") >= 70, "REVIEW")
        .otherwise("ANOMALY")
        .alias("overall_status"),
    )
