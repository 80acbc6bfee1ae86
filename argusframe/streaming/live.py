"""Sessions, proximity, counts, tracks and an idempotent sink on Structured Streaming.

Rows later than the watermark are dropped by Spark and show up in the query progress
(`numRowsDroppedByWatermark`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from argusframe.functions import geometry as G
from argusframe.operators.casework import latest_by_key
from argusframe.operators.grid import near_box_pairs
from argusframe.operators.tracking import CentroidState
from argusframe.sources.session import checkpoint_dir

SCENE = ["video_id", "camera_id"]


def live_sessions(detections: DataFrame, gap_s: int = 3, delay: str = "10 seconds") -> DataFrame:
    """Gap sessions per camera, class and track; the extra microsecond makes the gap inclusive."""
    window = F.session_window("ts", f"{gap_s} seconds 1 microsecond")
    return (
        detections.withWatermark("ts", delay)
        .groupBy(window, *SCENE, "object_type", "track_id")
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.count(F.lit(1)).alias("detection_count"),
            F.max("confidence").alias("confidence"),
        )
        .drop("session_window")
    )


def live_counts(events: DataFrame, width: str = "1 minute", delay: str = "10 seconds") -> DataFrame:
    """Detections per camera, class and tumbling window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "camera_id", "object_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "camera_id", "object_type", "n")
    )


def live_proximity(
    left: DataFrame,
    right: DataFrame,
    iou_near: float = 0.05,
    iou_contact: float = 0.15,
    edge_near: float = 40.0,
    edge_contact: float = 15.0,
    delay: str = "10 seconds",
) -> DataFrame:
    """Contact and proximity flags from two readings of one stream.

    The join key holds the frame's time, so the watermark bounds the state, and the grid cell,
    so that only near boxes meet. A track appears once per frame.
    """
    cols = [*SCENE, "frame_number", "ts", "det_id", "track_id", "x1", "y1", "x2", "y2"]

    def side(df: DataFrame) -> DataFrame:
        return df.withWatermark("ts", delay).where("track_id IS NOT NULL").select(*cols)

    a, b = G.box("a_"), G.box("b_")
    pairs = near_box_pairs(side(left), side(right), [*SCENE, "frame_number", "ts"], max(edge_near, edge_contact) / 2)
    scored = (
        pairs.where((F.col("a_det_id") < F.col("b_det_id")) & (F.col("a_track_id") != F.col("b_track_id")))
        .withColumn("iou", G.iou(a, b))
        .withColumn("edge", G.edge_distance(a, b))
    )
    contact = (F.col("iou") >= iou_contact) | (F.col("edge") <= edge_contact)
    near = (F.col("iou") >= iou_near) | (F.col("edge") <= edge_near)
    return scored.where(contact | near).select(
        *SCENE,
        "frame_number",
        F.col("ts").alias("start_time"),
        F.when(contact, "REVIEW_FLAG_POSSIBLE_CONTACT")
        .otherwise("REVIEW_FLAG_PROXIMITY")
        .alias("event_type"),
        F.col("a_track_id").alias("track_a"),
        F.col("b_track_id").alias("track_b"),
    )


TRACKS = "video_id STRING, camera_id STRING, frame_number BIGINT, det_id BIGINT, track_id BIGINT, vx DOUBLE, vy DOUBLE"


def live_tracks(
    detections: DataFrame,
    fps: float = 2.0,
    max_misses: int = 6,
    idle_ms: int = 3_600_000,
    delay: str = "10 seconds",
) -> DataFrame:
    """Centroid tracks per camera; the state is the camera's open tracks and its clock.

    All rows of a frame arrive in one micro-batch. Frames older than the last one seen are
    dropped. A camera quiet for `idle_ms` of event time closes its tracks but keeps its numbering.
    """

    def load(text: str | None) -> tuple[CentroidState, int | None]:
        state = CentroidState(fps, max_misses)
        if not text:
            return state, None
        saved = json.loads(text)
        state.created = saved["created"]
        state.tracks = {
            int(t): {**v, "at": tuple(v["at"]), "v": tuple(v["v"]), "box": tuple(v["box"])}
            for t, v in saved["tracks"]
        }
        return state, saved["frame"]

    def dump(state: CentroidState, frame: int | None) -> str:
        return json.dumps(
            {"created": state.created, "frame": frame, "tracks": list(state.tracks.items())}
        )

    def step(
        key: tuple, parts: Iterator[pd.DataFrame], group: GroupState
    ) -> Iterator[pd.DataFrame]:
        state, last = load(group.get[0] if group.exists else None)
        if group.hasTimedOut:
            state.tracks = {}
            group.update((dump(state, last),))
            return
        rows = pd.concat(list(parts))
        order = np.lexsort((rows["det_id"].to_numpy(), rows["frame_number"].to_numpy()))
        # plain lists: a frame holds few rows, and a table for each would cost more than its tracks
        frames, ids, classes = (rows[c].to_numpy()[order].tolist() for c in ("frame_number", "det_id", "object_type"))
        boxes = [tuple(b) for b in rows[["x1", "y1", "x2", "y2"]].to_numpy()[order].tolist()]
        out, end = [], 0
        while end < len(frames):
            first, frame = end, frames[end]
            while end < len(frames) and frames[end] == frame:
                end += 1
            if last is not None:
                if frame <= last:
                    continue
                if frame - last > 1:
                    state.miss(frame - last - 1)
            dets = [{"box": boxes[i], "cls": classes[i]} for i in range(first, end)]
            for det_id, o in zip(ids[first:end], state.step(dets), strict=True):
                out.append((*key, frame, det_id, o["local_id"], o["vx"], o["vy"]))
            last = frame
        group.update((dump(state, last),))
        seen = int(rows["ts"].max().timestamp() * 1000)
        group.setTimeoutTimestamp(max(seen, group.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(
            out,
            columns=["video_id", "camera_id", "frame_number", "det_id", "track_id", "vx", "vy"],
        )

    return (
        detections.withWatermark("ts", delay)
        .groupBy(*SCENE)
        .applyInPandasWithState(
            step, TRACKS, "state STRING", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


# ---- sinks ----


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into Parquet files."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_sink(path: str):
    """`foreachBatch` function: each batch owns one delta folder and rewrites only that one.

    A batch that is run again replaces its own delta, so a replay leaves the table as it was.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table as of now: the newest row of each key over all deltas."""
    deltas = spark.read.parquet(path)
    return latest_by_key(deltas.limit(0), deltas, keys, [*order, "batch"]).drop("batch")


def compact_upserts(spark: SparkSession, path: str, out: str, keys: list[str], order: list[str]) -> None:
    """Write the merged table as the first delta of a new folder."""
    read_upserts(spark, path, keys, order).write.mode("overwrite").parquet(f"{out}/batch=0")


def run_upserts(stream: DataFrame, path: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(upsert_sink(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
