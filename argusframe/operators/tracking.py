"""Trackers: state over the frames of a camera, run on Spark in independent segments.

A tracker forgets every object after a gap long enough, so the frames of a camera (or of one
class of it) are cut at such gaps; the segments are spread over the cluster and each is
streamed frame by frame through a small state, never held whole. Identifiers are numbered
inside a segment and made global from the counts of the segments before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import hypot

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from argusframe.operators.slicing import island_rows, running_rank, sequence_key, time_slice
from argusframe.sources.session import materialize

SCENE = ["video_id", "camera_id"]
BOX = ["x1", "y1", "x2", "y2"]
VAGUE = ("object", "motion")


def box_iou(a, b, floor: float = 0.0) -> float:
    """Overlap of two boxes as plain numbers; `floor` is the least area of each."""
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    areas = sum(
        max(floor, (r[2] - r[0]) * (r[3] - r[1]))
        if floor
        else max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
        for r in (a, b)
    )
    union = areas - inter
    return inter / union if inter > 0 and union > 0 else 0.0


def middle(b) -> tuple[float, float]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


class CentroidState:
    """Open tracks of one camera: id -> position, box, class, misses, hits, velocity."""

    def __init__(self, fps=2.0, max_misses=6, reach=220.0, min_iou=0.15):
        self.dt = 1.0 / max(0.1, fps)
        self.max_misses, self.reach, self.min_iou = max_misses, max(reach, 220.0), min_iou
        self.tracks: dict[int, dict] = {}
        self.created = 0

    def miss(self, frames: int, but=()) -> None:
        """Let `frames` pictures pass without the tracks outside `but`."""
        for tid in [t for t in self.tracks if t not in but]:
            self.tracks[tid]["misses"] += frames
            if self.tracks[tid]["misses"] > self.max_misses:
                del self.tracks[tid]

    def _cost(self, det: dict, track: dict) -> float | None:
        x, y = middle(det["box"])
        (tx, ty), (vx, vy) = track["at"], track["v"]
        near = min(hypot(x - tx - vx * self.dt, y - ty - vy * self.dt), hypot(x - tx, y - ty))
        overlap = box_iou(det["box"], track["box"], 1.0)
        if near > self.reach and overlap <= self.min_iou:
            return None
        other = track["cls"] != det["cls"] and not {track["cls"], det["cls"]} & set(VAGUE)
        return near * (1.0 - 0.5 * overlap) + (50.0 if other else 0.0)

    def step(self, dets: list[dict]) -> list[dict]:
        """Assign the detections of one picture; the cheapest pairs are taken first."""
        options = [
            (cost, i, order, tid)
            for i, d in enumerate(dets)
            for order, (tid, t) in enumerate(self.tracks.items())
            if (cost := self._cost(d, t)) is not None
        ]
        options.sort(key=lambda o: (o[0], o[1], o[2]))
        taken: dict[int, int] = {}
        used: set[int] = set()
        out: list[dict | None] = [None] * len(dets)
        for _, i, _, tid in options:
            if i in taken or tid in used:
                continue
            taken[i] = tid
            used.add(tid)
            d, t = dets[i], self.tracks[tid]
            x, y = middle(d["box"])
            vx, vy = (x - t["at"][0]) / self.dt, (y - t["at"][1]) / self.dt
            if t["v"][0] or t["v"][1]:
                vx, vy = 0.75 * vx + 0.25 * t["v"][0], 0.75 * vy + 0.25 * t["v"][1]
            t.update(at=(x, y), box=d["box"], misses=0, hits=t["hits"] + 1, v=(vx, vy))
            if d["cls"] not in VAGUE:
                t["cls"] = d["cls"]
            out[i] = {"local_id": tid, "vx": vx, "vy": vy, "hits": t["hits"]}
        before = list(self.tracks)
        for i, d in enumerate(dets):
            if out[i] is None:
                self.created += 1
                self.tracks[self.created] = {
                    "at": middle(d["box"]), "box": d["box"], "cls": d["cls"],
                    "misses": 0, "hits": 1, "v": (0.0, 0.0),
                }
                out[i] = {"local_id": self.created, "vx": 0.0, "vy": 0.0, "hits": 1}
        self.miss(1, used | (set(self.tracks) - set(before)))
        return out


class EntityState:
    """Open entities of one class: the detector's own id first, then the best place."""

    def __init__(self, max_misses=3, min_iou=0.20, reach=180.0):
        self.max_misses, self.min_iou, self.reach = max_misses, min_iou, reach
        self.open: dict[int, dict] = {}
        self.created = 0

    def miss(self, frames: int, but=()) -> None:
        for e in [e for e in self.open if e not in but]:
            self.open[e]["misses"] += frames
            if self.open[e]["misses"] > self.max_misses:
                del self.open[e]

    def _score(self, box, entity) -> float | None:
        overlap = box_iou(box, entity["box"])
        away = hypot(*(p - q for p, q in zip(middle(box), middle(entity["box"]))))
        if overlap < self.min_iou and away > self.reach:
            return None
        return overlap * 0.65 + max(0.0, 1.0 - away / self.reach) * 0.35

    def step(self, dets: list[dict]) -> list[dict]:
        chosen: dict[int, int] = {}
        used: set[int] = set()
        for i, d in enumerate(dets):
            if d["track"] is None:
                continue
            same = [e for e, v in self.open.items() if e not in used and v["track"] == d["track"]]
            if same:
                chosen[i] = same[0]
                used.add(same[0])
        for i, d in enumerate(dets):
            if i in chosen:
                continue
            best, top = None, -1.0
            for e, v in self.open.items():
                score = None if e in used else self._score(d["box"], v)
                if score is not None and score > top:
                    best, top = e, score
            if best is not None:
                chosen[i] = best
                used.add(best)
        self.miss(1, used)
        out = []
        for i, d in enumerate(dets):
            e = chosen.get(i)
            if e is None:
                self.created += 1
                e = self.created
                self.open[e] = {"conf": d["conf"]}
            self.open[e].update(
                box=d["box"], track=d["track"], misses=0, conf=max(self.open[e]["conf"], d["conf"])
            )
            out.append({"local_id": e, "entity_confidence": self.open[e]["conf"]})
        return out


class LabelState:
    """Tracks of one label: best overlap within a few frames; a track may match twice."""

    def __init__(self, min_iou=0.30, max_gap=6):
        self.min_iou, self.max_gap = min_iou, max_gap
        self.open: dict[int, tuple] = {}
        self.created = 0
        self.clock = 0

    def miss(self, frames: int, but=()) -> None:
        self.clock += frames
        self.open = {t: v for t, v in self.open.items() if self.clock + 1 - v[1] <= self.max_gap}

    def step(self, dets: list[dict]) -> list[dict]:
        self.clock += 1
        out = []
        for d in dets:
            best, top = None, 0.0
            for t, (box, at) in self.open.items():
                overlap = box_iou(d["box"], box) if self.clock - at <= self.max_gap else 0.0
                if overlap > top:
                    best, top = t, overlap
            if best is None or top < self.min_iou:
                self.created += 1
                best = self.created
            self.open[best] = (d["box"], self.clock)
            out.append({"local_id": best})
        return out


def _segments(rows: DataFrame, keys: list[str], max_gap: int, step: int, slice_s: float) -> DataFrame:
    """Rows labelled by runs of frames no more than `max_gap` sampled frames apart."""
    keyed = rows.withColumn("seq", sequence_key(F.col("ts"), F.col("det_id")))
    return island_rows(
        keyed,
        keys,
        "seq",
        ["frame_number"],
        lambda prev: (F.col("frame_number") - prev["frame_number"]) > max_gap * step,
        time_slice(F.col("ts"), slice_s),
        "segment",
    )


def _run(
    rows: DataFrame,
    keys: list[str],
    make: Callable[[], object],
    extra: dict[str, str],
    step: int,
) -> DataFrame:
    """Stream every segment through a fresh state, frame by frame.

    Rows arrive sorted by key and frame; the rows of the current frame are the only ones held.
    """
    names = [*extra]
    group = [*keys, "segment"]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, frame, state, held = None, None, None, []

        def flush() -> list[tuple]:
            dets = [
                {
                    "box": (r.x1, r.y1, r.x2, r.y2),
                    "cls": r.object_type,
                    "conf": r.confidence,
                    "track": None if pd.isna(r.track_id) else int(r.track_id),
                }
                for r in held
            ]
            return [
                (r.det_id, *(o[n] for n in names)) for r, o in zip(held, state.step(dets))
            ]

        for pdf in parts:
            done: list[tuple] = []
            for r in pdf.itertuples(index=False):
                key = tuple(getattr(r, k) for k in group)
                if key != current or r.frame_number != frame:
                    if held:
                        done += flush()
                        held = []
                    if key != current:
                        state = make()
                    else:
                        idle = (r.frame_number - frame) // step - 1
                        if idle > 0:
                            state.miss(idle)
                    current, frame = key, r.frame_number
                held.append(r)
            yield pd.DataFrame(done, columns=["det_id", *names])
        if held:
            yield pd.DataFrame(flush(), columns=["det_id", *names])

    ordered = rows.repartition(*group).sortWithinPartitions(*group, "frame_number", "det_id")
    types = ", ".join(f"{n} {t}" for n, t in extra.items())
    cols = [*dict.fromkeys([*group, "frame_number", "det_id", "object_type", "confidence", "track_id", *BOX])]
    return ordered.select(*cols).mapInPandas(walk, f"det_id BIGINT, {types}")


def track_centroid(
    detections: DataFrame,
    fps: float = 2.0,
    max_misses: int = 6,
    min_hits: int = 1,
    frame_step: int = 1,
    slice_seconds: float = 900,
) -> DataFrame:
    """Centroid tracks with smoothed velocity; ids count up per camera."""
    rows = _segments(detections, SCENE, max_misses + 1, frame_step, slice_seconds)
    found = _run(
        rows,
        SCENE,
        lambda: CentroidState(fps, max_misses),
        {"local_id": "BIGINT", "vx": "DOUBLE", "vy": "DOUBLE", "hits": "BIGINT"},
        frame_step,
    )
    labelled = materialize(rows.select(*SCENE, "segment", "frame_number", "det_id", "object_type").join(found, "det_id"))
    counts = labelled.groupBy(*SCENE, "segment").agg(F.max("local_id").alias("n"))
    # one row per segment
    before = Window.partitionBy(*SCENE).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *SCENE, "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off")
    )
    return (
        labelled.join(offsets, [*SCENE, "segment"])
        .where(F.col("hits") >= min_hits)
        .select(
            *SCENE,
            "frame_number",
            "det_id",
            "object_type",
            (F.col("local_id") + F.col("_off")).alias("track_id"),
            "vx",
            "vy",
            "hits",
        )
    )


def _numbered(
    rows: DataFrame, found: DataFrame, keys: list[str], slice_frames: float
) -> DataFrame:
    """Number the objects of a camera in the order of their first detection."""
    labelled = materialize(
        rows.select(*dict.fromkeys([*SCENE, *keys, "segment", "frame_number", "det_id"])).join(found, "det_id")
    )
    ident = [*keys, "segment", "local_id"]
    born = labelled.groupBy(*dict.fromkeys([*SCENE, *ident])).agg(
        F.min(F.struct("frame_number", "det_id")).alias("first")
    )
    born = born.select(*dict.fromkeys([*SCENE, *ident]), F.col("first.frame_number").alias("f0"), F.col("first.det_id").alias("d0"))
    ranked = running_rank(
        born, SCENE, ["f0", "d0"], F.floor(F.col("f0") / F.lit(slice_frames)), "number"
    )
    return labelled.join(ranked.drop("f0", "d0"), [*dict.fromkeys([*SCENE, *ident])])


def track_entities(
    detections: DataFrame,
    max_misses: int = 3,
    frame_step: int = 1,
    slice_seconds: float = 900,
    slice_frames: int = 20_000,
) -> DataFrame:
    """Entities kept by detector id or place, per class; ids count up per camera."""
    keys = [*SCENE, "object_type"]
    rows = _segments(detections, keys, max_misses + 1, frame_step, slice_seconds)
    found = _run(
        rows,
        keys,
        lambda: EntityState(max_misses),
        {"local_id": "BIGINT", "entity_confidence": "DOUBLE"},
        frame_step,
    )
    return _numbered(rows, found, keys, slice_frames).select(
        *keys,
        "frame_number",
        "det_id",
        F.concat(F.lit("entity_"), F.col("number").cast("string")).alias("entity_id"),
        "entity_confidence",
    )


def track_open_vocab(
    detections: DataFrame, max_gap: int = 6, slice_seconds: float = 900, slice_frames: int = 20_000
) -> DataFrame:
    """Open-vocabulary tracks by label and overlap; ids count down from -1 per camera."""
    keys = [*SCENE, "object_type"]
    rows = _segments(detections, keys, max_gap, 1, slice_seconds)
    found = _run(rows, keys, lambda: LabelState(max_gap=max_gap), {"local_id": "BIGINT"}, 1)
    return _numbered(rows, found, keys, slice_frames).select(
        *keys, "frame_number", "det_id", (-F.col("number")).alias("track_id")
    )
