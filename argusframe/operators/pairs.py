"""What two tracks of a pair have in common, at the cost of their overlap.

Joining pairs with the rows of one of their tracks costs a long track once for every partner. Here
the rows of tracks are cut into slices, a pair is spread over the slices in which both of its
tracks have rows, and only these slices of rows are joined. The spread starts from the track
with fewer slices, so a pair never costs more slices than its shorter track has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.operators.slicing import SLICE, lag_in_slices, range_slice

SCENE = ["video_id", "camera_id"]
#: Frames of a slice.
FRAMES = 64


def shared_slices(pairs: DataFrame, left: DataFrame, right: DataFrame, scene: list[str] = SCENE) -> DataFrame:
    """Pairs (track_a, track_b) times the slices in which both tracks have rows.

    left, right: rows of the tracks with their `track_id` and slice.
    """
    a = left.select(*scene, F.col("track_id").alias("track_a"), SLICE).distinct()
    b = right.select(*scene, F.col("track_id").alias("track_b"), SLICE).distinct()
    sized = pairs.join(
        a.groupBy(*scene, "track_a").agg(F.count(F.lit(1)).alias("_na")), [*scene, "track_a"]
    ).join(b.groupBy(*scene, "track_b").agg(F.count(F.lit(1)).alias("_nb")), [*scene, "track_b"])
    from_a = sized.where("_na <= _nb").join(a, [*scene, "track_a"]).join(
        b, [*scene, "track_b", SLICE], "left_semi"
    )
    from_b = sized.where("_na > _nb").join(b, [*scene, "track_b"]).join(
        a, [*scene, "track_a", SLICE], "left_semi"
    )
    return from_a.unionByName(from_b).drop("_na", "_nb")


def pair_rows(
    pairs: DataFrame, left: DataFrame, right: DataFrame, on: list[str], scene: list[str] = SCENE
) -> DataFrame:
    """Rows of both tracks of each pair that agree on the columns `on`, joined slice by slice.

    left, right: `scene`, `track_id`, slice, `on` and columns of different names.
    """
    spread = shared_slices(pairs, left, right, scene)
    mine = left.withColumnRenamed("track_id", "track_a")
    theirs = right.withColumnRenamed("track_id", "track_b")
    return spread.join(mine, [*scene, "track_a", SLICE]).join(theirs, [*scene, "track_b", SLICE, *on])


def common_frames(
    pairs: DataFrame, rows: DataFrame, fields: list[str], scene: list[str] = SCENE, frames: int = FRAMES
) -> DataFrame:
    """Frames that show both tracks of a pair: the pair, frame_number, and structs a, b of `fields`.

    A track that appears more than once in a frame stands for its least values there.
    """
    cut = rows.withColumn(SLICE, range_slice(F.col("frame_number"), frames))
    seen = cut.groupBy(*scene, "track_id", SLICE, "frame_number").agg(F.min(F.struct(*fields)).alias("_f"))
    return pair_rows(
        pairs, seen.withColumnRenamed("_f", "a"), seen.withColumnRenamed("_f", "b"), ["frame_number"], scene
    )


def last_common_frame(
    pairs: DataFrame, rows: DataFrame, fields: list[str], scene: list[str] = SCENE, frames: int = FRAMES
) -> DataFrame:
    """As `common_frames`, with `prev`: a, b of the pair's common frame before (null at its first).

    The stream of common frames of a pair is the merge of its two tracks; the last match is
    carried along it slice by slice, so there is no comparison of frames with all earlier ones.
    """
    common = common_frames(pairs, rows, fields, scene, frames).drop(SLICE)
    by = range_slice(F.col("frame_number"), frames)
    return lag_in_slices(common, [*scene, "track_a", "track_b"], ["frame_number"], ["a", "b"], by)


def interval_rows(
    pairs: DataFrame, rows: DataFrame, start: Column, end: Column, at: str, width: int, on: list[str]
) -> DataFrame:
    """Pairs with the rows of equal `on` whose `at` is inside [start, end] of the pair.

    The interval is cut at multiples of `width`; a pair meets only the slices of rows in it. Rows
    are looked up through the slices their own key has, if those are fewer than the interval's.
    """
    cut = rows.withColumn(SLICE, range_slice(F.col(at), width))
    held = cut.select(*on, SLICE).distinct()
    sizes = held.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    wide = pairs.withColumn("_s", range_slice(start, width)).withColumn("_e", range_slice(end, width)).join(sizes, on)
    short = F.col("_e") - F.col("_s") < F.col("_n")
    walked = wide.where(short).withColumn(SLICE, F.explode(F.sequence("_s", "_e")))
    looked = wide.where(~short).join(held, on).where(F.col(SLICE).between(F.col("_s"), F.col("_e")))
    return (
        walked.unionByName(looked)
        .drop("_s", "_e", "_n")
        .join(cut, [*on, SLICE])
        .where((F.col(at) >= start) & (F.col(at) <= end))
        .drop(SLICE)
    )
