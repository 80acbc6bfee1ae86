"""Near pairs of boxes: a spatial hash instead of all pairs of a frame.

Boxes, grown by a margin, are listed under the grid cells they touch and joined on the cell.
A pair sharing several cells is kept only in the cell that holds the lower-left corner of the
overlap of the two grown boxes, so no de-duplication shuffle is needed. The rows per box are
bounded by the picture size divided by the cell size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.functions.geometry import Box, box

CELL_PX = 256.0


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("int")


def _cells(df: DataFrame, margin: float, size: float) -> DataFrame:
    b = box()
    return (
        df.withColumn(
            "_gx", F.explode(F.sequence(_cell(b.x1 - margin, size), _cell(b.x2 + margin, size)))
        ).withColumn(
            "_gy", F.explode(F.sequence(_cell(b.y1 - margin, size), _cell(b.y2 + margin, size)))
        )
    )


def near_box_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    margin: float = 0.0,
    cell: float = CELL_PX,
    self_join: bool = False,
) -> DataFrame:
    """Pairs of rows with equal `keys` whose boxes are at most `2*margin` apart per axis.

    Every column other than the keys comes out prefixed `a_` / `b_`. Includes all pairs whose
    boxes overlap or whose edge distance is at most `2*margin`.
    """
    a = _cells(left, margin, cell).select(
        *(F.col(k) for k in [*keys, "_gx", "_gy"]),
        *(F.col(c).alias(f"a_{c}") for c in left.columns if c not in keys),
    )
    b = _cells(right, margin, cell).select(
        *(F.col(k) for k in [*keys, "_gx", "_gy"]),
        *(F.col(c).alias(f"b_{c}") for c in right.columns if c not in keys),
    )
    # two readings of one table grow alike with the data, so neither side is broadcast
    alike = self_join or left is right
    # numbers first: texts that begin alike are slow to sort
    texts = [k for k, kind in left.dtypes if k in keys and kind == "string"]
    numbers = [k for k in keys if k not in texts]
    on = [*numbers, "_gx", "_gy", *texts] if numbers else [*texts, "_gx", "_gy"]
    joined = (a.hint("merge") if alike else a).join(b, on, "inner")
    pa, pb = box("a_"), box("b_")
    touch = (
        (F.greatest(pa.x1, pb.x1) - F.least(pa.x2, pb.x2) <= 2 * margin)
        & (F.greatest(pa.y1, pb.y1) - F.least(pa.y2, pb.y2) <= 2 * margin)
    )
    home = (_cell(F.greatest(pa.x1, pb.x1) - margin, cell) == F.col("_gx")) & (
        _cell(F.greatest(pa.y1, pb.y1) - margin, cell) == F.col("_gy")
    )
    return joined.where(touch & home).drop("_gx", "_gy")


def point_cells(x: Column, y: Column, reach: float) -> Column:
    """Cells of size `2*reach` that a disc of radius `reach` around a point can touch (<= 4)."""
    size = 2.0 * reach
    xs = F.sequence(_cell(x - reach, size), _cell(x + reach, size))
    ys = F.sequence(_cell(y - reach, size), _cell(y + reach, size))
    return F.flatten(
        F.transform(xs, lambda gx: F.transform(ys, lambda gy: F.struct(gx.alias("gx"), gy.alias("gy"))))
    )


def point_cell(x: Column, y: Column, reach: float) -> Column:
    size = 2.0 * reach
    return F.struct(_cell(x, size).alias("gx"), _cell(y, size).alias("gy"))


def boxes_of(prefix_a: str = "a_", prefix_b: str = "b_") -> tuple[Box, Box]:
    return box(prefix_a), box(prefix_b)
