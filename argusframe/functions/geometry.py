"""Box geometry as Column expressions.

A box is a `Box` of four Columns; every function returns a Column, so the whole
computation stays inside whole-stage code generation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    """Box made of the columns `<prefix>x1 .. <prefix>y2`."""
    return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def box_of(struct: Column) -> Box:
    """Box made of the fields of a struct column."""
    return Box(*(struct[c] for c in ("x1", "y1", "x2", "y2")))


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, width(b)) * F.greatest(zero, height(b))


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return norm(ax - bx, ay - by)


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(zero, w) * F.greatest(zero, h)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def iou_floored(a: Box, b: Box) -> Column:
    """IoU whose two areas are each at least one square pixel."""
    inter = intersection(a, b)
    one = F.lit(1.0)
    union = (
        F.greatest(one, width(a) * height(a)) + F.greatest(one, width(b) * height(b)) - inter
    )
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def edge_distance(a: Box, b: Box) -> Column:
    """Gap between the nearest edges, 0 when the boxes touch or overlap."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, F.greatest(a.x1, b.x1) - F.least(a.x2, b.x2))
    dy = F.greatest(zero, F.greatest(a.y1, b.y1) - F.least(a.y2, b.y2))
    return norm(dx, dy)


def containment(inner: Box, outer: Box) -> Column:
    """Share of `inner` covered by `outer` (inner area floored at 1)."""
    return intersection(inner, outer) / F.greatest(F.lit(1.0), width(inner) * height(inner))


def inside(inner: Box, outer: Box) -> Column:
    return (
        (inner.x1 >= outer.x1)
        & (inner.y1 >= outer.y1)
        & (inner.x2 <= outer.x2)
        & (inner.y2 <= outer.y2)
    )


def aspect(b: Box) -> Column:
    """Width over height, both floored at one pixel."""
    one = F.lit(1.0)
    return F.greatest(one, width(b)) / F.greatest(one, height(b))
