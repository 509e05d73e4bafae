"""Boxes as columns x0, y0, x1, y1. A function takes two boxes as tuples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    """The columns of a box with a common prefix or suffix."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    """Shared area; 0 for boxes that only touch."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Box, b: Box, degenerate: float = 0.0) -> Column:
    """Shared over joint area. ``degenerate`` is the value for equal boxes without area: 0 in the element model, 1 in
    the metrics."""
    both = overlap(a, b)
    joint = area(a) + area(b) - both
    same = (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
    return F.when(joint > 0, both / joint).when(same, F.lit(degenerate)).otherwise(F.lit(0.0))


def agreement(a: Box, b: Box) -> Column:
    """The larger of IoU and the share of the smaller box that lies in the other."""
    small = F.least(area(a), area(b))
    return F.greatest(iou(a, b), F.when(small > 0, overlap(a, b) / small).otherwise(0.0))


def _line_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    narrow = F.least(a1 - a0, b1 - b0)
    return F.when(narrow > 0, shared / narrow).otherwise(0.0)


def horizontal_overlap(a: Box, b: Box) -> Column:
    """Shared width over the narrower width."""
    return _line_overlap(a[0], a[2], b[0], b[2])


def vertical_overlap(a: Box, b: Box) -> Column:
    return _line_overlap(a[1], a[3], b[1], b[3])


def size_ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger, 1 for two zeros."""
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)


def size_similarity(a: Box, b: Box) -> Column:
    return (size_ratio(a[2] - a[0], b[2] - b[0]) + size_ratio(a[3] - a[1], b[3] - b[1])) / 2


def position_similarity(a: Box, b: Box, width: Column, height: Column) -> Column:
    """1 less the distance of the centres over the page's diagonal."""
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    diagonal = F.sqrt(width * width + height * height)
    return F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / F.when(diagonal > 0, diagonal).otherwise(1.0))


def corner_distance(a: Box, b: Box) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def rotate(b: Box, rotation: Column, width: Column, height: Column) -> Box:
    """A box in the frame of a page shown at 90, 180 or 270 degrees clockwise; null at any other angle but 0."""
    turn = F.pmod(rotation, F.lit(360))
    pick = lambda r0, r90, r180, r270: F.when(turn == 0, r0).when(turn == 90, r90).when(turn == 180, r180).when(turn == 270, r270)
    return (
        pick(b[0], height - b[3], width - b[2], b[1]),
        pick(b[1], b[0], height - b[3], width - b[2]),
        pick(b[2], height - b[1], width - b[0], b[3]),
        pick(b[3], b[2], height - b[1], width - b[0]),
    )


def union(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def pixel_iou(a: Box, b: Box) -> Column:
    """Shared over joint area of pixel boxes; two boxes without area are alike."""
    joint = area(a) + area(b) - overlap(a, b)
    return F.when(joint == 0, 1.0).otherwise(overlap(a, b) / joint)


def normalized_box(b: Box, width: Column, height: Column) -> Box:
    """A box as shares of its page, held within 0 and 1, to eight digits."""
    return tuple(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / size)), 8) for c, size in zip(b, (width, height, width, height), strict=True))  # type: ignore[return-value]


def clipped(b: Box, width: Column, height: Column) -> Box:
    """The part of a box that lies on its page; nulls without any."""
    x0, y0, x1, y1 = (F.least(size, F.greatest(F.lit(0.0), c)) for c, size in zip(b, (width, height, width, height), strict=True))
    return tuple(F.when((x1 > x0) & (y1 > y0), c) for c in (x0, y0, x1, y1))  # type: ignore[return-value]


def scaled(b: Box, source: tuple[int, int], target: tuple[int, int]) -> Box:
    """A pixel box on a page of another size, in whole pixels."""
    return tuple(F.round(c * target[i % 2] / source[i % 2]) for i, c in enumerate(b))  # type: ignore[return-value]
