"""Boxes [x0, y0, x1, y1] as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def contained(inner: Column, outer: Column, slack: float = 1e-12) -> Column:
    return (inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack) & (inner[2] <= outer[2] + slack) & (inner[3] <= outer[3] + slack)


def from_grid(b: Column) -> Column:
    """0..1000 grid to the unit square, six digits."""
    return F.transform(b, lambda x: F.round(x / 1000, 6))


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Unit square to pixels, ties to even."""
    return F.array(F.bround(b[0] * width), F.bround(b[1] * height), F.bround(b[2] * width), F.bround(b[3] * height)).cast("array<int>")


def box_reason(b: Column, observation: Column) -> Column:
    """First reason against a visual anchor's box, or null."""
    return (
        F.when(b.isNull() | (F.size(b) != 4), "bbox_shape")
        .when((b[0] >= b[2]) | (b[1] >= b[3]), "bbox_order")
        .when(area(b) >= 0.80, "whole_page")
        .when(area(b) < 0.0004, "too_small")
        .when(F.size(F.split(F.trim(observation), r"\s+")) < 4, "observation_short")
    )
