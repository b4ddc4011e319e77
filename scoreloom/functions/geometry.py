"""Boxes (x0, y0, x1, y1) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1"))


def area(b) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap(a, b) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a, b) -> Column:
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(0.0)


def ioa(of, by) -> Column:
    """The share of ``of`` that ``by`` covers."""
    return F.when(area(of) > 0, overlap(of, by) / area(of)).otherwise(0.0)


def localised(iou_: Column, ioa_: Column, exact: Column) -> Column:
    """Grounding passes at IoU 0.5, or at 0.3 with an IoA of 0.7 and an exact value."""
    return (iou_ >= 0.5) | ((iou_ >= 0.3) & (ioa_ >= 0.7) & exact)


def corners(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The polygon of a box turned about its centre."""
    r, cx, cy = F.radians(degrees), x + w / 2, y + h / 2

    def at(dx: Column, dy: Column) -> Column:
        return F.array(cx + dx * F.cos(r) - dy * F.sin(r), cy + dx * F.sin(r) + dy * F.cos(r))

    return F.array(at(-w / 2, -h / 2), at(w / 2, -h / 2), at(w / 2, h / 2), at(-w / 2, h / 2))
