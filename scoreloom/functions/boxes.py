"""Boxes for kernels: unions, shares, rotation. A scoped box is (scope, (x, y, w, h)); only boxes of one scope (a page and a group) meet."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

Box = tuple[float, float, float, float]
STRICT, RELAXED, RELAXED_IOA = 0.5, 0.3, 0.7
LEAST_EDGE, SLACK = 1e-12, 1e-9


def corners(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def overlap(a: Box, b: Box) -> Box | None:
    """What two corner boxes share; None if no area."""
    out = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return out if out[0] < out[2] and out[1] < out[3] else None


def area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def iou(a: Box, b: Box) -> float:
    """Of corner boxes."""
    both = overlap(a, b)
    shared = area(both) if both else 0.0
    union = area(a) + area(b) - shared
    return shared / union if union > 0 else 0.0


def iou_xywh(a: Box, b: Box) -> float:
    return iou(corners(a), corners(b))


def ioa(true: Box, got: Box) -> float:
    """The share of the true box that the other covers."""
    both = overlap(true, got)
    return area(both) / area(true) if both and area(true) > 0 else 0.0


def ioa_matrix(true: list[Box], got: list[Box]) -> list[list[float]]:
    return [[ioa(a, b) for b in got] for a in true]


def union_area(boxes: Iterable[Box]) -> float:
    """The area that corner boxes cover together: strips between their edges, intervals within each."""
    boxes = [b for b in boxes if area(b) > 0]
    xs, total = sorted({x for b in boxes for x in (b[0], b[2])}), 0.0
    for left, right in zip(xs, xs[1:], strict=False):
        reach, height = -math.inf, 0.0
        for lo, hi in sorted((b[1], b[3]) for b in boxes if b[0] <= left and b[2] >= right):
            height += max(0.0, hi - max(lo, reach))
            reach = max(reach, hi)
        total += (right - left) * height
    return total


def _scoped(boxes: Iterable[tuple]) -> dict[object, list[Box]]:
    out: dict[object, list[Box]] = defaultdict(list)
    for scope, b in boxes:
        if len(b) == 4 and b[2] > 0 and b[3] > 0:
            out[scope].append(corners(b))
    return out


def _shared(a: list[Box], b: list[Box]) -> list[Box]:
    return [x for p in a for q in b if (x := overlap(p, q))]


def union_iou(true: Iterable[tuple], got: Iterable[tuple]) -> dict[str, float]:
    """IoU of two sets of scoped boxes by the areas that they cover, and the larger share of either that is shared."""
    a, b = _scoped(true), _scoped(got)
    sizes = [sum(map(union_area, x.values())) for x in (a, b)]
    both = sum(union_area(_shared(a[s], b[s])) for s in a.keys() & b.keys())
    union = sum(sizes) - both
    return {"iou": both / union if union > 0 else 0.0, "intersection": both, "union": union, "max_ioa": max((both / s for s in sizes if s > 0), default=0.0)}


def coverage(true: Iterable[tuple], got: Iterable[tuple]) -> dict[str, float]:
    """Shares of the sum of true areas: what the best box covers of each (iou), and what all boxes cover together (recall)."""
    a, b = _scoped(true), _scoped(got)
    total = sum(area(x) for xs in a.values() for x in xs)
    best = sum(max((area(o) for y in b.get(s, ()) if (o := overlap(x, y))), default=0.0) for s, xs in a.items() for x in xs)
    covered = sum(union_area(_shared(xs, b.get(s, []))) for s, xs in a.items())
    return {"iou": best / total if total else 0.0, "recall": covered / total if total else 0.0}


def located(iou_: float, max_ioa: float, exact: bool, nothing: bool = False, strict: float = STRICT) -> bool:
    """A strict IoU, a field that is rightly empty, or a relaxed IoU with most of a box shared and the exact text."""
    return iou_ >= strict or nothing or iou_ >= RELAXED and max_ioa >= RELAXED_IOA and exact


# --- rotated boxes ---------------------------------------------------------------------------------------------------------------------------------


def points(raw) -> list[tuple[float, float]]:
    """Points of a polygon given as pairs or flat; none if something is no finite number."""
    try:
        pairs = [(float(p[0]), float(p[1])) for p in raw] if isinstance(raw[0], (list, tuple)) else [(float(raw[i]), float(raw[i + 1])) for i in range(0, len(raw) - 1, 2)]
    except (TypeError, ValueError, IndexError):
        return []
    return pairs if all(map(math.isfinite, (v for p in pairs for v in p))) else []


def degrees(a: float) -> float:
    """An angle from -180 on, below 180."""
    return (a + 180) % 360 - 180


def rotated(raw, width: float = 1.0, height: float = 1.0, shares: bool = True) -> tuple[float, float, float, float, float] | None:
    """x, y, w, h and angle of a polygon of four points: mean edges about the mean point; as shares of the page, or as they are."""
    p = points(raw)[:4]
    if len(p) < 4 or width <= 0 or height <= 0:
        return None
    edge = [math.dist(p[i], p[(i + 1) % 4]) for i in range(4)]
    w, h = (edge[0] + edge[2]) / 2, (edge[1] + edge[3]) / 2
    if min(w, h) <= LEAST_EDGE:
        return None
    x, y = (sum(q[k] for q in p) / 4 - side / 2 for k, side in ((0, w), (1, h)))
    r = degrees(math.degrees(math.atan2(p[1][1] - p[0][1], p[1][0] - p[0][0])))
    return (x / width, y / height, w / width, h / height, r) if shares else (x, y, w, h, r)


def polygon(x: float, y: float, w: float, h: float, r: float | None = None, width: float = 1.0, height: float = 1.0, shares: bool = True) -> list[tuple[float, float]]:
    """The four points of a rotated box."""
    if width <= 0 or height <= 0:
        raise ValueError("a page has a width and a height")
    sx, sy = (width, height) if shares else (1.0, 1.0)
    a = math.radians(r or 0.0)
    cx, cy, c, s = (x + w / 2) * sx, (y + h / 2) * sy, math.cos(a), math.sin(a)
    out = []
    for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        dx, dy = i * w * sx / 2, j * h * sy / 2
        out.append(((cx + dx * c - dy * s) / sx, (cy + dx * s + dy * c) / sy))
    return out


def holds(b: Box, r: float | None, point: tuple[float, float], width: float = 1.0, height: float = 1.0, shares: bool = True) -> bool:
    """A point lies in a rotated box, its edges included."""
    if len(b) < 4 or width <= 0 or height <= 0 or min(b[2], b[3]) < 0 or not all(map(math.isfinite, (*b[:4], *point))):
        return False
    sx, sy = (width, height) if shares else (1.0, 1.0)
    a = math.radians(r or 0.0)
    dx, dy = (point[0] - b[0] - b[2] / 2) * sx, (point[1] - b[1] - b[3] / 2) * sy
    u, v = dx * math.cos(a) + dy * math.sin(a), dy * math.cos(a) - dx * math.sin(a)
    return abs(u) <= b[2] * sx / 2 + SLACK and abs(v) <= b[3] * sy / 2 + SLACK
