"""Ring simplification and curves; a ring is small, so these are array functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
CURVE = "struct<start:struct<x:double,y:double>,segs:array<struct<c1:struct<x:double,y:double>,c2:struct<x:double,y:double>,p:struct<x:double,y:double>>>>"


def line_distance(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = math.hypot(dx, dy)
    return math.hypot(p[0] - a[0], p[1] - a[1]) if length < 1e-12 else abs(dx * (p[1] - a[1]) - dy * (p[0] - a[0])) / length


def simplify_line(pts: list[Point], eps: float) -> list[Point]:
    """Points that no chord of kept points comes nearer to than eps; a stack in place of recursion."""
    keep, todo = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while todo:
        a, b = todo.pop()
        far = max(range(a + 1, b), key=lambda i: line_distance(pts[i], pts[a], pts[b]), default=None)
        if far is not None and line_distance(pts[far], pts[a], pts[b]) > eps:
            keep.add(far)
            todo += [(a, far), (far, b)]
    return [pts[i] for i in sorted(keep)]


def simplify_ring(ring: list[Point], eps: float) -> list[Point]:
    """Both halves between the first point and the one farthest from it (the last of equals)."""
    if len(ring) < 4:
        return ring
    far = max(range(len(ring)), key=lambda i: (math.dist(ring[0], ring[i]), i))
    out = simplify_line(ring[: far + 1], eps)[:-1] + simplify_line(ring[far:] + ring[:1], eps)[:-1]
    return out if len(out) >= 3 else ring


def smooth_ring(ring: list[Point], eps: float, corner: float = 1.0) -> tuple[Point, list[tuple[Point, Point, Point]]] | None:
    """Cubic segments through a simplified ring; corners over ``corner`` radians stay sharp; controls stay in their segment's box."""
    pts = simplify_ring(ring, eps)
    n = len(pts)
    if n < 3:
        return None
    tangents = []
    for i in range(n):
        before, here, after = pts[i - 1], pts[i], pts[(i + 1) % n]
        u, v = _unit(before, here), _unit(here, after)
        dot = max(-1.0, min(1.0, u[0] * v[0] + u[1] * v[1]))
        k = 0.0 if math.acos(dot) > corner else max(dot, 0.0)
        tangents.append((k * (after[0] - before[0]) / 6, k * (after[1] - before[1]) / 6))
    segs = []
    for i in range(n):
        a, b, s, t = pts[i], pts[(i + 1) % n], tangents[i], tangents[(i + 1) % n]
        box = lambda p: tuple(min(max(p[d], min(a[d], b[d])), max(a[d], b[d])) for d in (0, 1))  # noqa: E731, B023
        segs.append((box((a[0] + s[0], a[1] + s[1])), box((b[0] - t[0], b[1] - t[1])), b))
    return pts[0], segs


def _unit(a: Point, b: Point) -> Point:
    d = math.dist(a, b)
    return ((b[0] - a[0]) / d, (b[1] - a[1]) / d) if d > 1e-12 else (0.0, 0.0)


def curve(pts: Column, eps: float) -> Column:
    """smooth_ring() of an array of points, in Arrow batches; null where nothing is left."""
    xy = lambda p: {"x": p[0], "y": p[1]}

    @F.pandas_udf(CURVE)
    def run(rings: pd.Series) -> pd.DataFrame:
        got = [smooth_ring([(p["x"], p["y"]) for p in r], eps) for r in rings]
        return pd.DataFrame({"start": [xy(g[0]) if g else None for g in got], "segs": [[{"c1": xy(a), "c2": xy(b), "p": xy(p)} for a, b, p in g[1]] if g else None for g in got]})

    return run(pts)
