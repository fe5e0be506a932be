"""Polygons as arrays of points (x, y): areas, common areas, unions and meetings, by horizontal slabs.

Between two neighbouring heights at which edges begin, end or cross, every polygon is a set of trapezoids whose widths
change linearly, so the width half-way up times the height is exact. Rings need be neither convex nor oriented; points
are inside by the even-odd rule, so holes may be further rings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x double, y double>>>"


def ring_area(ring: Column) -> Column:
    """Area of one ring, by the shoelace rule."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def bounds(rings: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax."""
    flat = F.flatten(rings)
    along = lambda axis: F.transform(flat, lambda p: p[axis])
    return [f(along(a)).alias(a + f.__name__[6:]) for f in (F.array_min, F.array_max) for a in ("x", "y")]


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Rings of a box."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax)))


def polygonal(rings: Column) -> Column:
    """Whether something with an area is left: empty, null, point and line results are not."""
    return F.coalesce(F.exists(rings, lambda r: (F.size(r) > 2) & (ring_area(r) > 0)), F.lit(False))


def edges(rings) -> np.ndarray:
    """(x1, y1, x2, y2) of every edge of the rings."""
    out = []
    for ring in rings if rings is not None else []:
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        out.append(np.concatenate([p, np.roll(p, -1, 0)], 1))
    return np.concatenate(out) if out else np.zeros((0, 4))


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two of the edges cross."""
    d = e[:, 2:] - e[:, :2]
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    off = e[None, :, :2] - e[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (off[..., 0] * d[None, :, 1] - off[..., 1] * d[None, :, 0]) / cross
        u = (off[..., 0] * d[:, None, 1] - off[..., 1] * d[:, None, 0]) / cross
    hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    i, _ = np.nonzero(hit)
    return e[i, 1] + t[hit] * d[i, 1]


def _spans(e: np.ndarray, y: float) -> list[tuple[float, float]]:
    on = e[(np.minimum(e[:, 1], e[:, 3]) < y) & (np.maximum(e[:, 1], e[:, 3]) > y)]
    x = np.sort(on[:, 0] + (y - on[:, 1]) / (on[:, 3] - on[:, 1]) * (on[:, 2] - on[:, 0]))
    return list(zip(x[::2].tolist(), x[1::2].tolist(), strict=False))


def _joined(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[list[float]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def common_area(left: list, right: list) -> tuple[float, float, float]:
    """Areas of the union of ``left``, of the union of ``right``, and of what both have; each a list of polygons (rings)."""
    return _common([edges(p) for p in left], [edges(p) for p in right])


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, float, float]:
    every = np.concatenate([*a, *b, np.zeros((0, 4))])
    ys = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossings(every)]))
    total = [0.0, 0.0, 0.0]
    for lo, hi in zip(ys[:-1], ys[1:], strict=True):
        one, two = (_joined([s for e in side for s in _spans(e, (lo + hi) / 2)]) for side in (a, b))
        both = sum(max(0.0, min(q, s) - max(p, r)) for p, q in one for r, s in two)
        for k, width in enumerate((sum(q - p for p, q in one), sum(q - p for p, q in two), both)):
            total[k] += width * (hi - lo)
    return tuple(total)


def _common_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common area of each pair of polygons, as edges (pair, edge, 4): the slabs of ``_common`` for all pairs at once."""
    if a.shape[1] + b.shape[1] > 64:
        return np.array([_common([x], [y])[2] for x, y in zip(a, b, strict=True)], float)
    e = np.concatenate([a, b], 1)
    i, j = np.triu_indices(e.shape[1], 1)
    d, off = e[..., 2:] - e[..., :2], e[:, j, :2] - e[:, i, :2]
    with np.errstate(all="ignore"):
        cross = d[:, i, 0] * d[:, j, 1] - d[:, i, 1] * d[:, j, 0]
        t = (off[..., 0] * d[:, j, 1] - off[..., 1] * d[:, j, 0]) / cross
        u = (off[..., 0] * d[:, i, 1] - off[..., 1] * d[:, i, 0]) / cross
        hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        ys = np.where(hit, e[:, i, 1] + t * d[:, i, 1], e[:, :1, 1])
    ys = np.sort(np.concatenate([e[..., 1], ys], 1), 1)
    mid = ((ys[:, 1:] + ys[:, :-1]) / 2)[..., None]

    def spans(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x1, y1, x2, y2 = (e[:, None, :, k] for k in range(4))
        with np.errstate(all="ignore"):
            x = np.where((np.minimum(y1, y2) < mid) & (np.maximum(y1, y2) > mid), x1 + (mid - y1) / (y2 - y1) * (x2 - x1), np.inf)
        x = np.sort(np.concatenate([x, np.full((*x.shape[:2], x.shape[2] % 2), np.inf)], 2), 2)
        x[np.isinf(x)] = 0.0  # of no width
        return x[..., ::2], x[..., 1::2]

    (p, q), (r, s) = spans(a), spans(b)
    both = np.minimum(q[..., :, None], s[..., None, :]) - np.maximum(p[..., :, None], r[..., None, :])
    return (np.maximum(both, 0.0).sum((2, 3)) * (ys[:, 1:] - ys[:, :-1])).sum(1)


def meet(left, right) -> bool:
    """Whether two polygons have a point in common, edges included."""
    a, b = edges(left), edges(right)
    return bool(len(a) and len(b) and _meet_many(a[None], b[None])[0])


def _within(p: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether any of the points (pair, point, 2) is inside the polygon of the pair."""
    x, y = p[..., 0, None], p[..., 1, None]
    x1, y1, x2, y2 = (e[:, None, :, k] for k in range(4))
    with np.errstate(all="ignore"):
        over = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))
    return (over.sum(2) % 2 == 1).any(1)


def _meet_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``meet`` for each pair, as edges (pair, edge, 4): edges touch, or a corner of one is inside the other."""
    p, d, q, f = a[:, :, None, :2], (a[..., 2:] - a[..., :2])[:, :, None], b[:, None, :, :2], (b[..., 2:] - b[..., :2])[:, None]
    side = lambda o, v, x: v[..., 0] * (x - o)[..., 1] - v[..., 1] * (x - o)[..., 0]
    apart = (side(p, d, q) * side(p, d, q + f) > 0) | (side(q, f, p) * side(q, f, p + d) > 0)
    for k in (0, 1):
        (a_lo, a_hi), (b_lo, b_hi) = ([g(e[..., k], e[..., k + 2]) for g in (np.minimum, np.maximum)] for e in (a, b))
        apart |= (a_hi[:, :, None] < b_lo[:, None]) | (b_hi[:, None] < a_lo[:, :, None])
    out = (~apart).any((1, 2))
    left = np.flatnonzero(~out)
    out[left] = _within(a[left, :, :2], b[left]) | _within(b[left, :, :2], a[left])
    return out


def clipped(ring, window) -> list[dict]:
    """The part of ``ring`` within the convex ring ``window``, as points; empty if there is none."""
    out = [(p["x"], p["y"]) for p in ring]
    w = [(p["x"], p["y"]) for p in window]
    turn = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(w, w[1:] + w[:1], strict=True))
    w = w if turn > 0 else w[::-1]
    for (x1, y1), (x2, y2) in zip(w, w[1:] + w[:1], strict=True):
        inner = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in out]
        now = []
        for k, (p, s) in enumerate(zip(out, inner, strict=True)):
            q, t = out[k - 1], inner[k - 1]
            if (s >= 0) != (t >= 0):
                r = t / (t - s)
                now.append((q[0] + r * (p[0] - q[0]), q[1] + r * (p[1] - q[1])))
            if s >= 0:
                now.append(p)
        out = now
    return [{"x": x, "y": y} for x, y in out]


def _clip_many(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``clipped`` for each pair of a ring and a window (pair, point, 2): points, of which the first so many count."""
    turn = (w[..., 0] * np.roll(w[..., 1], -1, 1) - np.roll(w[..., 0], -1, 1) * w[..., 1]).sum(1)
    w = np.where(turn[:, None, None] > 0, w, w[:, ::-1])
    n = np.full(len(p), p.shape[1])
    for k in range(w.shape[1]):
        (x1, y1), (x2, y2) = w[:, k].T[..., None], w[:, (k + 1) % w.shape[1]].T[..., None]
        at = np.arange(p.shape[1])
        back = np.where(at == 0, np.maximum(n[:, None] - 1, 0), at - 1)
        held = at < n[:, None]
        with np.errstate(all="ignore"):
            s = (x2 - x1) * (p[..., 1] - y1) - (y2 - y1) * (p[..., 0] - x1)
            q, t = np.take_along_axis(p, back[..., None], 1), np.take_along_axis(s, back, 1)
            between = q + (t / (t - s))[..., None] * (p - q)
        put = np.stack([held & ((s >= 0) != (t >= 0)), held & (s >= 0)], 2).reshape(len(p), -1)
        p = np.stack([between, p], 2).reshape(len(p), -1, 2)
        n = put.sum(1)
        p = np.take_along_axis(p, np.argsort(~put, 1, kind="stable")[:, : n.max(initial=0), None], 1)
    return p, n


class _Rings:
    """An Arrow array of polygons: points (x, y), the rings' and the polygons' places among them; null is empty."""

    def __init__(self, rings: pa.Array):
        rings = pc.if_else(rings.is_null(), pa.scalar([], rings.type), rings) if rings.null_count else rings
        of, inner = np.asarray(rings.offsets), rings.values
        self.ring = np.asarray(inner.offsets)
        self.first, self.last = of[:-1], of[1:]  # the polygons' rings
        self.xy = np.stack([f.to_numpy(zero_copy_only=False) for f in inner.values.flatten()], 1).astype(float)
        follow = np.arange(1, len(self.xy) + 1)
        full = self.ring[1:] > self.ring[:-1]
        follow[self.ring[1:][full] - 1] = self.ring[:-1][full]
        self.follow = follow
        self.start, self.end = self.ring[self.first], self.ring[self.last]  # the polygons' points

    def edges(self, rows: np.ndarray, n: int) -> np.ndarray:
        at = self.start[rows][:, None] + np.arange(n)
        return np.concatenate([self.xy[at], self.xy[self.follow[at]]], 2)


def _alike(left: np.ndarray, right: np.ndarray, cost: Callable[[int, int], int]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Rows with equal sizes on both sides, neither empty, in lots of about two million numbers."""
    both = np.stack([left, right], 1)
    for a, b in np.unique(both, axis=0):
        rows = np.flatnonzero((left == a) & (right == b)) if a and b else []
        lot = max(1, 2_000_000 // cost(int(a), int(b))) if a and b else 1
        for k in range(0, len(rows), lot):
            yield rows[k : k + lot], int(a), int(b)


def _by_pair(left: pa.Array, right: pa.Array, f: Callable, kind: type, cost: Callable[[int, int], int]) -> pa.Array:
    a, b = _Rings(left), _Rings(right)
    out = np.zeros(len(left), kind)
    for rows, n, m in _alike(a.end - a.start, b.end - b.start, cost):
        out[rows] = f(a.edges(rows, n), b.edges(rows, m))
    return pa.array(out)


def meets(left: Column, right: Column) -> Column:
    return F.arrow_udf(lambda a, b: _by_pair(a, b, _meet_many, bool, lambda n, m: 4 * n * m), "boolean")(left, right)


def common(left: Column, right: Column) -> Column:
    """Area that two polygons (rings) have in common; of one with itself, its own area, less its holes."""
    return F.arrow_udf(lambda a, b: _by_pair(a, b, _common_many, float, lambda n, m: (n + m) ** 3), "double")(left, right)


def shared_area(left: Column, right: Column) -> Column:
    """Area that a polygon (rings) has in common with the union of polygons (array of rings)."""
    return F.pandas_udf(lambda a, b: pd.Series([common_area([x], list(y) if y is not None else [])[2] for x, y in zip(a, b, strict=True)], dtype=float), "double")(left, right)


def _clip(rings: pa.Array, windows: pa.Array) -> pa.Array:
    a, b = _Rings(rings), _Rings(windows)
    row = np.repeat(np.arange(len(rings)), a.last - a.first)  # of each ring
    ring = np.arange(a.first[0] if len(rings) else 0, a.last[-1] if len(rings) else 0)
    window = np.minimum(b.first[row], max(len(b.ring) - 2, 0))
    wide = np.where(b.last[row] > b.first[row], b.ring[window + 1] - b.ring[window], 0) if len(row) else row
    left = np.zeros(len(ring), int)
    parts = []
    for rows, n, m in _alike(a.ring[ring + 1] - a.ring[ring], wide, lambda n, m: 8 * (n + m)):
        p, size = _clip_many(a.xy[a.ring[ring[rows]][:, None] + np.arange(n)], b.xy[b.ring[window[rows]][:, None] + np.arange(m)])
        left[rows] = size
        parts.append((rows, p, size))
    ends = np.concatenate([[0], np.cumsum(left)])
    xy = np.zeros((ends[-1], 2))
    for rows, p, size in parts:
        held = np.arange(p.shape[1]) < size[:, None]
        xy[(ends[rows][:, None] + np.arange(p.shape[1]))[held]] = p[held]
    polygons = np.concatenate([[0], np.cumsum(np.bincount(row[left > 0], minlength=len(rings)))]).astype(np.int32)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left[left > 0])]).astype(np.int32)), points)
    return pa.ListArray.from_arrays(pa.array(polygons), inner)


def clip(rings: Column, window: Column) -> Column:
    """Rings clipped to the first, convex ring of ``window``; rings of which nothing is left go."""
    return F.arrow_udf(_clip, RINGS)(rings, window)
