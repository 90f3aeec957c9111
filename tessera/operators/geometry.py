"""Features as points, lines and rings of vertices: clipping to extents and quantised output, by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def inside(x: Column, y: Column, box: Box) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def clip_segment(x0: Column, y0: Column, x1: Column, y1: Column, box: Box) -> Column:
    """The part of a segment inside a box as struct (x0, y0, x1, y1); null where there is none. The segment is a line of
    parameter t from 0 to 1; each side of the box bounds t from below or above."""
    dx, dy = x1 - x0, y1 - y0
    low, high = F.lit(0.0), F.lit(1.0)
    out = F.lit(False)
    for step, room in ((-dx, x0 - box[0]), (dx, F.lit(box[2]) - x0), (-dy, y0 - box[1]), (dy, F.lit(box[3]) - y0)):
        t = room / F.when(step != 0, step)
        low = F.greatest(low, F.when(step < 0, t).otherwise(0.0))
        high = F.least(high, F.when(step > 0, t).otherwise(1.0))
        out = out | (step == 0) & (room < 0)
    part = F.struct((x0 + low * dx).alias("x0"), (y0 + low * dy).alias("y0"), (x0 + high * dx).alias("x1"), (y0 + high * dy).alias("y1"))
    return F.when(~out & (low <= high), part)


def _half(ring: Column, axis: str, sign: int, bound: float) -> Column:
    """A ring (array of struct x, y; not closed) cut by the half plane where sign * axis <= sign * bound: each edge keeps its
    end if that is inside, after the place where it crosses the side, if it does."""
    other = "y" if axis == "x" else "x"
    n = F.size(ring)
    keeps = lambda p: sign * p[axis] <= sign * bound

    def crossing(a: Column, b: Column) -> Column:
        t = (bound - a[axis]) / (b[axis] - a[axis])
        v = {axis: F.lit(float(bound)), other: a[other] + t * (b[other] - a[other])}
        return F.struct(v["x"].alias("x"), v["y"].alias("y"))

    def edge(b: Column, i: Column) -> Column:
        a = F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        cross = F.when(keeps(a) != keeps(b), F.array(crossing(a, b))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        return F.concat(cross, F.when(keeps(b), F.array(F.struct(b["x"].alias("x"), b["y"].alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))

    return F.flatten(F.transform(ring, edge))


def clip_ring(ring: Column, box: Box) -> Column:
    """A ring cut to a box, side by side; empty where it is outside. Each cut is bound to a name, by a lambda over an array of
    one, so that it is worked out once however often the next one looks at it."""
    for axis, sign, bound in (("x", -1, box[0]), ("x", 1, box[2]), ("y", -1, box[1]), ("y", 1, box[3])):
        ring = F.transform(F.array(ring), lambda r: _half(r, axis, sign, bound))[0]  # noqa: B023  (it is called at once)
    return ring


def ring_area(ring: Column) -> Column:
    """Area of a ring that is not closed; 0 for an empty one."""

    def area(r: Column) -> Column:
        cross = F.transform(r, lambda p, i: p["x"] * F.get(r, (i + 1) % F.size(r))["y"] - F.get(r, (i + 1) % F.size(r))["x"] * p["y"])
        return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2

    return F.transform(F.array(ring), area)[0]


def clipped_layers(layer: Column, over_zoom: Column, layers: list[str] | None) -> Column:
    """Whether a feature is clipped to its node: all are beyond the source's deepest level, else those of the named
    layers."""
    return over_zoom | (layer.isin(layers) if layers else F.lit(False))


def quantised(x: list[Column], origin: list[float], resolution: float) -> list[Column]:
    """Coordinates as whole steps of a resolution from an origin."""
    return [F.round((c - o) / resolution).cast("long") for c, o in zip(x, origin, strict=True)]
