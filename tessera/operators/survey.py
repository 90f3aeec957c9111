"""Survey figures of datasets: projected extents and circumferences by border samples, pixel sizes, tangent planes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import geocentric, mercator

BOX = ["xmin", "ymin", "xmax", "ymax"]


def on_border(step: Column, n: int) -> tuple[Column, Column]:
    """(lon, lat) at a step along the border of the row's box, n to a side, clockwise from the upper left; steps may be
    fractions, and go round."""
    at = F.pmod(step, F.lit(4 * n))
    side, t = F.floor(at / n), (at % n) / F.lit(float(n))
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    lon = F.when(side == 0, F.col("xmin") + t * w).when(side == 1, F.col("xmax")).when(side == 2, F.col("xmax") - t * w).otherwise(F.col("xmin"))
    lat = F.when(side == 0, F.col("ymax")).when(side == 1, F.col("ymax") - t * h).when(side == 2, F.col("ymin")).otherwise(F.col("ymin") + t * h)
    return lon, lat


def border(boxes: DataFrame, n: int) -> DataFrame:
    """Points (lon, lat, step) along the border of each box (k, xmin, ymin, xmax, ymax); the first closes the ring. A fixed
    number of rows for each box, by one explosion."""
    pts = boxes.select("k", *BOX, F.explode(F.sequence(F.lit(0), F.lit(4 * n))).alias("step"))
    lon, lat = on_border(F.col("step"), n)
    return pts.select("k", "step", lon.alias("lon"), lat.alias("lat"))


def projected_extents(boxes: DataFrame, n: int = 16, rounds: int = 0, project: Callable[[Column, Column], tuple[Column, Column]] = mercator) -> DataFrame:
    """Extents of each box's border in a projection (Mercator metres): k, x0, y0, x1, y1. Each round divides the border
    around the place of each extreme eight times finer, as the border may bend out between two samples."""
    ways = {"x0": (0, 1), "y0": (1, 1), "x1": (0, -1), "y1": (1, -1)}

    def least(rows: DataFrame) -> DataFrame:
        """The best step of each way among rows (k, box, way, step); what is largest is least with the other sign."""
        lon, lat = on_border(F.col("step"), n)
        both = project(lon, lat)
        value = F.coalesce(*[F.when(F.col("way") == way, both[i] * sign) for way, (i, sign) in ways.items()])
        return rows.withColumn("v", value).groupBy("k", *BOX, "way").agg(F.min(F.struct("v", "step")).alias("b")).select("k", *BOX, "way", "b.v", "b.step")

    way = F.explode(F.array(*[F.lit(w) for w in ways]))
    best = least(boxes.select("k", *BOX, F.explode(F.sequence(F.lit(0), F.lit(4 * n))).alias("step")).withColumn("step", F.col("step").cast("double")).withColumn("way", way))
    for r in range(rounds):
        near = best.select("k", *BOX, "way", F.col("step").alias("_at"), F.explode(F.sequence(F.lit(-8), F.lit(8))).alias("_by"))
        best = least(near.withColumn("step", F.col("_at") + F.col("_by") / (8.0 * 8**r)))
    return best.groupBy("k").agg(*[F.max(F.when(F.col("way") == w, F.col("v") * sign)).alias(w) for w, (_, sign) in ways.items()])


def circumference(boxes: DataFrame, n: int = 16) -> DataFrame:
    """Length of each box's border in Mercator metres; infinite where a point can't be projected. Each point is sent to
    the segment before and the one after it, so that one aggregation sees both ends and nothing is joined."""
    x, y = mercator(F.col("lon"), F.col("lat"))
    p = border(boxes, n).select("k", "step", F.when(F.abs("lat") < 90, x).alias("x"), F.when(F.abs("lat") < 90, y).alias("y"))
    ends = p.select("k", "x", "y", "step", F.explode(F.array(F.col("step") - 1, F.col("step"))).alias("segment")).where(f"segment BETWEEN 0 AND {4 * n - 1}")
    first, second = (lambda c, d=d: F.max(F.when(F.col("step") - F.col("segment") == d, F.col(c))) for d in (0, 1))
    each = ends.groupBy("k", "segment").agg(F.hypot(second("x") - first("x"), second("y") - first("y")).alias("length"))
    return each.groupBy("k").agg(F.when(F.count("length") == F.count(F.lit(1)), F.sum(F.round("length", 3).cast("decimal(20,3)")).cast("double")).otherwise(float("inf")).alias("length"))


def gsd(lon: Column, lat: Column, dx: Column, dy: Column) -> Column:
    """The longer edge, in Mercator metres, of the pixel of dx x dy degrees at a dataset's centre; edges are averaged
    over both sides of the centre."""
    x0, x1 = (mercator(lon + s * dx, lat)[0] for s in (-1, 1))
    y0, y1 = (mercator(lon, lat + s * dy)[1] for s in (-1, 1))
    return F.greatest(F.abs(x1 - x0) / 2, F.abs(y1 - y0) / 2)


def gsd_area(override: Column, width: Column, height: Column, columns: Column, rows: Column) -> Column:
    """Area of a pixel: an override squared, else extents by size."""
    return F.coalesce(override * override, width * height / (columns * rows))


def tangent_basis(lon: Column, lat: Column) -> list[list[Column]]:
    """East, north and up at a point of the ellipsoid, in geocentric axes."""
    sl, cl, sp, cp = F.sin(F.radians(lon)), F.cos(F.radians(lon)), F.sin(F.radians(lat)), F.cos(F.radians(lat))
    return [[-sl, cl, F.lit(0.0)], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]]


def camera_extents(boxes: DataFrame, n: int = 16, dem: bool = False) -> DataFrame:
    """Width and height of each box's border on the tangent plane of its centre, and the vertical extent of a view of
    it: the larger of the two, by 1.3 over elevations."""
    lon, lat = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    centre = boxes.select("k", lon.alias("clon"), lat.alias("clat"))
    p = border(boxes, n).join(centre, "k")
    at, mid = geocentric(F.col("lon"), F.col("lat"), F.lit(0.0)), geocentric(F.col("clon"), F.col("clat"), F.lit(0.0))
    east, north, _ = tangent_basis(F.col("clon"), F.col("clat"))
    on = lambda axis: sum(((a - m) * e for a, m, e in zip(at, mid, axis, strict=True)), F.lit(0.0))
    flat = p.select("k", on(east).alias("e"), on(north).alias("n"))
    size = flat.groupBy("k").agg((F.max("e") - F.min("e")).alias("width"), (F.max("n") - F.min("n")).alias("height"))
    return size.withColumn("vertical", F.greatest("width", "height") * (1.3 if dem else 1.0))


def on_plane(n: list[Column], lon: Column, lat: Column, clon: Column, clat: Column) -> list[Column]:
    """A direction (east, north, up at lon, lat) in the axes of the tangent plane at clon, clat."""
    here, there = tangent_basis(lon, lat), tangent_basis(clon, clat)
    world = [n[0] * here[0][i] + n[1] * here[1][i] + n[2] * here[2][i] for i in range(3)]
    return [world[0] * a[0] + world[1] * a[1] + world[2] * a[2] for a in there]


def report(ranges: DataFrame, box: tuple[float, float, float, float], target_gsd: float, dem: Column, skip_partial: Column, force_watertight: bool = False, tile: int = 256) -> DataFrame:
    """Ranges of levels (lod, x0, y0, x1, y1) with what a survey says of them: metres of a pixel, target, the position in
    their middle and the policies; pruning and partial tiles are of elevations only."""
    n = F.pow(F.lit(2.0), F.col("lod"))
    w, h = (box[2] - box[0]) / n, (box[3] - box[1]) / n
    said = [
        F.round(w / tile * (math.pi * 6378137.0 / 180), 6).alias("gsd"), F.lit(float(target_gsd)).alias("target_gsd"), F.round(box[0] + (F.col("x0") + F.col("x1") + 1) * w / 2, 9).alias("lon"), (F.round(box[3] - (F.col("y0") + F.col("y1") + 1) * h / 2, 9) + 0.0).alias("lat"),
        F.when(dem, F.lit(f"on (floor GSD {target_gsd:g} m)")).otherwise("off").alias("prune"), (dem & skip_partial).alias("skip_partial"), F.lit(force_watertight).alias("force_watertight"),
    ]
    return ranges.select("*", *said)


def level_bounds(ranges: DataFrame, root: int, last: int, box: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0), top: float = 85.0) -> DataFrame:
    """Levels root to last: the root's one tile, nothing up to the first level with data, and from there the ranges (lod, n,
    x0, x1, y0, y1) as they are; each with its extents in Mercator metres, latitudes held within `top`."""
    first = ranges.select(*[F.lit(v).cast(k).alias(c) for c, v, k in (("lod", root, "int"), ("n", 1, "long"), ("x0", 0, "int"), ("x1", 0, "int"), ("y0", 0, "int"), ("y1", 0, "int"))]).limit(1)
    levels = ranges.sparkSession.range(root, last + 1).select(F.col("id").cast("int").alias("lod"))
    j = levels.join(ranges.where(F.col("lod") > root).unionByName(first), "lod", "left")
    n = F.pow(F.lit(2.0), F.col("lod"))
    lon = lambda c: box[0] + c * ((box[2] - box[0]) / n)
    lat = lambda c: F.least(F.greatest(box[3] - c * ((box[3] - box[1]) / n), F.lit(-top)), F.lit(top))
    ends = {"xmin": mercator(lon(F.col("x0")), F.lit(0.0))[0], "xmax": mercator(lon(F.col("x1") + 1), F.lit(0.0))[0], "ymin": mercator(F.lit(0.0), lat(F.col("y1") + 1))[1], "ymax": mercator(F.lit(0.0), lat(F.col("y0")))[1]}
    return j.select("lod", F.coalesce("n", F.lit(0)).alias("n"), "x0", "x1", "y0", "y1", *[(F.round(v, 3) + 0.0).alias(k) for k, v in ends.items()])
