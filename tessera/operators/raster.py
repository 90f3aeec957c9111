"""Neighbourhood and resampling operators over pixel tables (px, py, z), block by block with a halo."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

PIX = ["px", "py"]
_RING = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_CROSS = {"l": (-1, 0), "r": (1, 0), "u": (0, -1), "d": (0, 1)}


def cells(pixels: DataFrame) -> DataFrame:
    """One row per pixel: highest z (null where no sample has data), mask of any."""
    return pixels.groupBy(*PIX).agg(F.max("z").alias("z"), F.max("mask").alias("mask"))


def around(grid: DataFrame, values: list[str], ring: list[tuple[int, int]] = _RING, shift: int = 6) -> GroupedData:
    """The windows of all places that have a cell in their ring, as groups (px, py: the centre) of rows dx, dy, values.

    The table is dealt once, by blocks of 2^shift cells to a side; a cell goes to a block beside its own only where it is
    in the halo of that, so that little more than the table itself is shuffled. Windows are spread and grouped inside
    the block, by its partitioning."""
    spread = grid.select(*PIX, *values)
    for i, c in enumerate(PIX):
        low, high = min(o[i] for o in ring), max(o[i] for o in ring)
        spread = spread.withColumn(f"b{c}", F.explode(F.sequence(F.shiftright(F.col(c) - high, shift), F.shiftright(F.col(c) - low, shift))))
    dealt = spread.repartition("bpx", "bpy")
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ring])
    rows = dealt.select("bpx", "bpy", *PIX, *values, F.explode(offsets).alias("o"))
    rows = rows.select("bpx", "bpy", (F.col("px") - F.col("o.dx")).alias("px"), (F.col("py") - F.col("o.dy")).alias("py"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), *values)
    return rows.where((F.shiftright("px", shift) == F.col("bpx")) & (F.shiftright("py", shift) == F.col("bpy"))).groupBy("bpx", "bpy", *PIX)


def at(value: str, dx: int, dy: int) -> Column:
    return F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(value)))


def beside(value: str) -> Column:
    """The value of the cells of a window but its centre; null there."""
    return F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.col(value))


def _mean(value: Column) -> Column:
    return F.avg(value.cast("decimal(20,4)")).cast("double")


def fill_holes(grid: DataFrame) -> DataFrame:
    """Cells with mask but no z take the mean of the valid ones among their eight neighbours; none: stay null."""
    w = around(grid, ["z", "mask"]).agg(at("z", 0, 0).alias("own"), at("mask", 0, 0).alias("mask"), F.round(_mean(beside("z")), 3).alias("z"))
    return w.where("own IS NULL AND mask > 0").select(*PIX, "z")


def fill_ranges(grid: DataFrame) -> DataFrame:
    """As fill_holes for cells of value, lowest and highest (v, lo, hi, mask): mean of values, lowest of lowest, highest
    of highest."""
    w = around(grid, ["v", "lo", "hi", "mask"]).agg(at("v", 0, 0).alias("own"), at("mask", 0, 0).alias("mask"), F.round(_mean(beside("v")), 3).alias("v"), F.min(beside("lo")).alias("lo"), F.max(beside("hi")).alias("hi"))
    return w.where("own IS NULL AND mask > 0").select(*PIX, "v", "lo", "hi")


def erode(grid: DataFrame) -> DataFrame:
    """A masked cell stays where all of the 3 x 3 cells that are in the table are masked."""
    w = around(grid, ["mask"]).agg(at("mask", 0, 0).alias("own"), F.min("mask").alias("mask"))
    return w.where("own > 0").select(*PIX, "mask")


def dilate(grid: DataFrame, reach: int = 1) -> DataFrame:
    """Places within `reach` cells, by rows and columns, of a masked cell."""
    ring = [(dx, dy) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    return around(grid.where("mask > 0"), ["mask"], ring).agg(F.max("mask").alias("mask")).select(*PIX, "mask")


def coverage(grid: DataFrame) -> DataFrame:
    """Cells whose whole 3 x 3 window is present and masked."""
    return around(grid, ["mask"]).agg(F.min("mask").alias("low"), F.count(F.lit(1)).alias("n")).where("low > 0 AND n = 9").select(*PIX)


def relief(grid: DataFrame, scale: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Over complete 3 x 3 windows: slope and aspect by Horn's weights, hillshade (1 to 255) under a light, roughness,
    position index, ruggedness. Cells at the border of the data have none: a tile of 256 takes 258 x 258 samples."""
    w = around(grid.where("z IS NOT NULL"), ["z"]).agg(*[at("z", dx, dy).alias(f"v{i}") for i, (dx, dy) in enumerate(_RING)], F.count(F.lit(1)).alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi")).where("n = 9")
    v = [F.col(f"v{i}") for i in range(9)]
    gx = ((v[2] + 2 * v[5] + v[8]) - (v[0] + 2 * v[3] + v[6])) / (8 * scale)
    gy = ((v[6] + 2 * v[7] + v[8]) - (v[0] + 2 * v[1] + v[2])) / (8 * scale)
    ring = [v[i] for i in range(9) if i != 4]
    total, rough = ring[0], F.lit(0.0)
    for x in ring[1:]:
        total = total + x
    for x in ring:
        rough = rough + F.abs(x - v[4])
    steep = gx * gx + gy * gy
    # the light's height and its direction against that of the slope
    az, up = math.radians(azimuth), math.radians(altitude)
    shade = (math.sin(up) - math.cos(up) * F.sqrt(steep) * F.sin(F.atan2(gy, -gx) - az)) / F.sqrt(1 + steep)
    return w.select(
        *PIX, F.round(F.degrees(F.atan(F.sqrt(steep))), 6).alias("slope"), F.round(F.degrees(F.atan2(gy, -gx)), 6).alias("aspect"),
        F.round(F.when(shade <= 0, 1.0).otherwise(1 + 254 * shade), 4).alias("hillshade"), F.round(F.col("hi") - F.col("lo"), 6).alias("roughness"),
        F.round(v[4] - total / 8, 6).alias("tpi"), F.round(rough / 8, 6).alias("tri"),
    )


def color_relief(z: Column, ramp: list[tuple[float, tuple[int, int, int]]]) -> list[Column]:
    """Red, green and blue of an elevation by a ramp (elevation, colour), between its entries by proportion; the ends'
    colours beyond them."""
    ramp = sorted(ramp)
    out = []
    for c in range(3):
        value = F.lit(float(ramp[0][1][c]))
        for (a, low), (b, high) in zip(ramp[:-1], ramp[1:], strict=True):
            value = F.when(z >= a, low[c] + (z - a) * ((high[c] - low[c]) / (b - a))).otherwise(value) if b > a else value
        value = F.when(z >= ramp[-1][0], float(ramp[-1][1][c])).otherwise(value)
        out.append(F.when(z.isNotNull(), F.floor(value + 0.5).cast("int")))
    return out


def _cross(grid: DataFrame, value: str, kept: list[str]) -> DataFrame:
    """px, py, the four neighbours l, r, u, d of places that have all, and the centre's `kept`."""
    named = [at(value, *o).alias(c) for c, o in _CROSS.items()]
    n = F.count(beside(value)).alias("n")
    return around(grid, [value, *kept], [(0, 0), *_CROSS.values()]).agg(*named, n, *[at(k, 0, 0).alias(k) for k in kept]).where("n = 4")


def _unit(gx: Column, gy: Column, flat: Column) -> list[Column]:
    length = F.sqrt(gx * gx + gy * gy + 1)
    lie = F.coalesce(flat, F.lit(False))
    return [F.when(lie, 0.0).otherwise(-gx / length), F.when(lie, 0.0).otherwise(-gy / length), F.when(lie, 1.0).otherwise(1 / length)]


def gradients(grid: DataFrame, scale: float = 1.0, z_factor: float = 1.0, flat: str | None = None, value: str = "z") -> DataFrame:
    """Unit normals from the four-neighbour gradient (Zevenbergen and Thorne), where all four are valid. Cells whose
    boolean `flat` is set have the upright normal; a negative z_factor inverts the relief."""
    w = _cross(grid.where(F.col(value).isNotNull()), value, [flat] if flat else [])
    gx, gy = (F.col("r") - F.col("l")) * z_factor / (2 * scale), (F.col("d") - F.col("u")) * z_factor / (2 * scale)
    n = _unit(gx, gy, F.col(flat) if flat else F.lit(False))
    return w.select(*PIX, *[(F.round(c, 6) + 0.0).alias(a) for c, a in zip(n, ("nx", "ny", "nz"), strict=True)])


def octahedral(n: list[Column]) -> tuple[Column, Column]:
    """Bytes of a unit normal in the octahedral code: the sphere unfolded onto a square."""
    total = F.abs(n[0]) + F.abs(n[1]) + F.abs(n[2])
    x, y = n[0] / total, n[1] / total
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    u = F.when(n[2] >= 0, x).otherwise((1 - F.abs(y)) * sign(x))
    v = F.when(n[2] >= 0, y).otherwise((1 - F.abs(x)) * sign(y))
    return tuple(F.floor((c * 0.5 + 0.5) * 255 + 0.5).cast("int") for c in (u, v))


def resample(pixels: DataFrame, shift: int) -> DataFrame:
    """The block methods of the resampling family (interpolate() has the others) over blocks of 2^shift pixels: average,
    mode, lowest, highest, median, quartiles, nearest (the sample nearest to the block's centre, ties to the lower row
    and column). One sorted map of values gives all three quantiles."""
    half = (1 << shift) / 2 - 0.5
    fx, fy = F.col("px").bitwiseAND((1 << shift) - 1), F.col("py").bitwiseAND((1 << shift) - 1)
    d = (fx - half) * (fx - half) + (fy - half) * (fy - half)
    valid = pixels.where("z IS NOT NULL")
    out = valid.groupBy(F.shiftright("px", shift).alias("tx"), F.shiftright("py", shift).alias("ty")).agg(
        F.round(_mean(F.col("z")), 3).alias("average"), F.mode(F.col("l_suppkey"), True).alias("mode"), F.min("z").alias("minimum"), F.max("z").alias("maximum"),
        F.percentile("z", [0.5, 0.25, 0.75]).alias("q"), F.min(F.struct(d.alias("d"), F.col("py"), F.col("px"), F.col("z"))).getField("z").alias("nearest"),
    )
    quarters = [F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("median", "q1", "q3"))]
    return out.select("tx", "ty", "average", "mode", "minimum", "maximum", *quarters, "nearest")


def _cubic(t: Column, a: float) -> Column:
    t = F.abs(t)
    return F.when(t < 1, (a + 2) * t * t * t - (a + 3) * t * t + 1).when(t < 2, a * (t * t * t - 5 * t * t + 8 * t - 4)).otherwise(0.0)


def _spline(t: Column) -> Column:
    t = F.abs(t)
    return F.when(t < 1, 2 / 3 - t * t + t * t * t / 2).when(t < 2, (2 - t) * (2 - t) * (2 - t) / 6).otherwise(0.0)


def _lanczos(t: Column) -> Column:
    u = t * math.pi
    return F.when(F.abs(t) < 1e-9, 1.0).when(F.abs(t) < 3, 3 * F.sin(u) * F.sin(u / 3) / (u * u)).otherwise(0.0)


#: Interpolating kernels of one axis: half width in cells, weight at a distance.
KERNELS = {"bilinear": (1, lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t))), "cubic": (2, lambda t: _cubic(t, -0.5)), "cubicspline": (2, _spline), "lanczos": (3, _lanczos)}


def interpolate(grid: DataFrame, scale: float, method: str, heavy: float = 2.0, shift: int = 6) -> DataFrame:
    """The interpolating methods of the resampling family: px, py, z of the grid's cells (one row a cell) at `scale`
    source cells to a target cell, as sums of neighbours by weight over the sum of weights.

    Where the target is coarser the kernel is widened by the scale. Missing cells have no weight; targets without
    weight, or whose centre is in a missing cell, vanish. texture and dem are average (of the cells whose centres fall in
    the target) from a scale of `heavy` (the reference gives no number), else cubic and cubicspline.
    """
    if method in ("texture", "dem"):
        method = "average" if scale >= heavy else "cubic" if method == "texture" else "cubicspline"
    if scale <= 0 or method not in (*KERNELS, "average"):
        raise ValueError(f"no such resampling: {method} at scale {scale}")
    valid = grid.where("z IS NOT NULL")
    centre = lambda c: (F.col(c) + 0.5) / scale
    if method == "average":
        return valid.groupBy(F.floor(centre("px")).cast("int").alias("px"), F.floor(centre("py")).cast("int").alias("py")).agg(F.avg("z").alias("z"))
    half, weight = KERNELS[method]
    wide = max(scale, 1.0)
    reach = half * wide / scale
    first, last = (lambda c: F.ceil(centre(c) - reach - 0.5).cast("int")), (lambda c: F.floor(centre(c) + reach - 0.5).cast("int"))
    # dealt by blocks of targets, to which only cells in the halo are copied, and spread to their targets there
    dealt = valid.select(F.col("px").alias("sx"), F.col("py").alias("sy"), "z", *[f(c).alias(f"{n}{c}") for c in PIX for f, n in ((first, "first"), (last, "last"))])
    for c in PIX:
        dealt = dealt.withColumn(f"b{c}", F.explode(F.sequence(F.shiftright(f"first{c}", shift), F.shiftright(f"last{c}", shift))))
    sent = dealt.repartition("bpx", "bpy")
    for c in PIX:
        inside = F.sequence(F.greatest(f"first{c}", F.shiftleft(f"b{c}", shift)), F.least(f"last{c}", F.shiftleft(F.col(f"b{c}") + 1, shift) - 1))
        sent = sent.withColumn(c, F.explode(inside))
    away = lambda c, s: ((F.col(c) + 0.5) * scale - (F.col(s) + 0.5)) / wide
    w = weight(away("px", "sx")) * weight(away("py", "sy"))
    inside = (F.floor((F.col("px") + 0.5) * scale) == F.col("sx")) & (F.floor((F.col("py") + 0.5) * scale) == F.col("sy"))
    sums = sent.withColumn("w", w).groupBy("bpx", "bpy", "px", "py").agg(F.sum(F.col("w") * F.col("z")).alias("v"), F.sum("w").alias("w"), F.max(inside).alias("inside"))
    return sums.where("inside AND abs(w) > 1e-9").select("px", "py", (F.col("v") / F.col("w")).alias("z"))


def overview_sizes(width: int, height: int, least: int = 2) -> list[tuple[int, int]]:
    """Sizes of overview levels: halves, rounded away from zero, until a side is below `least`; a level with a side
    equal to it is the last."""
    out = []
    while True:
        width, height = int(width / 2 + 0.5), int(height / 2 + 0.5)
        if width < least or height < least:
            return out
        out.append((width, height))
        if width == least or height == least:
            return out


def overview_step(grid: DataFrame, value: str = "z") -> DataFrame:
    """The next overview level: mean of the valid cells of each 2 x 2 block; empty blocks vanish."""
    agg = grid.where(F.col(value).isNotNull()).groupBy(F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py"))
    return agg.agg(F.round(F.avg(F.col(value).cast("decimal(20,4)")).cast("double"), 3).alias(value))


def zip_ranges(ranges: DataFrame, value: DataFrame) -> DataFrame:
    """Pixel-aligned join of lowest and highest (lo, hi) with value (v): a missing value is the middle, and is clamped
    between."""
    j = ranges.join(value, PIX, "left")
    v = F.coalesce("v", (F.col("lo") + F.col("hi")) / 2)
    return j.select(*PIX, F.greatest("lo", F.least("hi", v)).alias("v"), "lo", "hi")


def lattice_cells(nodes: DataFrame) -> DataFrame:
    """The cells of a lattice (i, j, v): i, j of the lower corner and the corners' values v00, v10, v01, v11 (null where a
    node is missing or has no value). Each node is sent to the four cells that it is a corner of, and cells are grouped
    once."""
    corners = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, 1) for dx in (0, 1)])
    sent = nodes.select("i", "j", "v", F.explode(corners).alias("c")).select((F.col("i") - F.col("c.dx")).alias("i"), (F.col("j") - F.col("c.dy")).alias("j"), F.col("c.dx").alias("dx"), F.col("c.dy").alias("dy"), "v")
    return sent.groupBy("i", "j").agg(*[at("v", dx, dy).alias(f"v{dx}{dy}") for dy in (0, 1) for dx in (0, 1)])


def bilinear(points: DataFrame, nodes: DataFrame, size: tuple[int, int], most: int = 200_000) -> DataFrame:
    """points (fx, fy in cells of a lattice of size[0] x size[1] cells) with v: its value (nodes i, j, v) by the four
    corners; where a corner has none, that of the nearest node that has one (ties to the lower row, then column). Points
    beyond the lattice are moved to its edge.

    The lattice's cells are joined once: broadcast where they are at most `most`, else by a shuffle. The few points
    without four corners meet the valid nodes, which is a lattice of a fixed size against those points."""
    held = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(n)))
    out = points.withColumn("_x", held("fx", size[0])).withColumn("_y", held("fy", size[1]))
    out = out.withColumn("_i", F.least(F.floor("_x"), F.lit(size[0] - 1)).cast("int")).withColumn("_j", F.least(F.floor("_y"), F.lit(size[1] - 1)).cast("int"))
    cell = lattice_cells(nodes).select(F.col("i").alias("_i"), F.col("j").alias("_j"), *[F.col(f"v{c}").alias(f"_v{c}") for c in ("00", "10", "01", "11")])
    cell = F.broadcast(cell) if (size[0] + 1) * (size[1] + 1) <= most else cell
    tx, ty = F.col("_x") - F.col("_i"), F.col("_y") - F.col("_j")
    v = F.col("_v00") * (1 - tx) * (1 - ty) + F.col("_v10") * tx * (1 - ty) + F.col("_v01") * (1 - tx) * ty + F.col("_v11") * tx * ty
    j = out.join(cell, ["_i", "_j"], "left").withColumn("_v", v)
    # all valid nodes as one array: a lattice is of a fixed size, and its bound is checked here
    if (size[0] + 1) * (size[1] + 1) > most:
        raise ValueError(f"a lattice of {size} is too large for a search of its nearest node")
    valid = nodes.where("v IS NOT NULL").agg(F.collect_list(F.struct("j", "i", "v")).alias("_nodes"))
    j = j.join(F.broadcast(valid), F.lit(True))
    d = lambda e: (e["i"] - F.col("_x")) * (e["i"] - F.col("_x")) + (e["j"] - F.col("_y")) * (e["j"] - F.col("_y"))
    best = F.array_min(F.transform("_nodes", lambda e: F.struct(d(e).alias("d"), e["j"].alias("j"), e["i"].alias("i"), e["v"].alias("v"))))
    return j.select(*points.columns, F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(best["v"]).alias("v"))


def lattice_range(boxes: DataFrame, nodes: DataFrame, size: tuple[int, int]) -> DataFrame:
    """k, lo, hi of boxes (k, x0, y0, x1, y1 in cells of a lattice): over the values at their four corners and of the nodes
    inside them. Boxes reach the nodes by their whole numbers, at most those of the lattice."""
    corners = F.array(*[F.struct(F.col(x).cast("double").alias("fx"), F.col(y).cast("double").alias("fy")) for x in ("x0", "x1") for y in ("y0", "y1")])
    at_corners = bilinear(boxes.select("k", F.explode(corners).alias("c")).select("k", "c.fx", "c.fy"), nodes, size).select("k", "v")
    span = lambda a, b, n: F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: (i >= F.col(a)) & (i <= F.col(b)))
    inside = boxes.select("k", F.explode(span("x0", "x1", size[0])).alias("i"), "y0", "y1").select("k", "i", F.explode(span("y0", "y1", size[1])).alias("j"))
    small = nodes.where("v IS NOT NULL").select("i", "j", "v")
    inner = inside.join(F.broadcast(small), ["i", "j"]).select("k", "v")
    return at_corners.unionByName(inner).groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
