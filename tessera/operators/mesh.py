"""Meshes as tables: grid triangulation, areas, coverage and splitting by material."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import meta_flags, quad_area
from tessera.operators.pyramid import MESH, NAVTILE
from tessera.operators.raster import PIX, around, at

_CORNERS = [(0, 0), (1, 0), (0, 1), (1, 1)]


def quads(grid: DataFrame, shift: int = 6) -> DataFrame:
    """Places (px, py) with the valid corners c0..c3 of the quad that starts there (null where one is missing), and the
    block (bpx, bpy of 2^shift cells) that they are dealt by."""
    w = around(grid.where("z IS NOT NULL"), ["z"], _CORNERS, shift)
    return w.agg(*[at("z", *o).alias(f"c{i}") for i, o in enumerate(_CORNERS)])


def triangulate(grid: DataFrame) -> DataFrame:
    """Cells with four valid corners (px, py, c0..c3), each two triangles along the diagonal of c0 and c3."""
    return quads(grid).where("c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL").select(*PIX, "c0", "c1", "c2", "c3")


def node_aggregates(grid: DataFrame, index: DataFrame, shift: int) -> DataFrame:
    """The nodes of an index level (x, y, flags) over their samples, 2^shift + 1 to a side, of which the last row and
    column are the next node's first: bits of geometry, navtile and watertight; lowest, highest and mean height; area and
    number of the triangles of its quads (two, one where a corner is missing); texel size by the texture of 256 x 256 that
    the triangles cover; whole navigation heights around the range.

    A node without triangles has no geometry and no navtile, and no figures. Nodes are summed inside the blocks that the
    quads are dealt by, so there is one shuffle of the samples."""
    side, c = 1 << shift, [F.col(f"c{i}") for i in range(4)]
    last = lambda a: F.col(a).bitwiseAND(side - 1) == side - 1
    own = [c[0], F.when(last("px"), c[1]), F.when(last("py"), c[2]), F.when(last("px") & last("py"), c[3])]
    n = sum((x.isNotNull().cast("int") for x in c), F.lit(0))
    rows = quads(grid, max(6, shift)).withColumn("area", F.when(n >= 3, F.round(quad_area(c), 3).cast("decimal(20,3)"))).withColumn("triangles", F.greatest(n - 2, F.lit(0)))
    g = rows.groupBy("bpx", "bpy", F.shiftright("px", shift).alias("x"), F.shiftright("py", shift).alias("y"))
    heights = F.filter(F.array(*own), lambda e: e.isNotNull())
    total = F.aggregate(heights, F.lit(0).cast("decimal(20,4)"), lambda t, e: (t + e.cast("decimal(20,4)")).cast("decimal(20,4)"))
    found = g.agg(
        F.min(F.array_min(heights)).alias("z0"), F.max(F.array_max(heights)).alias("z1"), F.sum(total).alias("total"), F.sum(F.size(heights)).alias("n"),
        F.sum("area").cast("double").alias("area"), F.sum("triangles").alias("triangles"),
    ).drop("bpx", "bpy")
    j = index.select("x", "y", "flags").join(found, ["x", "y"], "left")
    has = (F.col("flags").bitwiseAND(MESH) != 0) & (F.coalesce("triangles", F.lit(0)) > 0)
    nav = has & (F.col("flags").bitwiseAND(NAVTILE) != 0)
    bits = meta_flags(F.col("flags"))
    # a small shift keeps means that end halfway between two roundings from depending on the order of sums
    mean = F.round((F.col("total") / F.col("n")).cast("double") + 1e-7, 3)
    return j.select(
        "x", "y", F.when(has, bits).otherwise(bits.bitwiseAND(~3)).alias("meta_flags"), *[F.when(has, F.col(k)).alias(k) for k in ("z0", "z1", "area", "triangles")],
        F.when(has, mean).alias("surrogate"), F.when(has, F.round(F.sqrt(F.col("area") / (F.col("triangles") * (65536 / (2 * side * side)))), 6)).alias("texel"),
        F.when(nav, F.floor("z0")).alias("nav0"), F.when(nav, F.ceil("z1")).alias("nav1"),
    )


def areas(cells: DataFrame, shift: int) -> DataFrame:
    """By node of 2^shift cells: triangles, area in space and in the plane. Areas are summed as decimals, so that the
    order of rows does not show."""
    each = F.round(quad_area([F.col(f"c{i}") for i in range(4)]), 3).cast("decimal(20,3)")
    g = cells.groupBy(F.shiftright("px", shift).alias("nx"), F.shiftright("py", shift).alias("ny"))
    return g.agg((F.count(F.lit(1)) * 2).alias("faces"), F.sum(each).cast("double").alias("area"), F.count(F.lit(1)).cast("double").alias("flat_area"))


def covered(triangles: DataFrame) -> DataFrame:
    """Pixels inside or on the edge of triangles (ax, ay, bx, by, cx, cy): those of each bounding box, by half planes."""
    box = triangles
    for c in "xy":
        ends = [F.floor(F.least(f"a{c}", f"b{c}", f"c{c}")).cast("int"), F.ceil(F.greatest(f"a{c}", f"b{c}", f"c{c}")).cast("int")]
        box = box.withColumn(f"p{c}", F.explode(F.sequence(*ends)))
    side = lambda a, b: (F.col(f"{b}x") - F.col(f"{a}x")) * (F.col("py") - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (F.col("px") - F.col(f"{a}x"))
    s = [side("a", "b"), side("b", "c"), side("c", "a")]
    inside = ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
    return box.where(inside).select("px", "py").distinct()


def split(faces: DataFrame) -> DataFrame:
    """Corners of faces (fid, corners array, material) with indices of their own in each material, from 1: fid, material,
    vertex, local. Distinct vertices are found before they are numbered."""
    corners = faces.select("fid", "material", F.explode("corners").alias("vertex"))
    numbered = corners.select("material", "vertex").distinct().withColumn("local", F.row_number().over(Window.partitionBy("material").orderBy("vertex")))
    return corners.join(numbered, ["material", "vertex"]).select("fid", "material", "vertex", "local")
