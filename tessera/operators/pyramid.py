"""Leaf reduction, the mip pyramid, index algebra, policies, diffs and checks over (lod, x, y) tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = ["lod", "x", "y"]
#: Fixed bits of tile flags.
MESH, WATERTIGHT, ATLAS, NAVTILE, ALIEN, MULTIMESH = 1, 2, 4, 8, 0x20, 0x40
VALID_Z = -1e6


def leaves(pixels: DataFrame, lod: int, shift: int, force_watertight: bool = False) -> DataFrame:
    """One row per leaf tile with data: exists where any mask pixel is set and a valid elevation is there; watertight
    where all mask pixels are set (or forced); lowest and highest elevation. Pixels without data vanish."""
    x, y = F.shiftright("px", shift).alias("x"), F.shiftright("py", shift).alias("y")
    good = F.when(F.col("z") >= VALID_Z, F.col("z"))
    full = F.lit(True) if force_watertight else F.min("mask") == 255
    agg = pixels.groupBy(x, y).agg(F.max("mask").alias("mask_max"), full.alias("watertight"), F.min(good).alias("min_z"), F.max(good).alias("max_z"))
    return agg.where("mask_max > 0 AND min_z IS NOT NULL").select(F.lit(lod).alias("lod"), "x", "y", "watertight", "min_z", "max_z")


def _expected(area: tuple[int, int, int, int] | None, s: Column) -> Column:
    """How many of the 4^s cells of a tile, s levels below it, lie in an inclusive box of them (all without one)."""
    if area is None:
        return F.pow(F.lit(4.0), s).cast("long")
    side = F.call_function("shiftleft", F.lit(1), s)
    width = [F.least(F.lit(area[i + 2]), (F.col(c) + 1) * side - 1) - F.greatest(F.lit(area[i]), F.col(c) * side) + 1 for i, c in enumerate("xy")]
    return (F.greatest(width[0], F.lit(0)) * F.greatest(width[1], F.lit(0))).cast("long")


def pyramid(leaf: DataFrame, lod: int, top: int = 0, area: tuple[int, int, int, int] | None = None, force_watertight: bool = False) -> DataFrame:
    """All levels from lod up to top: lowest and highest elevation, and watertight where every leaf below that can be
    there is there and watertight: all 4^k, or those inside an inclusive box of leaves (x0, y0, x1, y1) where the
    resource's area is constrained to it.

    Each leaf row is exploded to its ancestors before one aggregation, whose map-side part collapses them: a level
    holds a quarter of the rows of the one below, so the shuffle carries about 4/3 of the leaves.
    """
    up = F.explode(F.sequence(F.lit(0), F.lit(lod - top))).alias("s")
    rows = leaf.select("x", "y", "watertight", "min_z", "max_z", up)
    rows = rows.select((F.lit(lod) - F.col("s")).alias("lod"), F.expr("shiftright(x, s)").alias("x"), F.expr("shiftright(y, s)").alias("y"), "watertight", "min_z", "max_z")
    agg = rows.groupBy(*TILE).agg(F.bool_and("watertight").alias("w"), F.count(F.lit(1)).alias("n"), F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"))
    whole = F.lit(True) if force_watertight else F.col("w") & (F.col("n") >= _expected(area, F.lit(lod) - F.col("lod")))
    return agg.select(*TILE, whole.alias("watertight"), F.col("n").alias("n_leaves"), "min_z", "max_z")


def mip_step(level: DataFrame, area: tuple[int, int, int, int] | None = None) -> DataFrame:
    """One level up, for pyramids too deep to explode: the same rule over four children, or over those that meet the
    inclusive box `area` of the children's level."""
    up = level.select((F.col("lod") - 1).alias("lod"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), "watertight", "n_leaves", "min_z", "max_z")
    agg = up.groupBy(*TILE).agg(F.bool_and("watertight").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("n_leaves"), F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"))
    return agg.select(*TILE, (F.col("w") & (F.col("n") >= _expected(area, F.lit(1)))).alias("watertight"), "n_leaves", "min_z", "max_z")


def mip_steps(leaf: DataFrame, lod: int, lod_min: int = 0, root: int = 0, area: tuple[int, int, int, int] | None = None) -> DataFrame:
    """All levels by steps, from lod down to the higher of the resource's lowest level and the node's own."""
    level = leaf.withColumn("n_leaves", F.lit(1).cast("long")).select(*TILE, "watertight", "n_leaves", "min_z", "max_z")
    out = level
    for _ in range(lod - max(lod_min, root)):
        level = mip_step(level, area)
        area = area and tuple(c >> 1 for c in area)
        out = out.unionByName(level)
    return out


def flags(df: DataFrame, navtile: Column | None = None) -> DataFrame:
    """Tile index of a pyramid: mesh for each tile, watertight and navtile by condition."""
    out = F.lit(MESH).bitwiseOR(F.when(F.col("watertight"), WATERTIGHT).otherwise(0))
    if navtile is not None:
        out = out.bitwiseOR(F.when(navtile, NAVTILE).otherwise(0))
    return df.select(*TILE, out.alias("flags"))


def combine(index: DataFrame, other: DataFrame, lods: tuple[int, int]) -> DataFrame:
    """Inside the range of levels: tiles in both, flags or-ed; outside: index as it is."""
    inside = F.col("lod").between(*lods)
    both = index.where(inside).join(other.select(*TILE, F.col("flags").alias("_f")), TILE)
    return both.select(*TILE, F.col("flags").bitwiseOR(F.col("_f")).alias("flags")).unionByName(index.where(~inside))


def stamp(spark, ranges: list[tuple[int, int, int, int, int]], default: int) -> DataFrame:
    """Index with `default` flags for all tiles of inclusive ranges (lod, x0, y0, x1, y1), each once."""
    df = spark.createDataFrame(ranges, "lod int, x0 int, y0 int, x1 int, y1 int")
    df = df.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return df.select(*TILE, F.lit(default).alias("flags")).distinct()


def broaden(index: DataFrame, to: int) -> DataFrame:
    """Copies the deepest level down to level `to`, watertight cleared."""
    deep = index.agg(F.max("lod").alias("deep"))
    last = index.join(F.broadcast(deep), F.col("lod") == F.col("deep")).where(F.col("deep") < to)
    k = F.explode(F.sequence(F.lit(1), F.lit(to) - F.col("deep"))).alias("k")
    down = last.select("deep", "x", "y", "flags", k)
    for c in "xy":
        ends = F.sequence(F.expr(f"shiftleft({c}, k)"), F.expr(f"shiftleft({c} + 1, k) - 1"))
        down = down.withColumn(c, F.explode(ends))
    down = down.select((F.col("deep") + F.col("k")).alias("lod"), "x", "y", F.col("flags").bitwiseAND(~WATERTIGHT).alias("flags"))
    return index.unionByName(down)


def mask_tree(index: DataFrame, mask: DataFrame) -> DataFrame:
    """black: tiles go; gray: watertight is cleared; white or absent: unchanged. mask: lod, x, y, state."""
    joined = index.join(mask, TILE, "left").where("state IS NULL OR state <> 'black'")
    return joined.select(*TILE, F.when(F.col("state") == "gray", F.col("flags").bitwiseAND(~WATERTIGHT)).otherwise(F.col("flags")).alias("flags"))


def ancestors(index: DataFrame) -> DataFrame:
    """All tiles that are, or lie above, a flagged tile."""
    up = index.where("flags <> 0").select("lod", "x", "y", F.explode(F.sequence(F.lit(0), F.col("lod"))).alias("s"))
    return up.select((F.col("lod") - F.col("s")).alias("lod"), F.expr("shiftright(x, s)").alias("x"), F.expr("shiftright(y, s)").alias("y")).distinct()


def crop(index: DataFrame, lod: int, x: int, y: int) -> DataFrame:
    """The subtree below a tile, re-rooted at it."""
    k = F.col("lod") - lod
    below = index.where((F.col("lod") >= lod) & (F.expr(f"shiftright(x, lod - {lod})") == x) & (F.expr(f"shiftright(y, lod - {lod})") == y))
    return below.select(k.alias("lod"), (F.col("x") - F.expr(f"shiftleft({x}, lod - {lod})")).alias("x"), (F.col("y") - F.expr(f"shiftleft({y}, lod - {lod})")).alias("y"), "flags")


def prune(tiles: DataFrame, floor_depth: Column) -> DataFrame:
    """Drops a tile (below the root) where all four positions of its parent are deeper than their own floor depth,
    whether they are present or not. floor_depth: an expression over lod, x, y."""
    parents = tiles.where("lod > 0").select("lod", F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py")).distinct()
    spots = parents.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    spots = spots.select("lod", "px", "py", (F.col("px") * 2 + F.col("i").bitwiseAND(1)).alias("x"), (F.col("py") * 2 + F.shiftright("i", 1)).alias("y"))
    gone = spots.groupBy("lod", "px", "py").agg(F.bool_and(F.col("lod") > floor_depth).alias("gone")).where("gone")
    keyed = tiles.withColumn("px", F.shiftright("x", 1)).withColumn("py", F.shiftright("y", 1))
    return keyed.join(gone.drop("gone"), ["lod", "px", "py"], "left_anti").select(*tiles.columns)


def skip_partial(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(served tiles: the watertight ones, tiles whose payload stays: those at or above a served tile)."""
    served = tiles.where("watertight")
    reach = ancestors(served.select(*TILE, F.lit(MESH).alias("flags")))
    return served, tiles.join(reach, TILE, "left_semi")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles whose flags differ: lod, x, y, from_flags, to_flags; an absent tile has flags 0."""
    joined = a.select(*TILE, F.col("flags").alias("f")).join(b.select(*TILE, F.col("flags").alias("t")), TILE, "full_outer")
    out = joined.select(*TILE, F.coalesce("f", F.lit(0)).alias("from_flags"), F.coalesce("t", F.lit(0)).alias("to_flags"))
    return out.where("from_flags <> to_flags")


def transitions(a: DataFrame, b: DataFrame) -> DataFrame:
    return diff(a, b).groupBy("lod", "from_flags", "to_flags").agg(F.count(F.lit(1)).alias("n"))


def examples(d: DataFrame, n: int = 10) -> DataFrame:
    """The first n differences of each level."""
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("lod").orderBy("y", "x"))).where(F.col("rank") <= n)


#: What a pair can break, in the order of check_pair().
VIOLATIONS = ["unreachable payload", "payload without parent", "parent does not contain child", "tile without payload", "watertight with some children"]


def check_pair(index: DataFrame, store: DataFrame) -> DataFrame:
    """Violations of an index (flags) and its store (min_z, max_z): kind, lod, x, y. None for a sound pair.

    All that says something of a tile is sent to it (its own row of either side, the tiles above a flagged one, a count
    of its flagged children, the range of its parent) and meets in one aggregation."""
    real = index.where("flags <> 0")
    none = lambda kind: F.lit(None).cast(kind)

    def said(df: DataFrame, lod: Column, x: Column, y: Column, **what: Column) -> DataFrame:
        kinds = {"flags": "int", "min_z": "double", "max_z": "double", "pmin": "double", "pmax": "double", "n": "long", "reach": "boolean"}
        return df.select(lod.cast("int").alias("lod"), x.cast("int").alias("x"), y.cast("int").alias("y"), *[what.get(c, none(k)).cast(k).alias(c) for c, k in kinds.items()])

    lod, x, y = F.col("lod"), F.col("x"), F.col("y")
    above = real.select("x", "y", "lod", F.explode(F.sequence(F.lit(0), lod)).alias("s"))
    child = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    below = store.select(*TILE, "min_z", "max_z", child)
    rows = [
        said(real, lod, x, y, flags=F.col("flags")),
        said(store, lod, x, y, min_z=F.col("min_z"), max_z=F.col("max_z")),
        said(above, lod - F.col("s"), F.expr("shiftright(x, s)"), F.expr("shiftright(y, s)"), reach=F.lit(True)),
        said(real.where("lod > 0"), lod - 1, F.shiftright("x", 1), F.shiftright("y", 1), n=F.lit(1)),
        said(below, lod + 1, x * 2 + F.col("c.i"), y * 2 + F.col("c.j"), pmin=F.col("min_z"), pmax=F.col("max_z")),
    ]
    tile = reduce(DataFrame.unionByName, rows).groupBy(*TILE).agg(*[F.max(c).alias(c) for c in ("flags", "min_z", "max_z", "pmin", "pmax", "reach")], F.sum("n").alias("n"))
    held = F.col("min_z").isNotNull()
    wrong = [
        held & F.col("reach").isNull(), held & (lod > 0) & F.col("pmin").isNull(), held & ((F.col("min_z") < F.col("pmin")) | (F.col("max_z") > F.col("pmax"))),
        F.col("flags").isNotNull() & ~held, (F.col("flags").bitwiseAND(WATERTIGHT) != 0) & F.col("n").between(1, 3),
    ]
    kinds = F.array_compact(F.array(*[F.when(w, k) for w, k in zip(wrong, VIOLATIONS, strict=True)]))
    return tile.select(F.explode(kinds).alias("kind"), *TILE)


def serve(index: DataFrame, store: DataFrame) -> DataFrame:
    """Payload of each reachable node with its flags (0: structural); a reachable node without payload fails."""
    reach = ancestors(index)
    rows = reach.join(index, TILE, "left").join(store, TILE, "left")
    z = F.when(F.col("min_z").isNull(), F.raise_error(F.concat(F.lit("no payload at "), F.concat_ws("-", *TILE)))).otherwise(F.col("min_z"))
    return rows.select(*TILE, F.coalesce("flags", F.lit(0)).alias("flags"), z.cast("double").alias("min_z"), "max_z")


def metatiles(index: DataFrame, order: int = 5) -> DataFrame:
    """Blocks of 2^order x 2^order nodes: their nodes in row order and how many there are."""
    m = ~((1 << order) - 1)
    keyed = index.select("lod", F.col("x").bitwiseAND(m).alias("bx"), F.col("y").bitwiseAND(m).alias("by"), "x", "y", "flags")
    return keyed.groupBy("lod", "bx", "by").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("y", "x", "flags"))).alias("nodes"))


def availability(index: DataFrame) -> DataFrame:
    """Cells of 256 x 256 grids: 0x80 for a tile, 0xc0 for a watertight one."""
    value = F.when(F.col("flags").bitwiseAND(WATERTIGHT) != 0, 0xC0).otherwise(0x80)
    return index.where(F.col("flags").bitwiseAND(MESH) != 0).select("lod", F.shiftright("x", 8).alias("gx"), F.shiftright("y", 8).alias("gy"), (F.col("y").bitwiseAND(255) * 256 + F.col("x").bitwiseAND(255)).alias("cell"), value.alias("value"))


def in_ranges(lod: Column, x: Column, y: Column, lods: tuple[int, int], box: tuple[int, int, int, int]) -> Column:
    """Level in range, and the ancestor at the lowest level inside an inclusive box (x0, y0, x1, y1)."""
    up = F.greatest(lod - lods[0], F.lit(0))
    ax, ay = F.call_function("shiftright", x, up), F.call_function("shiftright", y, up)
    return lod.between(*lods) & ax.between(box[0], box[2]) & ay.between(box[1], box[3])


def uniform_quads(cells: DataFrame, order: int, value: str = "flags") -> DataFrame:
    """The quadtree of pages of 2^order x 2^order cells (x, y, value) with uniform quadrants collapsed: s (cells to a
    side as a power of two), x, y at that size, value. A quadrant is uniform where all its cells are there and equal;
    only the largest are kept. One explosion to the sizes and one aggregation; no quadrant is collected."""
    up = cells.select("x", "y", F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(order))).alias("s"))
    up = up.select("s", F.expr("shiftright(x, s)").alias("x"), F.expr("shiftright(y, s)").alias("y"), "v")
    whole = up.groupBy("s", "x", "y").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    even = whole.where((F.col("lo") == F.col("hi")) & (F.col("n") == F.pow(F.lit(4.0), "s").cast("long"))).select("s", "x", "y", F.col("lo").alias(value))
    above = even.where("s > 0").select(F.explode(F.array(*[F.struct((F.col("s") - 1).alias("s"), (F.col("x") * 2 + i % 2).alias("x"), (F.col("y") * 2 + i // 2).alias("y")) for i in range(4)])).alias("q")).select("q.*")
    return even.join(above, ["s", "x", "y"], "left_anti")


def siblings(index: DataFrame) -> DataFrame:
    """Each tile with how many of its parent's four children there are and whether all of those are watertight."""
    w = Window.partitionBy("lod", F.shiftright("x", 1), F.shiftright("y", 1))
    tight = F.col("flags").bitwiseAND(WATERTIGHT) != 0
    return index.select(*TILE, F.count(F.lit(1)).over(w).alias("n"), F.bool_and(tight).over(w).alias("all_watertight"))


def split_blocks(ranges: DataFrame, nodes: DataFrame, width: int, height: int) -> DataFrame:
    """Ranges (k, x0, y0, x1, y1) cut at the nodes (node, xa, ya, xb, yb: a grid of width x height) that they meet, with
    their place: the node of the first corner is 0, then its neighbours ring by ring, by rows and columns. Ranges reach
    nodes by the cells of the grid, with an equi-join."""
    cell = lambda c, n: F.expr(f"{c} div {n}")
    cells = ranges.withColumn("_i", F.explode(F.sequence(cell("x0", width), cell("x1", width)))).withColumn("_j", F.explode(F.sequence(cell("y0", height), cell("y1", height))))
    grid = nodes.withColumn("_i", cell("xa", width)).withColumn("_j", cell("ya", height))
    j = cells.join(grid, ["_i", "_j"])
    away = F.abs(F.col("_i") - cell("x0", width)) + F.abs(F.col("_j") - cell("y0", height))
    place = F.row_number().over(Window.partitionBy("k").orderBy(away, "ya", "xa")) - 1
    return j.select("k", "node", F.greatest("x0", "xa").alias("x0"), F.greatest("y0", "ya").alias("y0"), F.least("x1", "xb").alias("x1"), F.least("y1", "yb").alias("y1"), place.alias("place"))
