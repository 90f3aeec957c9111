"""Sources: pixel, feature and index tables derived from the driver's Parquet tables, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The world of the derived raster: 1024 x 1024 pixels, leaf tiles of 8 x 8 pixels at level 7.
WORLD, LEAF_LOD, TILE_SHIFT = 1024, 7, 3

PIXEL_SQL = """
pixel AS (
  SELECT CAST(l_partkey % 1024 AS INT) AS px, CAST(l_orderkey % 1024 AS INT) AS py,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS z,
         CASE WHEN l_linestatus = 'F' THEN 255 ELSE 0 END AS mask, l_suppkey
  FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OPEN: dict[tuple[int, str], DataFrame] = {}


def open_once(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path: listed and planned at first use in a session, the same afterwards. Files that come later are
    seen after spark.catalog.refreshByPath(path)."""
    key = (id(spark), path)
    if key not in _OPEN or _OPEN[key].sparkSession is not spark:
        _OPEN[key] = spark.read.parquet(path)
    return _OPEN[key]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, py, z (null: no data), mask (0 or 255), l_suppkey."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_partkey") % WORLD).cast("int").alias("px"),
        (F.col("l_orderkey") % WORLD).cast("int").alias("py"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("z"),
        F.when(F.col("l_linestatus") == "F", 255).otherwise(0).alias("mask"),
        "l_suppkey",
    )


def probe(df: DataFrame, value: str = "z") -> DataFrame:
    """One-row descriptor of a raster table: extents, size, sample type range, nodata count."""
    return df.agg(
        F.min("px").alias("xmin"), F.max("px").alias("xmax"), F.min("py").alias("ymin"), F.max("py").alias("ymax"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_nodata"),
        F.min(value).alias("vmin"), F.max(value).alias("vmax"), F.bool_or(F.col("mask") == 0).alias("has_mask"),
    )


def vector_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads a vector table; a missing path is an empty result of the same schema, other errors are raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, as a keyed lookup source reads it."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


RESOURCE_SCHEMA = "group string, id string, type string, driver string, revision int, credits array<string>, referenceFrames map<string, struct<lodRange: array<int>>>, definition string, maxAge int"


def resources_from_json(df: DataFrame, column: str) -> DataFrame:
    """Explodes resource definitions (JSON text) into one row for each reference frame; defaults are filled in."""
    parsed = df.select(F.from_json(column, RESOURCE_SCHEMA).alias("r"))
    each = parsed.select("r.*", F.explode("r.referenceFrames").alias("rf", "frame")).drop("referenceFrames")
    return each.select(
        "rf", "group", "id", "type", "driver", F.coalesce("revision", F.lit(0)).alias("revision"), F.coalesce("credits", F.array().cast("array<string>")).alias("credits"),
        F.col("frame.lodRange")[0].alias("lod_min"), F.col("frame.lodRange")[1].alias("lod_max"), F.coalesce("maxAge", F.lit(-1)).alias("max_age"),
    )


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing at run time where a key repeats."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).select(F.concat_ws("/", *keys).alias("k")).collect()
    if twice:
        raise ValueError(f"duplicate id {twice[0].k}")
    return df


def numbered(df: DataFrame, n: str, name: str, block: int = 1 << 16, *then: str) -> DataFrame:
    """df with its rows numbered from 1 in the order of the whole numbers in n (and then of others). Rows are numbered in blocks of n, which
    start at the count of the rows before: no task sees more than a block, the counts of blocks are few."""
    from pyspark.sql import Window

    keyed = df.withColumn("_block", F.floor(F.col(n) / block))
    counts = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(n, *then))
    return keyed.withColumn("_rank", rank).join(before, "_block").withColumn(name, (F.col("_rank") + F.col("_before")).cast("int")).drop("_block", "_rank", "_before")


def obj_mesh(lines: DataFrame, column: str = "line", block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(vertices (vid, x, y, z), faces (fid, a, b, c, material)) of OBJ text with a line number column n. A face's
    material is the one named last before it ("mesh" before any), found in its block of lines or else in the blocks
    before. Polygons are fans of triangles around their first corner; negative corners count back from the last vertex
    before the face; numbers may have exponents, and what is no number is null."""
    from pyspark.sql import Window

    parts = F.split(F.trim(F.col(column)), "[ \\t]+")
    v = numbered(lines.where(F.col(column).startswith("v ")), "n", "vid", block)
    v = v.withColumn("_p", parts).select("vid", *[F.get("_p", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    is_point = F.col(column).startswith("v ")
    keyed = lines.withColumn("_b", F.floor(F.col("n") / block)).withColumn("_m", F.when(F.col(column).startswith("usemtl "), F.trim(F.expr(f"substring({column}, 8)"))))
    before = Window.partitionBy("_b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = keyed.groupBy("_b").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col("n"))).alias("_e"), F.count_if(is_point).alias("_k"))
    past = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_b", F.last("_e", ignorenulls=True).over(past).alias("_carried"), F.coalesce(F.sum("_k").over(past), F.lit(0)).alias("_points"))
    f = keyed.withColumn("_own", F.last("_m", ignorenulls=True).over(before)).withColumn("_seen", F.count_if(is_point).over(before))
    f = f.where(F.col(column).startswith("f ")).join(carried, "_b").withColumn("material", F.coalesce("_own", "_carried", F.lit("mesh"))).withColumn("_seen", F.col("_seen") + F.col("_points"))
    corner = lambda t: F.split(t, "/")[0].try_cast("int")
    corners = F.transform(F.slice(parts, 2, 1 << 30), lambda t: F.when(corner(t) < 0, F.col("_seen") + 1 + corner(t)).otherwise(corner(t)).cast("int"))
    f = f.withColumn("_c", corners).where("size(_c) >= 3")
    fans = f.select("n", "material", "_c", F.posexplode(F.sequence(F.lit(1), F.size("_c") - 2)).alias("_i", "_t"))
    f = numbered(fans, "n", "fid", block, "_i").select("fid", F.col("_c")[0].alias("a"), F.get("_c", F.col("_t")).alias("b"), F.get("_c", F.col("_t") + 1).alias("c"), "material")
    return v, f


def bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows within extents: range predicates that reach the Parquet scan."""
    return df.where(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def tile_path(template: str, lod: str = "lod", x: str = "x", y: str = "y") -> F.Column:
    """The path of each tile by a template with {lod}, {x}, {y}, {loclod}, {locx}, {locy}."""
    out = F.lit(template)
    for name, column in (("lod", lod), ("x", x), ("y", y), ("loclod", lod), ("locx", x), ("locy", y)):
        out = F.replace(out, F.lit(f"{{{name}}}"), F.col(column).cast("string"))
    return F.when(F.regexp_like(out, F.lit("^https?:")), F.concat(F.lit("mvt:"), out)).otherwise(out)
