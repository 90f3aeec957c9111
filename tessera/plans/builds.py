"""Whole builds: tilings, overviews, set-up of a resource, inspection and conversion of stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import catalogue as C
from tessera.operators import pyramid as P
from tessera.operators import raster as R
from tessera.sources import store
from tessera.sources import tables as T

INDEX_COLUMNS, STORE_COLUMNS = "x int, y int, flags int", "x int, y int, min_z double, max_z double"


def build_tiling(pixels: DataFrame, lod: int, shift: int, root: str, options: dict[str, object], coverage_only: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Leaf pass, rollup and publication of a pair (or of coverage alone) below root; returns what a reader then sees.

    The pyramid is written once and read for index and store, so that the leaf pass is not done twice."""
    spark = pixels.sparkSession
    path = store.scratch(spark, "pyramid")
    P.pyramid(P.leaves(pixels, lod, shift), lod).write.parquet(path)
    tiles = spark.read.parquet(path)
    store.publish(P.flags(tiles), None if coverage_only else tiles.select(*P.TILE, "min_z", "max_z"), root, options)
    return store.read_pair(spark, root, **options)


def build_overviews(cells: DataFrame, levels: int, path: str, value: str = "z") -> DataFrame:
    """Levels 1..levels of an overview pyramid, each made of the one before as it was written; (px, py, value, ovr)."""
    spark = cells.sparkSession
    level = cells.select(*R.PIX, value)
    for n in range(1, levels + 1):
        R.overview_step(level, value).write.parquet(f"{path}/ovr={n}")
        level = spark.read.parquet(f"{path}/ovr={n}")
    return spark.read.schema(f"px int, py int, {value} double, ovr int").parquet(path)


def inspect(index: DataFrame, payload: DataFrame) -> DataFrame:
    """(lod, tiles, watertight, payloads, violations) of a pair by level."""
    tiles = index.groupBy("lod").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("flags").bitwiseAND(P.WATERTIGHT) != 0).alias("watertight"))
    held = payload.groupBy("lod").agg(F.count(F.lit(1)).alias("payloads"))
    wrong = P.check_pair(index, payload).groupBy("lod").agg(F.count(F.lit(1)).alias("violations"))
    out = tiles.join(held, "lod", "full").join(wrong, "lod", "full")
    return out.select("lod", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tiles", "watertight", "payloads", "violations")])


def convert(index: DataFrame, path: str, form: str) -> DataFrame:
    """Writes an index in another format, level by folder, and reads it back."""
    index.repartitionByRange("lod", "y", "x").sortWithinPartitions("lod", "y", "x").write.partitionBy("lod").format(form).save(path)
    return index.sparkSession.read.schema(f"{INDEX_COLUMNS}, lod int").format(form).load(path).select(*P.TILE, "flags")


def setup_resource(spark: SparkSession, pixels: DataFrame, group: str, ident: str, attribution: str, root: str, notify: Callable[[str], None] | None = None, lod: int = T.LEAF_LOD, shift: int = T.TILE_SHIFT, overviews: int = 3) -> DataFrame:
    """All that makes pixels a resource: a copy of the dataset, of which all else is made; measures, credit, overviews,
    tiling; the definition, written where a server looks for it; and word to that server. One row says what was made."""
    pixels.write.parquet(f"{root}/dataset")
    pixels = spark.read.parquet(f"{root}/dataset")
    facts = T.probe(pixels).select("xmin", "xmax", "ymin", "ymax", "n")
    over = build_overviews(R.cells(pixels), overviews, f"{root}/overviews")
    index, _ = build_tiling(pixels, lod, shift, f"{root}/tiles", {"rf": "earth"})
    sizes = over.agg(F.count(F.lit(1)).alias("n_overview"))
    levels = index.agg(F.min("lod").alias("lod_min"), F.max("lod").alias("lod_max"), F.count(F.lit(1)).alias("n_tiles"))
    said = C.definition_json(F.lit(group), F.lit(ident), F.lit("surface"), F.lit("surface-dem"), F.lit(0))
    spark.range(1).select(said.alias("value")).coalesce(1).write.text(f"{root}/definition")
    if notify:
        notify(f"{group}/{ident}")
    # one row each
    written = spark.read.text(f"{root}/definition").withColumnRenamed("value", "definition")
    return facts.join(F.broadcast(sizes), F.lit(True)).join(F.broadcast(levels), F.lit(True)).withColumn("credit", S.credit_id(F.lit(attribution))).join(F.broadcast(written), F.lit(True))
