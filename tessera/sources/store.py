"""The tile store: an index and its payload written as a pair, found by a manifest that is written last."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.catalogue import digest

#: Fixed version of the layout; others are rejected.
VERSION = 2


_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in one of this process where that is unset and driver and
    executors are one process (tests). A cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tessera-"))
        top = f"file://{_OWN[0]}"
    return f"{top.rstrip('/')}/tessera-engine/{name}-{uuid.uuid4().hex}"


def read_tiles(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Tiles as write_tiles() lays them out; columns: schema of those beside lod. Conditions on lod prune folders."""
    return spark.read.schema(f"{columns}, lod int").parquet(path)


def write_tiles(df: DataFrame, path: str) -> None:
    """Partitioned by level, in page order within files, so that a level or a page is few row groups."""
    df.repartitionByRange("lod", "y", "x").sortWithinPartitions("lod", "y", "x").write.partitionBy("lod").parquet(path)


def files_mark(spark: SparkSession, path: str) -> str:
    """A digest of the names and lengths of the files below a path, which takes a listing and reads none of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    name = F.regexp_extract("path", r"((?:lod=[^/]*/)?[^/]+)$", 1)
    return digest(files.select(name.alias("name"), "length"), ["name", "length"]).first()[0]


def publish(index: DataFrame, store: DataFrame | None, root: str, options: dict[str, object]) -> str:
    """Writes a new generation beside the old one and then its manifest, whose digest of the index ties the two; a
    reader sees the old pair or the new one. store None publishes coverage alone. Returns the generation."""
    spark = index.sparkSession
    generation = uuid.uuid4().hex
    write_tiles(index, f"{root}/{generation}/index")
    if store is not None:
        write_tiles(store, f"{root}/{generation}/store")
    mark = digest(spark.read.parquet(f"{root}/{generation}/index"), ["lod", "x", "y", "flags"]).first()[0]
    files = files_mark(spark, f"{root}/{generation}")
    facts = {"version": VERSION, "generation": generation, "pairing": mark, "files": files, "has_store": store is not None, **options}
    row = spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return generation


def manifest(spark: SparkSession, root: str) -> dict:
    last = spark.read.parquet(f"{root}/manifest").orderBy(F.desc("at")).limit(1).first()
    return json.loads(last.value)


def read_pair(spark: SparkSession, root: str, whole: bool = False, **expected: object) -> tuple[DataFrame, DataFrame | None]:
    """The newest pair; raises where the version, an expected option or the files do not match the manifest. whole: the
    index is read and its digest compared too."""
    facts = manifest(spark, root)
    for k, v in {"version": VERSION, **expected}.items():
        if facts.get(k) != v:
            raise ValueError(f"{k} is {facts.get(k)!r}, not {v!r}")
    index = spark.read.parquet(f"{root}/{facts['generation']}/index")
    same = files_mark(spark, f"{root}/{facts['generation']}") == facts["files"]
    if not same or whole and digest(index, ["lod", "x", "y", "flags"]).first()[0] != facts["pairing"]:
        raise ValueError("index and store are of different generations")
    return index, spark.read.parquet(f"{root}/{facts['generation']}/store") if facts["has_store"] else None


def is_current(spark: SparkSession, root: str, derived: dict) -> bool:
    """Whether what was derived from a pair (its pairing and derivation number) still fits it."""
    facts = manifest(spark, root)
    return derived.get("pairing") == facts["pairing"] and derived.get("derivation") == facts.get("derivation")
