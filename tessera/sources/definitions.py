"""Resource definitions: files with includes, and callables as a data source."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tessera.sources.tables import check_unique, resources_from_json

_GLOB = set("*?[{")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _entries(texts: DataFrame) -> DataFrame:
    """(file, entry, include): the objects of each file, which holds one or an array of them."""
    each = texts.select("file", F.explode(F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))), "array<string>")).alias("entry"))
    return each.withColumn("include", F.get_json_object("entry", "$.include"))


def load_definitions(spark: SparkSession, path: str, deepest: int = 16) -> DataFrame:
    """(entry): the definitions, as JSON text, of a file and of all that it includes.

    An entry {"include": name or [names]} stands for other files, by path or glob beside the file that includes it, and so
    on. A file is read once. A glob without files is nothing; a missing file, or includes deeper than `deepest`, is an
    error. Only the names of files are on the driver.
    """
    seen: set[str] = set()
    wanted, out = [path], None
    for _ in range(deepest):
        level = None
        for p in wanted:
            try:
                texts = _texts(spark, p)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" in str(e) and set(p) & _GLOB:
                    continue
                raise
            level = texts if level is None else level.unionByName(texts)
        if level is None:
            break
        here = _entries(level.dropDuplicates(["file"]).where(~F.col("file").isin(sorted(seen))))
        seen |= {r.file for r in level.select("file").distinct().collect()}
        found = here.where("include IS NULL").select("entry")
        out = found if out is None else out.unionByName(found)
        wanted = []
        for r in here.where("include IS NOT NULL").select("file", "include").distinct().collect():
            names = json.loads(r.include) if r.include.startswith("[") else [r.include]
            wanted += [n if "://" in n or n.startswith("/") else f"{r.file.rpartition('/')[0]}/{n}" for n in names]
        wanted = sorted(set(wanted))
        if not wanted:
            break
    else:
        raise ValueError(f"includes of {path} are deeper than {deepest}")
    return out if out is not None else spark.createDataFrame([], "entry string")


def load_resources(spark: SparkSession, path: str) -> DataFrame:
    """Resources of definition files, a row for each reference frame; an id that repeats in its group and frame is an error."""
    return check_unique(resources_from_json(load_definitions(spark, path), "entry"), ["rf", "group", "id"])


class ConfFile:
    """Definitions of a file, read when made (so that a wrong file fails at once) and again by each load()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.load()

    def load(self) -> DataFrame:
        return load_resources(self.spark, self.path)


class _CallableReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition) -> Iterator[tuple[str]]:
        made: Callable[[], list[dict]] = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        for entry in made():
            yield (json.dumps(entry),)


class CallableSource(DataSource):
    """format("definitions"): the definitions that module.function() returns, as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "definitions"

    def schema(self) -> str:
        return "entry string"

    def reader(self, schema) -> DataSourceReader:
        return _CallableReader(dict(self.options))


def callable_backend(spark: SparkSession, module: str, function: str) -> DataFrame:
    """Resources of a callable, as load_resources() has those of a file."""
    spark.dataSource.register(CallableSource)
    entries = spark.read.format("definitions").option("module", module).option("function", function).load()
    return check_unique(resources_from_json(entries, "entry"), ["rf", "group", "id"])
