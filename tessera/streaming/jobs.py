"""Jobs that can be aborted, and requests that are carried out in worker processes."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

R = TypeVar("R")


def abortable(spark: SparkSession, tag: str, run: Callable[[], R]) -> R:
    """run(), its jobs known by tag: abort(spark, tag) from another thread ends them, and run() with an error."""
    spark.sparkContext.addJobTag(tag)
    try:
        return run()
    finally:
        spark.sparkContext.removeJobTag(tag)


def abort(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


class Request:
    """A request that workers make from its JSON and carry out; subclasses say how."""

    def __init__(self, **facts: object):
        self.facts = facts

    def run(self) -> object:
        raise NotImplementedError


def in_workers(requests: DataFrame, ident: str = "id", kind: str = "kind", facts: str = "facts") -> DataFrame:
    """(id, result, error) of requests: kind names a Request class as module:class, facts is a JSON object. A request that
    fails has its error's text and leaves the others alone."""
    asked = requests.select(F.col(ident).alias("id"), F.col(kind).alias("kind"), F.col(facts).alias("facts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            result, error = [], []
            for k, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    module, _, name = k.partition(":")
                    made = getattr(importlib.import_module(module), name)
                    if not issubclass(made, Request):
                        raise TypeError(f"{k} is no request")
                    result.append(json.dumps(made(**json.loads(f)).run()))
                    error.append(None)
                except Exception as e:
                    result.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(result, pa.string()), pa.array(error, pa.string())], ["id", "result", "error"])

    return asked.mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, result string, error string")
