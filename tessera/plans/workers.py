"""Where Python workers find this package."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def find_package(spark: SparkSession) -> None:
    """Workers started from now on look for the package where the driver has it, unless PYTHONPATH says so already."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in (os.environ.get("PYTHONPATH", "") + ":" + env.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


def with_package(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_package(spark)
        return f(spark, sf_dir)

    return run
