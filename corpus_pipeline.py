"""The corpus pipeline: quality, near-duplicates, decontamination, packing.

Every stage takes any documents (doc_id, text and other columns, whatever their names, which come through): null and empty
texts, repeated rows, null ids, texts of any length (read whole) and empty tables, which stay empty. What each of these
gives is said by the stage's operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, neardup, packing, quality
from tessera.llm.common import stash


def keeping(docs: DataFrame, added: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that stage(docs) keeps, with the columns of docs. Columns of docs that have the name of one that the
    stage adds are held under another meanwhile, so that their values come through."""
    held = {c: f"_held_{i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    out = stage(docs.withColumnsRenamed(held))
    return out.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts (score >= 0.7); learnt from the labelled ones among docs."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keeping(docs, ["score", "predicted"], lambda d: quality.score(d, model).where("predicted = 1"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, a similarity of 0.8 or more)."""
    return keeping(docs, ["_key", "_bare"], neardup.near_dedup)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return keeping(docs, [*decontaminate.NEW, "_hits", "_items"], lambda d: decontaminate.decontaminate(d, benchmark, mode="documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_dedup", distinct), ("decontaminate", clean), ("pack", packed)]
#: SQL has neither the trained ranking nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
