"""Quality by Bradley-Terry ranking: scores learnt from preference pairs by logistic loss on feature differences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SOLID, Words, blocks, small_batches

#: Hashed shapes of words (which classes of bytes they start and end with, and their length).
SHAPES = 256
_CLASS = np.full(256, 6, dtype=np.int8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 3
_CLASS[[0x2E, 0x2C, 0x3B, 0x3A, 0x27, 0x28, 0x29, 0x3F]] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 5
N_STATS = 22


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features for each text, from all of its bytes and words. An empty text is all zeros."""
    w = Words(texts, SOLID)
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    out = np.zeros((len(texts), N_STATS + SHAPES), dtype=np.float32)
    if not len(raw):
        return out
    n = np.diff(w.base)
    starts = w.base[:-1]
    kinds = _CLASS[raw]
    for c in range(7):
        out[:, c] = np.add.reduceat(kinds == c, starts, dtype=np.int64) / n
    words = w.count()
    has = np.flatnonzero(words > 0)
    if not len(has):
        out[:] = 0
        return out
    own, size, first = w.owner(), (w.end - w.start).astype(np.float64), w.first[has]
    nw = words[has].astype(np.float64)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.float64), first) / nw

    out[has, 7], out[has, 8] = mean(size) / 10, np.sqrt(np.maximum(0, mean(size * size) - mean(size) ** 2)) / 10
    order = np.lexsort((w.hash, own))
    new = np.concatenate([[True], (np.diff(own[order]) != 0) | (np.diff(w.hash[order].view(np.int64)) != 0)])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [len(own)]]))
    who = own[order][at]
    place = np.searchsorted(who, has)
    out[has, 9] = np.bincount(who, minlength=len(texts))[has] / nw
    out[has, 10] = np.maximum.reduceat(runs, place) / nw
    out[has, 11] = out[has, 9] * np.log1p(nw) / 5
    same = np.zeros(len(own), dtype=np.float64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])
    out[has, 12] = mean(same)
    last, head = kinds[w.end - 1], kinds[w.start]
    for k, c in enumerate((1, 4, 6, 2)):
        out[has, 13 + k] = mean(last == c)
    out[has, 17], out[has, 18] = mean(head == 1), mean(head == 6)
    out[has, 19] = mean(size == 1)
    out[has, 20] = np.log1p(nw) / 10
    out[has, 21] = np.add.reduceat(raw == 10, starts, dtype=np.int64)[has] / nw
    shape = ((kinds[np.maximum(w.end - 2, w.start)].astype(np.int64) * 7 + last) * 7 + head) * 8 + np.minimum(size, 15).astype(np.int64) // 2
    shape = (shape * 2654435761 >> 7) % SHAPES
    counts = np.bincount(own * SHAPES + shape, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)[has]
    out[has, N_STATS:] = np.sqrt(counts / nw[:, None])
    out[words == 0] = 0
    return out


@dataclass
class Ranker:
    """score(features) = a monotone map of weights . features to 0..1, at 0.7 where the threshold lies."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.weights

    def score(self, x: np.ndarray, cut: float = 0.7) -> np.ndarray:
        z = (self.raw(x) - self.threshold) / self.spread + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, rounds: int = 300, l2: float = 1e-3, seed: int = 7) -> Ranker:
    """Bradley-Terry: a row labelled 1 is preferred to one labelled 0; logistic loss on feature differences.

    The threshold is the quantile of the scores at the share of rows labelled 0. Where one label is missing there is
    no pair: weights are zero and everything is judged as the label that is there (1 for no rows at all).
    """
    center, scale = (x.mean(0), x.std(0) + 1e-2) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranker(center, scale, weights, -1.0 if len(good) or not len(x) else 1.0, 1.0)
    rng = np.random.default_rng(seed)
    z = (x - center) / scale
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        part = slice((t * 4096) % pairs, (t * 4096) % pairs + 4096)
        d = z[a[part]] - z[b[part]]
        g = l2 * weights - d.T @ (1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))) / max(1, len(d))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    scores = z @ weights
    return Ranker(center, scale, weights, float(np.quantile(scores, len(bad) / len(y))), float(scores.std() / 2 + 1e-9))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, place) to (label, features, place)."""
    for b in batches:
        rows: list[bytes] = []
        for _, part in blocks(b.column(1).to_pylist()):
            rows += [r.tobytes() for r in features(part)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["label", "x", "place"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 8000, doc: str = "doc_id", text: str = "text", held_out: bool = True) -> Ranker:
    """Fits on at most about max_labelled labelled rows, chosen by a hash of their doc_id (the documented bound of
    the sample; all rows where there are fewer). Rows whose crc32(doc_id) mod 4 is 2 are held out. Null labels and
    labels other than 0 and 1 are skipped. A doc_id labelled twice alike counts once, one that repeats in docs
    as often, within twice max_labelled rows in all: beyond that, those of the smallest hashes of doc_id and text. Null
    texts count as empty, very long ones are read whole; other columns play no part, whatever their names; an empty table
    of either kind gives a ranker that finds all alike."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(doc).alias("_doc"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND _doc IS NOT NULL").distinct()
    if held_out:
        chosen = chosen.where(F.crc32(F.col("_doc").cast("string").cast("binary")) % 4 != 2)
    n = chosen.count()
    if n > max_labelled:
        chosen = chosen.where(F.pmod(F.xxhash64("_doc"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    texts = docs.select(F.col(doc).alias("_doc"), F.col(text).cast("binary").alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_doc").select("label", "_text", F.xxhash64("_doc", "_text").alias("place"))
    rows = rows.mapInArrow(_featured, "label int, x binary, place long")
    rows = rows.orderBy("place", "label").limit(2 * max_labelled)
    found = sorted((r.label, bytes(r.x)) for r in rows.toLocalIterator())
    x = np.frombuffer(b"".join(x for _, x in found), dtype=np.float32).reshape(-1, N_STATS + SHAPES).astype(np.float64)
    return fit(x, np.array([y for y, _ in found], dtype=np.int64))


def score(docs: DataFrame, model: Ranker, text: str = "text", cut: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where score >= cut). Null text counts as empty and is scored too; very
    long texts are read whole; input columns named score or predicted are replaced; repeated rows have equal scores; an
    empty table gives no rows."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [held.value.score(features(part), cut) for _, part in blocks(b.column(at).cast(pa.binary()).to_pylist())]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= cut).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def fold(doc: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary"))


def crc(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold() % 4 == 2).alias("held_out"), "score", "predicted")
