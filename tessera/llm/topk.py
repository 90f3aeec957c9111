"""Exact top-k by inner product over a pivot-distance index.

Vectors are lifted by one coordinate to a common length, which turns the largest inner products into the smallest
distances. The index keys each lifted vector by its nearest pivot and its distance from that pivot; a query widens
annuli around each pivot until the triangle inequality shows that nothing beyond can enter its k best.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stash


#: Vectors with a scaled component of this magnitude or more have inner products that a long may not hold.
LIMIT = 1 << 26


def quantise(df: DataFrame, scale: int = 1024, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as a double. Vectors that are null, empty, or hold
    null or non-finite components are left out; so are those with a scaled component of LIMIT or more either way."""
    x = F.transform(F.col(vec).cast("array<double>"), lambda e: e * F.lit(float(scale)))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= float(LIMIT)))
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad).select(F.col(key).alias("vec_id"), F.transform(x, lambda e: F.floor(e)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _lifted(v: np.ndarray, top: int) -> np.ndarray:
    """Float vectors with one more coordinate, sqrt(top - |v|^2)."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0, top - (v * v).sum(1)))[:, None]])


def build_index(vectors: DataFrame, pivots: int = 64, sample: int = 4096) -> tuple[DataFrame, np.ndarray, int]:
    """(index rows (pivot, dist, vec_id, v), lifted pivots, largest squared length).

    Pivots come from a bounded sample (the `sample` vectors with the smallest hashes of their ids) by a farthest-first
    walk; every vector is indexed. The table is range-partitioned by (pivot, distance), so that a large pivot spreads
    over as many tasks as its rows need."""
    spark = vectors.sparkSession
    top = vectors.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0] or 0
    chosen = np.array([r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("v").limit(sample).collect()], dtype=np.int64)
    if not len(chosen):
        return vectors.select(F.lit(0).alias("pivot"), F.lit(0.0).alias("dist"), "vec_id", "v"), np.zeros((0, 1)), top
    lifted = _lifted(chosen, top)
    picked = [0]
    far = np.linalg.norm(lifted - lifted[0], axis=1)
    while len(picked) < min(pivots, len(lifted)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(lifted - lifted[picked[-1]], axis=1))
    centers = lifted[picked]
    held = spark.sparkContext.broadcast((centers, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _lifted(_matrix(b.column(1)), t)
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), b.column(0), b.column(1)], ["pivot", "dist", "vec_id", "v"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    index = vectors.mapInArrow(run, f"pivot int, dist double, vec_id {kind}, v array<long>")
    return stash(index.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist"), "pivots"), centers, top


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(pivot, dist, vec_id, v) of runs of about `size` bytes of vectors, each sorted by pivot and distance: in whatever
    order the files of a task come, and however many they are."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
            n += b.nbytes
        if held and (b is None or n >= size):
            t = pa.Table.from_batches(held).combine_chunks()
            pivot, dist, vec = (t.column(i).to_numpy() for i in range(3))
            order = np.lexsort((dist, pivot))
            yield pivot[order], dist[order], vec[order], _matrix(t.column(3).combine_chunks())[order]
            held, n = [], 0


def _search(held, k: int, step: int, size: int):
    """Index rows of a task to each query's k best among them that can still be among the k best of all. Holds one
    chunk of about `size` bytes at a time, and the queries with their best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, centers, top, floor_ = held.value
        qf = q.astype(np.float64)
        lifted = np.hstack([qf, np.zeros((len(q), 1))])
        lengths = (lifted * lifted).sum(1)
        held_s = [np.zeros(0, dtype=np.int64) for _ in ids]
        held_v = [ids[:0] for _ in ids]
        bound = floor_.astype(np.float64).copy()
        # nothing with a distance beyond reach can score above the bound; the slack covers rounding of squared distances
        slack = 1e-3 + 1e-6 * np.sqrt(lengths + top)
        reach = lambda i: np.sqrt(np.maximum(0.0, lengths[i] + top - 2 * bound[i])) + slack[i]
        for pivot, dist, vec, v in _chunks(batches, size):
            # exact in doubles while the sums stay below 2^53; integers otherwise
            exact = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[1] < 2**53
            vs, qs = (v.astype(np.float64), qf) if exact else (v, q)
            names, starts = np.unique(pivot, return_index=True)
            for p, a, z in zip(names, starts, [*starts[1:], len(pivot)], strict=True):
                ring = dist[a:z]
                dq = np.sqrt(np.maximum(0, lengths + (centers[p] ** 2).sum() - 2 * lifted @ centers[p]))
                far = reach(slice(None))
                meets = np.searchsorted(ring, dq + far, side="right") > np.searchsorted(ring, dq - far)
                for i in np.flatnonzero(meets):
                    lo = hi = int(np.searchsorted(ring, dq[i]))
                    while True:
                        r = reach(i)
                        new_lo = min(lo, max(lo - step, int(np.searchsorted(ring, dq[i] - r))))
                        new_hi = max(hi, min(hi + step, int(np.searchsorted(ring, dq[i] + r, side="right"))))
                        if new_lo == lo and new_hi == hi:
                            break
                        near = np.r_[a + new_lo : a + lo, a + hi : a + new_hi]
                        s = (vs[near] @ qs[i]).astype(np.int64)
                        ok = (s >= bound[i]) & (vec[near] != ids[i])
                        s, w = np.concatenate([held_s[i], s[ok]]), np.concatenate([held_v[i], vec[near][ok]])
                        keep = _best(s, w, k)
                        held_s[i], held_v[i] = s[keep], w[keep]
                        if len(keep) == k:
                            bound[i] = max(bound[i], float(held_s[i][-1]))
                        lo, hi = new_lo, new_hi
        n = [len(x) for x in held_s]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(held_v)), pa.array(np.concatenate(held_s))], ["query_id", "vec_id", "score"])

    return run


def _top_k_of_length(asked: DataFrame, vectors: DataFrame, k: int, block: int, step: int, pivots: int, size: int) -> list[DataFrame]:
    """(query_id, vec_id, score) with every query's k best, for queries and vectors of one length; a table a block."""
    spark = vectors.sparkSession
    first = np.array([[r.vec_id, *r.v] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(2048).collect()], dtype=np.int64)
    n_blocks = -(-asked.count() // block)
    if not n_blocks or not len(first):
        return []
    index, centers, top = build_index(vectors, pivots)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = []
    for i in range(n_blocks):
        part = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i)
        rows = part.collect()
        if not rows:
            continue
        ids, q = np.array([r.vec_id for r in rows], dtype=np.int64), np.array([r.v for r in rows], dtype=np.int64)
        s = np.where(first[:, 0][None] == ids[:, None], -(2**62), q @ first[:, 1:].T)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ids), -(2**62))
        held = spark.sparkContext.broadcast((ids, q, centers, top, kth))
        found.append(index.mapInArrow(_search(held, k, step, size), f"query_id {kind}, vec_id {kind}, score long"))
    return found


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 4096, step: int = 256, pivots: int = 64, size: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products among the vectors other than
    itself (all, if fewer), ties to the smaller vec_id.

    queries and vectors are (vec_id, v) as quantise() gives them; rows with null vec_id take no part. Queries are
    taken in blocks of at most `block`; each block goes to all tasks, which read the index in chunks of about `size`
    bytes and sort each by pivot and distance, so that a task's memory and its result depend neither on the order nor
    on the number of its files. Repeated vectors are candidates each by itself. A query's candidates are the vectors
    of its own length: each length has an index of its own. No queries or no candidates: no rows. A first bound for
    each query comes from the scores of a bounded sample. Other columns play no part.
    """
    spark = vectors.sparkSession
    small_batches(spark, rows=4000)
    sized = lambda df: df.where("vec_id IS NOT NULL").select("vec_id", "v", F.size("v").alias("n"))
    vectors, asked = stash(sized(vectors), "vectors"), stash(sized(queries), "queries")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found: list[DataFrame] = []
    for n in sorted(r.n for r in asked.select("n").distinct().collect()):
        of = F.col("n") == n
        found += _top_k_of_length(asked.where(of), vectors.where(of).drop("n"), k, block, step, pivots, size)
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
