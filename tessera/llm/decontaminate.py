"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, blocks, small_batches, stash

NEW = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_BITS = 20


class Grams:
    """The n-grams of a bounded block of test items, in numpy arrays: for each length the sorted 64-bit hashes, where each
    gram's words stand in one buffer, and the items that hold it. About seven bytes for each byte of item text."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.names = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.names)}
        self.odd: dict[tuple[int, bytes], set[int]] = {}
        texts: list[bytes] = []
        found: dict[int, list[list[np.ndarray]]] = {}
        place = 0
        for first, part in blocks([t for _, t in items]):
            w = Words(part, ALNUM)
            texts.append(b"".join(x + b" " for x in w.normal()))
            size = (w.end - w.start + 1).astype(np.int64)
            until = np.cumsum(size) + place
            since = until - size
            # a text without words is one blank in the buffer
            blank = np.cumsum(w.count() == 0)
            shift = (blank - (w.count() == 0))[w.owner()]
            since, until = since + shift, until + shift - 1
            who = np.array([number.get(i, -1) if i is not None else -1 for i, _ in items[first : first + len(part)]], dtype=np.int32)
            at, h, own = w.windows(n)
            short, hs = w.wholes(n)
            found.setdefault(n, []).append([h, since[at], until[at + n - 1], who[own]])
            count = w.count()[short]
            for k in np.unique(count):
                one = short[count == k]
                found.setdefault(int(k), []).append([hs[count == k], since[w.first[one]], until[w.first[one] + k - 1], who[one]])
            place += len(texts[-1])
        self.text = b"".join(texts)
        self.by_length = [self._sorted(k, [np.concatenate(x) for x in zip(*parts, strict=True)]) for k, parts in sorted(found.items())]
        self.by_length = [x for x in self.by_length if len(x[1])]

    def _sorted(self, k: int, cols: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, hash, since, until, first of its items, items, sieve) of the distinct grams of a length."""
        order = np.lexsort((cols[3], cols[0]))
        h, since, until, who = (c[order] for c in cols)
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
        gram = np.cumsum(new) - 1
        lead = np.flatnonzero(new)
        keep = (who >= 0) & (new | np.concatenate([[True], who[1:] != who[:-1]])[: len(who)])
        for i in np.flatnonzero(~new).tolist():
            mine, main = self.text[since[i] : until[i]], lead[gram[i]]
            if mine != self.text[since[main] : until[main]]:
                # another gram of the same hash
                self.odd.setdefault((k, mine), set()).update([int(who[i])] if who[i] >= 0 else [])
                keep[i] = False
        first = np.searchsorted(gram[keep], np.arange(len(lead) + 1))
        sieve = np.zeros(1 << _BITS, dtype=bool)
        sieve[h & np.uint64((1 << _BITS) - 1)] = True
        kind = np.int32 if len(self.text) < 2**31 else np.int64
        return k, h[lead], since[lead].astype(kind), until[lead].astype(kind), first, who[keep], sieve

    def hits(self, w: Words) -> Iterator[tuple[int, int, int, tuple[int, int]]]:
        """(text, first word, words, gram) of each verified occurrence."""
        for at_length, (k, hashes, since, until, _, _, sieve) in enumerate(self.by_length):
            at, h, own = w.windows(k)
            near = np.flatnonzero(sieve[h & np.uint64((1 << _BITS) - 1)])
            place = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
            same = hashes[place] == h[near]
            for i, g in zip(near[same].tolist(), place[same].tolist(), strict=True):
                words = w.joined(int(at[i]), k)
                if words == self.text[since[g] : until[g]]:
                    yield int(own[i]), int(at[i]), k, (at_length, g)
                elif (k, words) in self.odd:
                    yield int(own[i]), int(at[i]), k, (k, words)

    def items(self, grams: set) -> set[str]:
        """The names of the items that hold any of the grams."""
        out: set[int] = set()
        for a, g in grams:
            if isinstance(g, bytes):
                out |= self.odd[a, g]
            else:
                _, _, _, _, first, who, _ = self.by_length[a]
                out.update(who[first[g] : first[g + 1]].tolist())
        return {self.names[i] for i in out}


def _found(g: Grams, texts: list[bytes | None]) -> Iterator[tuple[bytes | None, Words, int, list[int], set[str]]]:
    """(text, words of its block, its place there, first word and words of each occurrence, items) of each text."""
    for first, part in blocks(texts):
        w = Words(part, ALNUM)
        spans: list[list[int]] = [[] for _ in part]
        grams: list[set] = [set() for _ in part]
        for o, a, k, gram in g.hits(w):
            spans[o] += (a - int(w.first[o]), k)
            grams[o].add(gram)
        for o in range(len(part)):
            yield texts[first + o], w, o, spans[o], g.items(grams[o]) if grams[o] else set()


class _Marks:
    """Columns of NEW, and the text without its hit words if asked for, of documents whose occurrences are all known."""

    def __init__(self, clean: bool):
        self.clean = clean
        self.words, self.hits, self.items, self.texts = [], [], [], []

    def add(self, text: bytes | None, w: Words, o: int, spans: np.ndarray, items: set[str]) -> None:
        n = int(w.first[o + 1] - w.first[o])
        marks = np.zeros(n + 1, dtype=np.int32)
        np.add.at(marks, spans[:, 0], 1)
        np.add.at(marks, spans[:, 0] + spans[:, 1], -1)
        hit = np.cumsum(marks)[:-1] > 0
        self.words.append(n)
        self.hits.append(int(hit.sum()))
        self.items.append(sorted(items))
        if self.clean:
            self.texts.append(_without(text, w, int(w.first[o]), int(w.base[o]), hit))

    def batch(self, b: pa.RecordBatch, keep: list[int], text_at: int, schema: pa.Schema) -> pa.RecordBatch:
        cols = [b.column(i) for i in keep]
        if self.clean:
            cols[keep.index(text_at)] = pa.array(self.texts, pa.binary()).cast(pa.string())
        cols += [pa.array(self.words, pa.int64()), pa.array(self.hits, pa.int64()), pa.array(map(len, self.items), pa.int64())]
        cols += [pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in self.items], pa.string()), pa.array([x > 0 for x in self.hits], pa.bool_())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _spans(pairs: list[int] | bytes) -> np.ndarray:
    flat = np.frombuffer(pairs, dtype="<i4") if isinstance(pairs, bytes) else np.array(pairs, dtype="<i4")
    return flat.reshape(-1, 2)


def _whole_scan(grams, text_at: int, keep: list[int], clean: bool, schema: pa.Schema):
    """Documents to documents with NEW, where one block holds all test windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = _Marks(clean)
            for text, w, o, spans, items in _found(grams.value, b.column(text_at).cast(pa.binary()).to_pylist()):
                marks.add(text, w, o, _spans(spans), items)
            yield marks.batch(b, keep, text_at, schema)

    return run


def _block_scan(grams):
    """(key, text) to (key, spans, items) of the texts with occurrences of this block's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, _spans(spans).tobytes(), sorted(items)) for i, (_, _, _, spans, items) in enumerate(_found(grams.value, b.column(1).cast(pa.binary()).to_pylist())) if spans]
            if rows:
                at, spans, items = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["key", "spans", "items"])

    return run


def _last_scan(text_at: int, keep: list[int], clean: bool, schema: pa.Schema):
    """Documents with the spans and items that the scans of all blocks found to documents with NEW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = _Marks(clean)
            texts = b.column(text_at).cast(pa.binary()).to_pylist()
            spans, items = (b.column(len(keep) + i).to_pylist() for i in (0, 1))
            for first, part in blocks(texts):
                w = Words(part, ALNUM)
                for o in range(len(part)):
                    i = first + o
                    marks.add(texts[i], w, o, _spans(b"".join(spans[i] or [])), {x for xs in items[i] or [] for x in xs})
            yield marks.batch(b, keep, text_at, schema)

    return run


def _without(text: bytes | None, w: Words, first: int, base: int, hit: np.ndarray) -> bytes | None:
    """The text less the bytes from the first to the last word of each run of hit words."""
    if text is None or not hit.any():
        return text
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(text[at : int(w.start[first + a]) - base])
        at = int(w.end[first + b - 1]) - base
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "flag", text: str = "text", block_bytes: int = 16 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items_sha256 and contaminated.

    Words are runs of letters, digits and everything beyond ASCII, A-Z lower-cased. Every run of n consecutive
    words of a test item is a window (a shorter item is one window); a document word within any occurrence is hit.
    mode: "flag" keeps all rows, "documents" drops contaminated ones, "spans" cuts the hit words out of the text.

    The test windows are broadcast in blocks of about block_bytes of items (or one item, if longer), which a worker holds
    in about seven times that. One block takes one scan, without a shuffle. A larger benchmark takes one scan and one
    job for each block, whose hits (of contaminated texts only) are written, and then joined to the documents by the
    SHA-256 of their texts: broadcast where they are at most broadcast_rows texts, else by a shuffle. No window is dropped.
    Candidates found by 64-bit hash are verified word for word.

    Null or wordless text: 0 words, not contaminated. Null item text: no windows. Items with null item_id hit words
    but are not counted. An item_id that repeats counts once. Empty tables: nothing is hit. Input columns with
    names in NEW are replaced. Repeated rows stay repeated. Very long texts are scanned whole, each by itself.
    """
    if mode not in ("flag", "documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("t IS NOT NULL")
    # an item's name and places count as 64 bytes more
    total = bench.agg(F.sum(F.length("t") + F.coalesce(F.octet_length("i"), F.lit(0)) + 64)).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    docs = docs.drop(*NEW)
    text_at, keep, clean = docs.columns.index(text), list(range(len(docs.columns))), mode == "spans"
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *more])

    def grams(part: DataFrame):
        return spark.sparkContext.broadcast(Grams([(r.i, bytes(r.t)) for r in part.toLocalIterator()], n))

    if n_blocks == 1:
        out = docs.mapInArrow(_whole_scan(grams(bench), text_at, keep, clean, _arrow(schema)), schema)
    else:
        sha = F.sha2(F.col(text).cast("binary"), 256)
        found = []
        for k in range(n_blocks):
            held = grams(bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k))
            hits = docs.select(sha.alias("key"), text).mapInArrow(_block_scan(held), "key string, spans binary, items array<string>")
            # copies of a text have equal hits, and one of them says it
            found.append(stash(hits.dropDuplicates(["key"]), "hits"))
            held.destroy()
        hits = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.collect_list("spans").alias("_spans"), F.collect_list("items").alias("_items"))
        hits = stash(hits.withColumnRenamed("key", "_text_key"), "hits")
        few = hits.limit(broadcast_rows + 1).count() <= broadcast_rows
        # by place, for columns of docs may have these names
        kept = docs.select(F.struct(*docs.columns).alias("_row"), sha.alias("_text_key")).join(F.broadcast(hits) if few else hits, "_text_key", "left")
        kept = kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("_spans"), F.col("_items"))
        out = kept.mapInArrow(_last_scan(text_at, keep, clean, _arrow(schema)), schema)
    if mode == "documents":
        return out.where(~F.col("contaminated"))
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM grams),
places AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, sizes WHERE len(w) >= k),
hits AS (
  SELECT p.doc_id, p.i, p.k, g.item FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM places) p JOIN grams g ON p.g = g.g AND p.k = g.k),
marked AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(m.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN marked m USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
