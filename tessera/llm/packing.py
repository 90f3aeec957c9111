"""Best-fit packing of token pieces into sequences, by swap-based local search over the histogram of lengths."""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stash

Run = tuple[tuple[int, ...], int]
_ENCODERS: dict[str, object] = {}


#: A place where words end whatever stands around it: the blank between two letters.
_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def segments(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A long text in runs of about `size` characters, cut where the tokenizer's words end, so that the ids of the runs
    are the ids of the text. A run goes on until there is such a place."""
    at = 0
    while len(text) - at > size and (m := _BREAK.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoder(name: str = "byte_bpe_50k"):
    """text -> ids (numpy), as `tokenizers` gives them for name.json without added special tokens.

    The rank file holds the same vocabulary and merges; it is the faster reader of the two. Texts that hold the
    string of a special token go to `tokenizers` itself, whose default is to read it as that token; so do those that
    the fast reader refuses (its patterns give up on white space of some hundred thousand characters).
    """
    if name not in _ENCODERS:
        import public_tokenizers as P
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list = []

        def plain(text: str) -> np.ndarray:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(P.path(f"{name}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

        def run(text: str) -> np.ndarray:
            if "<|" in text:
                return plain(text)
            try:
                return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")
            except ValueError:
                return plain(text)

        _ENCODERS[name] = lambda text: np.concatenate([run(part) for part in segments(text)])
    return _ENCODERS[name]


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, doc: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document is its ids and end_id; only one
    longer than `size` is cut, into pieces of `size` of which the first takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            who, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(t or ""), np.array([end_id], dtype="<u4")).astype("<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at - 1) % size + 1 if at == 0 else size
                    who.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at, k = at + n, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _first_runs(counts: Counter, size: int) -> list[Run]:
    """Best fit, longest first: a sequence takes the longest piece that fits until none does; each run repeats one
    filling until a length runs out."""
    left, runs = Counter({k: v for k, v in counts.items() if v > 0}), []
    have = sorted(left)
    while have:
        pattern: list[int] = []
        room, took = size, Counter()
        while room:
            i = bisect_right(have, room) - 1
            while i >= 0 and took[have[i]] >= left[have[i]]:
                i -= 1
            if i < 0:
                break
            pattern.append(have[i])
            took[have[i]] += 1
            room -= have[i]
        m = min(left[k] // n for k, n in took.items())
        for k, n in took.items():
            left[k] -= n * m
        have = [k for k in have if left[k] > 0]
        runs.append((tuple(pattern), m))
    return runs


def _best_move(a: tuple[int, ...], b: tuple[int, ...], room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The move or exchange that adds most, at most `room`, to a from b: (gain, out of a, out of b)."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
    ones_a, ones_b = sorted(set(a)), sorted(set(b))
    twos = lambda x: {(p, q) for i, p in enumerate(x) for q in x[i + 1 :]}
    out_b = [(y,) for y in ones_b] + list(twos(b))
    for outs_a, outs_b in (([()], out_b[: len(ones_b)]), ([(x,) for x in ones_a], out_b), (list(twos(a)), out_b[: len(ones_b)])):
        for x in outs_a:
            for y in outs_b:
                if best[0] < (d := sum(y) - sum(x)) <= room:
                    best = (d, x, y)
    return best


def local_search(runs: list[Run], size: int) -> list[Run]:
    """Exchange one for one, two for one, or move pieces between underfull sequences while the sum of squared
    fills grows; sequences that empty are gone. Equal sequences are held as one run, so that a step changes
    many at once. Ends when no pair of runs has a step left; a pair that had none is not looked at again."""
    state = Counter()
    for p, m in runs:
        state[tuple(sorted(p, reverse=True))] += m
    full = Counter({p: m for p, m in state.items() if sum(p) == size})
    under = Counter({p: m for p, m in state.items() if sum(p) < size})
    fruitless: set[tuple[tuple[int, ...], tuple[int, ...]]] = set()
    again = True
    while again:
        again = False
        for a in sorted(under, key=sum, reverse=True):
            for b in sorted(under, key=sum):
                if not under[a]:
                    break
                if sum(b) > sum(a) or not under[b] or (a, b) in fruitless:
                    continue
                m = under[a] // 2 if a == b else min(under[a], under[b])
                if not m:
                    continue
                d, x, y = _best_move(a, b, size - sum(a))
                if not d:
                    fruitless.add((a, b))
                    continue
                new_a = tuple(sorted((Counter(a) - Counter(x) + Counter(y)).elements(), reverse=True))
                new_b = tuple(sorted((Counter(b) - Counter(y) + Counter(x)).elements(), reverse=True))
                under[a] -= m
                under[b] -= m
                (full if sum(new_a) == size else under)[new_a] += m
                if new_b:
                    under[new_b] += m
                again = True
        under = +under
    return [(p, m) for p, m in [*full.items(), *under.items()] if m]


def pack_histogram(counts: dict[int, int], size: int = 1024) -> list[Run]:
    """Fillings of sequences of `size` and how many sequences have each, for so many pieces of each length."""
    return local_search(_first_runs(Counter(counts), size), size)


def _slots(runs: list[Run]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of a run of places, its first sequence, places in each sequence, offset of the first."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for p, m in runs:
        offset = 0
        for length, n in sorted(Counter(p).items(), reverse=True):
            out.setdefault(length, []).append((rank[length], sequence, n, offset))
            rank[length] += n * m
            offset += n * length
        sequence += m
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def place(found: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    What a sequence can hold depends on lengths alone, so the packing is made of the count of each length (at most
    `size` numbers on the driver, at any scale). A piece's rank among those of its length then says its place.
    Ranks are dealt over groups of (length, salt), salted by the place of the written row: a length that holds a third
    of all rows is no hot task, nor are rows that repeat.
    """
    found = stash(found.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r["count"] for r in found.groupBy("length").count().collect()}
    slots = found.sparkSession.sparkContext.broadcast(_slots(pack_histogram(counts, size)))
    salts = max(16, sum(counts.values()) // 500_000)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_at")))
    found = found.drop("_at")
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).select(*found.columns, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in batches:
            length, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, sequence, n, offset = table[int(k)]
                j = np.searchsorted(first, rank[at], side="right") - 1
                seq[at] = sequence[j] + (rank[at] - first[j]) // n[j]
                off[at] = offset[j] + (rank[at] - first[j]) % n[j] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs all documents into as few sequences of at most `size` tokens as the search finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null or empty text is the one
    end token. Null or repeated doc_id: each row is packed by itself, its pieces counted from 0. An empty table
    gives no rows. Other columns of docs play no part. Very long texts are read whole, one at a time, in runs of words.
    """
    return place(pieces(docs, size, end_id), size)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
