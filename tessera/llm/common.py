"""Shared pieces: stashes in the shared folder, byte-level word tables and 64-bit hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and driver
    and executors are one process (tests). A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_OWN_DIR[0]}"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches for Python workers of at most so many rows and about so many bytes, so that a worker's memory
    does not follow the length of texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stash_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = stash_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Maps A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words over letters and digits (after lower-casing) and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words between white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes or words that are hashed at once; what is held beside them and the result doesn't grow with a text.
CHUNK = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < CHUNK (base is odd)."""
    if base not in _POWERS:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p, k, step = np.ones(CHUNK, dtype=np.uint64), 1, b
            while k < CHUNK:
                p[k : 2 * k] = p[:k] * np.uint64(step)
                k, step = 2 * k, step * step & _MASK
            out.append(p)
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for many ranges at once (starts and ends ascend), by sums over the
    values up to each place, which go on from chunk to chunk."""
    p, inv = powers(base)
    out, unit = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.uint64)
    total, scale, back = 0, 1, 1
    onward, backward = pow(base, CHUNK, 1 << 64), pow(base, -CHUNK, 1 << 64)
    i = j = 0
    for at in range(0, len(values) + 1, CHUNK):
        part = values[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
        part *= p[: len(part)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        sums = sums * np.uint64(scale) + np.uint64(total)
        last = at + CHUNK - 1
        i2, j2 = (int(np.searchsorted(x, last, side="right")) for x in (start, end))
        out[i:i2] -= sums[start[i:i2] - at]
        unit[i:i2] = inv[start[i:i2] - at] * np.uint64(back)
        out[j:j2] += sums[end[j:j2] - at]
        total, scale, back, i, j = int(sums[-1]), scale * onward & _MASK, back * backward & _MASK, i2, j2
    return mix(out * unit + (end - start).astype(np.uint64))


class Words:
    """Words of a block of texts: buf (lower-cased bytes), start and end (byte places), hash, first (the index
    of each text's first word, and one past the last), base (each text's first byte in buf). Takes about five bytes
    a byte of text."""

    __slots__ = ("base", "buf", "end", "first", "hash", "start", "table")

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.base, self.table = np.zeros(len(texts) + 1, dtype=np.int64), table
        np.cumsum([len(t) + 1 for t in texts], out=self.base[1:])
        n = int(self.base[-1])
        self.buf = np.full(n, 32, dtype=np.uint8)
        np.take(LOWER, np.frombuffer(texts[0] if len(texts) == 1 else b" ".join(texts), dtype=np.uint8), out=self.buf[: max(0, n - 1)], mode="clip")
        kind = np.int32 if n < 2**31 else np.int64
        starts, ends, before = [np.zeros(0, dtype=kind)], [np.zeros(0, dtype=kind)], False
        for at in range(0, n, CHUNK):
            inside = np.concatenate([[before], table[self.buf[at : at + CHUNK]]])
            edge = inside[1:] != inside[:-1]
            starts.append((np.flatnonzero(edge & inside[1:]) + at).astype(kind))
            ends.append((np.flatnonzero(edge & inside[:-1]) + at).astype(kind))
            before = inside[-1]
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.hash = ranges_hash(self.buf, self.start, self.end, _P)
        self.first = np.searchsorted(self.start, self.base)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.base) - 1, dtype=np.int32), self.count())

    def normal(self) -> Iterator[bytes]:
        """Each text's words by one space."""
        keep = self.table[self.buf]
        keep[self.end] = True
        spaced = self.buf.copy()
        spaced[self.end] = 32
        for a, z in zip(self.base[:-1].tolist(), self.base[1:].tolist(), strict=True):
            yield spaced[a:z][keep[a:z]].tobytes()[:-1]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every run of n words within a text: first word, hash, text. Texts of fewer words have none."""
        own = self.owner()
        at = np.flatnonzero(own[: max(0, len(own) - n + 1)] == own[n - 1 :])
        return at, ranges_hash(self.hash, at, at + n, 0xD6E8FEB86659FD93), own[at]

    def wholes(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of 1 to below - 1 words: text, and hash of the whole sequence (as windows() of that length)."""
        n = self.count()
        who = np.flatnonzero((n > 0) & (n < below))
        return who, ranges_hash(self.hash, self.first[who], self.first[who] + n[who], 0xD6E8FEB86659FD93)

    def joined(self, at: int, n: int) -> bytes:
        """Words at .. at + n - 1, by one space."""
        return b" ".join(self.buf[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n))


def blocks(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) in runs of about `size` bytes; a longer text is a run of its own. Null counts as empty."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and n + len(t) > size:
            yield first, held
            first, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield first, held
