"""Metatiles in a binary form of our own, by Arrow batches.

A file is the mark TMT1; level, order and the first column and row (little-endian); and, deflated, a bit for each of the
4^order nodes in row order and a byte of flags for each node that is there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MARK, _HEAD = b"TMT1", struct.Struct("<4sBBii")


def encode(lod: int, order: int, bx: int, by: int, x: np.ndarray, y: np.ndarray, flags: np.ndarray) -> bytes:
    """A metatile of nodes x, y with flags (0 to 255); a node counts once."""
    side = 1 << order
    place = (y - by) * side + (x - bx)
    at = np.argsort(place)
    there = np.zeros(side * side, dtype=bool)
    there[place] = True
    if there.sum() != len(place):
        raise ValueError("a node stands twice")
    return _HEAD.pack(_MARK, lod, order, bx, by) + zlib.compress(np.packbits(there).tobytes() + flags[at].astype(np.uint8).tobytes(), 9)


def decode(data: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(lod, bx, by, x, y, flags) of what encode() made, nodes in row order; anything else is an error."""
    if len(data) < _HEAD.size or not data.startswith(_MARK):
        raise ValueError("no metatile")
    _, lod, order, bx, by = _HEAD.unpack_from(data)
    side = 1 << order
    body = np.frombuffer(zlib.decompress(data[_HEAD.size :]), dtype=np.uint8)
    bits = -(-side * side // 8)
    place = np.flatnonzero(np.unpackbits(body[:bits], count=side * side))
    if len(body) - bits != len(place):
        raise ValueError("flags and nodes differ in number")
    return lod, bx, by, bx + place % side, by + place // side, body[bits:]


def metatile_files(tiles: DataFrame, order: int = 5) -> DataFrame:
    """(lod, bx, by, content) of metatiles (lod, bx, by, nodes array of y, x, flags)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lod, bx, by, nodes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y, flags = (np.array([n[k] for n in nodes], dtype=np.int64) for k in ("x", "y", "flags"))
                out.append(encode(lod, order, bx, by, x, y, flags))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["lod", "bx", "by", "content"])

    return tiles.select("lod", "bx", "by", "nodes").mapInArrow(run, "lod int, bx int, by int, content binary")


def metatile_nodes(files: DataFrame, content: str = "content") -> DataFrame:
    """(lod, bx, by, x, y, flags) of the nodes of metatiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                lod, bx, by, x, y, flags = decode(data)
                cols = [np.full(len(x), v) for v in (lod, bx, by)] + [x, y, flags]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols], ["lod", "bx", "by", "x", "y", "flags"])

    return files.select(content).mapInArrow(run, "lod int, bx int, by int, x int, y int, flags int")
