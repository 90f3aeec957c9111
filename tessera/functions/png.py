"""PNG images of tiles (grey, colour, colour with opacity; deflate level 9), by Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed by the format.
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels to the format's colour type.
_KINDS = {1: 0, 3: 2, 4: 6}


def encode(image: np.ndarray) -> bytes:
    """An 8-bit image: rows, columns and, unless it is grey, three or four channels."""
    h, w = image.shape[:2]
    channels = image.shape[2] if image.ndim == 3 else 1

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.hstack([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, w * channels)])
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, _KINDS[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels of what encode() made; other kinds of PNG are an error."""
    at, body, size = len(_MAGIC), b"", (0, 0, 1)
    if not data.startswith(_MAGIC):
        raise ValueError("no PNG")
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            w, h, *form = struct.unpack(">IIBBBBB", part)
            if form[0] != 8 or form[1] not in _KINDS.values() or form[2:] != [0, 0, 0]:
                raise ValueError("not a plain 8-bit image")
            size = (h, w, next(c for c, k in _KINDS.items() if k == form[1]))
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[0], size[1] * size[2] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:] if size[2] == 1 else rows[:, 1:].reshape(size)


def tile_images(cells: DataFrame, shift: int, value: str | list[str] = "mask") -> DataFrame:
    """(x, y, png) of tiles of 2^shift pixels a side, from one row per pixel (px, py, value 0..255, or a list of three or
    four channels); absent pixels are 0. A tile's pixels are collected, which are 4^shift at most."""
    from pyspark.sql import functions as F

    side = 1 << shift
    channels = [value] if isinstance(value, str) else value
    place = F.col("py").bitwiseAND(side - 1) * side + F.col("px").bitwiseAND(side - 1)
    pixel = F.struct(place.alias("i"), F.array(*[F.col(c).cast("int") for c in channels]).alias("v"))
    grouped = cells.groupBy(F.shiftright("px", shift).alias("x"), F.shiftright("py", shift).alias("y")).agg(F.collect_list(pixel).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in b.column(2).to_pylist():
                image = np.zeros((side * side, len(channels)), np.uint8)
                image[[p["i"] for p in c]] = [p["v"] for p in c]
                out.append(encode(image.reshape((side, side, -1) if len(channels) > 1 else (side, side))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["x", "y", "png"])

    return grouped.mapInArrow(run, "x int, y int, png binary")


def image_pixels(images: DataFrame) -> DataFrame:
    """(x, y, width, height, pixels array) of (x, y, png); the channels of a pixel stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g.shape[1] for g in found], pa.int32()), pa.array([g.shape[0] for g in found], pa.int32()), pa.array([g.ravel().astype(np.int32).tolist() for g in found], pa.list_(pa.int32()))],
                ["x", "y", "width", "height", "pixels"],
            )

    return images.mapInArrow(run, "x int, y int, width int, height int, pixels array<int>")
