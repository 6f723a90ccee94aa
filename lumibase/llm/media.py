"""Media columns: bytes as PNG images in a binary column, and low-frequency cosine-transform hashes of such images.

A payload is stored as a greyscale PNG of eight bits a sample: 64 samples a row, as many rows as it takes. The rows
are zlib-compressed chunks behind a checksum each; reading tests the signature, every chunk's CRC-32, the header and
the length of the inflated rows, and undoes the five row filters with numpy. What fails a test raises ValueError.

The feature of an image is the sign pattern of its lowest cosine frequencies: means over a 32 by 32 grid, an
orthogonal transform, and for each of the 8 by 8 lowest frequencies (the constant one left out) whether it is above
their median: 16 hexadecimal digits.

Defined results: a null or empty text is one row of zeros. Equal texts have equal images and features. A null id and
further columns are kept or not read, as said at each function; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumibase.llm.shared import small_batches, text_or_empty

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
GRID, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of a row."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def write_png(payload: bytes, level: int = 3) -> bytes:
    """A greyscale PNG of the payload, whose length is a multiple of the row. A row that is closer to the one above
    than to zero (by the sum of absolute differences) is stored as its difference from that."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    change = rows - above
    weight = lambda x: np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1)
    up = 2 * weight(change) < weight(rows)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = 2 * up
    lines[:, 1:] = np.where(up[:, None], change, rows)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the row filters 0 to 4 of one-byte samples; runs of rows without dependence are done at once."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    left = np.flatnonzero(kinds == 1)
    rows[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    n = 0
    while n < len(rows):
        if kinds[n] == 2:
            stop = n + 1
            while stop < len(rows) and kinds[stop] == 2:
                stop += 1
            rows[n:stop] = np.cumsum(rows[max(n - 1, 0) : stop], axis=0, dtype=np.uint8)[min(n, 1) :]
            n = stop
            continue
        if kinds[n] > 2:
            own = rows[n].tolist()
            over = rows[n - 1].tolist() if n else [0] * len(own)
            a = c = 0
            for k, b in enumerate(over):
                if kinds[n] == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                a, c = (own[k] + guess) & 255, b
                own[k] = a
            rows[n] = own
        n += 1
    return rows


def read_png(media: bytes) -> np.ndarray:
    """The samples of a greyscale PNG of eight bits, not interlaced."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, size, data = 8, None, []
    while True:
        if at + 12 > len(media):
            raise ValueError("the PNG ends too early")
        (length,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if len(body) != length or struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum of chunk {kind!r}")
        at += 12 + length
        if kind == b"IHDR":
            *size, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, packing, filtering, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("only greyscale of eight bits is read")
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if size is None:
        raise ValueError("no header")
    width, height = size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != (width + 1) * height:
        raise ValueError("rows are missing")
    return _unfilter(lines.reshape(height, width + 1))


def _basis() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * GRID)) * np.where(k == 0, np.sqrt(1 / GRID), np.sqrt(2 / GRID))


BASIS = _basis()


def _averaged(samples: np.ndarray, axis: int) -> np.ndarray:
    """Means over GRID equal parts of an axis; where it is shorter, samples are repeated."""
    n = samples.shape[axis]
    at = np.arange(GRID) * n // GRID
    end = np.maximum((np.arange(GRID) + 1) * n // GRID, at + 1)
    total = np.concatenate((np.zeros_like(samples.take([0], axis)), np.cumsum(samples, axis=axis)), axis=axis)
    shape = (-1, 1) if axis == 0 else (1, -1)
    return (total.take(end, axis) - total.take(at, axis)) / (end - at).reshape(shape)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits of the signs of the lowest frequencies around their median."""
    grid = _averaged(_averaged(samples.astype(np.float64), 0), 1)
    low = np.round((BASIS @ grid @ BASIS.T).ravel(), 6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def text_to_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text's UTF-8) and media: a PNG of these bytes, with zeros up to a whole row."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col), text_or_empty(text_col).cast("binary").alias("raw"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            media = pa.array([write_png(padded(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), media], names=[id_col, "n_bytes", "media"])

    return rows.mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


def media_features(df: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Adds payload (the image's bytes, read back) and feature; columns of these names are replaced. A null image has neither."""
    small_batches(df.sparkSession)
    df = df.drop("payload", "feature")
    fields = [*df.schema.fields]
    place = df.columns.index(media_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [None if m is None else read_png(m) for m in batch.column(place).to_pylist()]
            payload = pa.array([None if s is None else s.tobytes() for s in read], pa.binary())
            feature = pa.array([None if s is None else cosine_hash(s) for s in read], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, payload, feature], names=[*batch.schema.names, "payload", "feature"])

    return df.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "payload binary", "feature string"]))
