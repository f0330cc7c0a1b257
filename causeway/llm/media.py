"""Media columns: texts kept as PNG images in a binary column, read back with checks, with cosine-transform hashes."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed values of the PNG format: its signature and the row filters by number.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
CHUNK = 1 << 16
FACTS = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])


def pad(data: bytes) -> bytes:
    """data with zero bytes up to the next positive multiple of 64."""
    return data + b"\0" * ((-len(data)) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _entropy(a: np.ndarray) -> float:
    n = np.bincount(a.ravel(), minlength=256)
    n = n[n > 0]
    return float(-(n * np.log2(n / a.size)).sum())


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """The residual of 8-bit grey rows under one filter; arithmetic is modulo 256."""
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up[1:] = rows[:-1]
    if kind == NONE:
        return rows
    if kind == SUB:
        return rows - left
    if kind == UP:
        return rows - up
    if kind == AVERAGE:
        return rows - ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[1:, 1:] = rows[:-1, :-1]
    return rows - _nearest(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)


def _nearest(a, b, c):
    """The one of left, up and corner that is nearest to left + up - corner; ties go in this order."""
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def encode_png(payload: bytes, kind: int | None = None, level: int = 6) -> bytes:
    """An 8-bit grey PNG, 64 pixels wide. kind: the row filter; None takes the one of least residual entropy."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    if kind is None:
        kind = min((NONE, SUB, UP), key=lambda k: (_entropy(filtered(rows, k)), k))
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = filtered(rows, kind)
    data = zlib.compress(lines.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undoes the row filters. Runs of rows with the same simple filter are done at once."""
    out = lines.copy()
    at, height = 0, len(lines)
    ends = np.flatnonzero(np.diff(kinds)) + 1
    for end in [*ends.tolist(), height]:
        kind = kinds[at]
        above = out[at - 1] if at else np.zeros(lines.shape[1], np.uint8)
        if kind == SUB:
            out[at:end] = np.cumsum(lines[at:end], axis=1, dtype=np.uint64).astype(np.uint8)
        elif kind == UP:
            out[at:end] = (np.cumsum(lines[at:end], axis=0, dtype=np.uint64) + above).astype(np.uint8)
        elif kind in (AVERAGE, PAETH):
            for r in range(at, end):
                up = out[r - 1].astype(int) if r else np.zeros(lines.shape[1], int)
                left = corner = 0
                row = out[r]
                for c in range(lines.shape[1]):
                    guess = (left + int(up[c])) // 2 if kind == AVERAGE else int(_nearest(np.int64(left), up[c], np.int64(corner)))
                    left, corner = (int(lines[r, c]) + guess) & 255, int(up[c])
                    row[c] = left
        elif kind != NONE:
            raise ValueError(f"unknown PNG filter {kind}")
        at = end
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The grey samples of an 8-bit PNG. Raises ValueError on a wrong signature, length, checksum or format."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a PNG chunk is cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of PNG chunk {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only whole 8-bit grey PNGs without interlace are read")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if lines.size != head[1] * (head[0] + 1):
        raise ValueError("PNG samples are missing")
    lines = lines.reshape(head[1], head[0] + 1)
    return unfiltered(lines[:, 0], lines[:, 1:])


SIDE, LOW = 32, 8
_BASIS = np.array([[math.cos(math.pi * k * (2 * i + 1) / (2 * SIDE)) for i in range(SIDE)] for k in range(LOW + 1)])


def cosine_hash(image: np.ndarray) -> str:
    """64 bits, as hex: the low-frequency cosine coefficients of the image shrunk to 32 x 32, each against their median."""
    h, w = image.shape
    at = lambda n: np.minimum((np.arange(SIDE) * n) // SIDE, n - 1)
    wide = image.astype(np.float64).reshape(h, SIDE, w // SIDE).mean(axis=2) if w % SIDE == 0 else image[:, at(w)].astype(np.float64)
    if h > SIDE:
        edges = at(h)
        small = np.add.reduceat(wide, edges, axis=0) / np.diff([*edges, h])[:, None]
    else:
        small = wide[at(h)]
    low = (_BASIS @ small @ _BASIS.T)[1:, 1:].ravel().round(6)
    return np.packbits(low > np.median(low)).tobytes().hex()


@F.arrow_udf(T.BinaryType())
def _store(text: pa.Array) -> pa.Array:
    return pa.array([encode_png(pad((t or "").encode())) for t in text.to_pylist()], pa.binary())


@F.arrow_udf(FACTS)
def _load(media: pa.Array) -> pa.Array:
    sizes, hashes, tails, marks = [], [], [], []
    for data in media:
        image = decode_png(data.as_py())
        payload = image.tobytes()
        sizes.append(len(payload))
        hashes.append(hashlib.sha256(payload).hexdigest())
        tails.append(zlib.crc32(payload[-WIDTH:]))
        marks.append(cosine_hash(image))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(tails, pa.int64()), pa.array(marks, pa.string())], names=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a binary column of PNG images that hold the texts' UTF-8 bytes and zero bytes up to a multiple of 64.

    Null and empty texts become 64 zero bytes. An existing column of the same name is replaced; other columns stay.
    Rows are independent: repeated rows give equal images, an empty table an empty one, long texts many IDAT chunks.
    """
    common.small_batches(df.sparkSession)
    return df.withColumn(media, _store(common.whole_text(text)))


def load(df: DataFrame, media: str = "media", facts: str = "facts") -> DataFrame:
    """df with a struct of what is read back: payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), feature.

    feature is a 64-bit cosine-transform hash. A damaged image fails the job: its checksums don't hold. A null image is not allowed.
    """
    common.small_batches(df.sparkSession)
    return df.withColumn(facts, _load(F.col(media)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", common.whole_text().alias("text"))
    read = load(store(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media"))
    return read.select("doc_id", "n_bytes", "facts.payload_bytes", "facts.payload_sha256", "facts.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "facts.feature")
