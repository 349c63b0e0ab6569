"""Media columns: bytes stored as PNG images, read back, and hashed by their low cosine frequencies.

A payload is laid out as 8-bit grey samples, 64 to a row. Writing makes the signature, IHDR, IDAT and IEND chunks
with their checksums; reading tests every checksum, inflates, and undoes the row filters in numpy. The hash shrinks
the picture to 32 x 32 means, takes the 8 x 8 lowest cosine coefficients and compares each with their median.

Cases: a null text is the empty one, whose payload is 64 zero bytes; a null or damaged picture reads as null
(payload and hash); equal bytes give equal pictures and hashes; an output column replaces one of the same name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import parts, table, text_of

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by PNG colour type; these are the 8-bit types without a palette.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
_SIDE, _LOW = 32, 8


def _cosines() -> np.ndarray:
    at, freq = np.arange(_SIDE), np.arange(_LOW)[:, None]
    return np.cos(np.pi * (2 * at + 1) * freq / (2 * _SIDE))


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """data with zero bytes up to the next positive multiple of unit."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, level: int = 6) -> bytes:
    """payload: whole rows of WIDTH grey samples; stored unfiltered, which suits text best."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo PNG row filters. Runs of rows without dependence on their left neighbour are done at once."""
    if not kinds.any():
        return lines
    out, above = lines.copy(), np.zeros(lines.shape[1], np.uint8)
    starts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(starts, starts[1:]):
        kind, part = kinds[a], out[a:b]
        if kind == 1:
            part[:] = np.cumsum(part.reshape(b - a, -1, bpp), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            part[0] += above
            part[:] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for row in part:
                left, corner = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
                for x in range(0, len(row), bpp):
                    up = above[x : x + bpp].astype(np.int32)
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        sides = np.stack([left, up, corner])
                        guess = np.take_along_axis(sides, np.abs(left + up - corner - sides).argmin(0)[None], 0)[0]
                    left, corner = (row[x : x + bpp] + guess) & 255, up
                    row[x : x + bpp] = left
                above = row
        elif kind > 4:
            raise ValueError("unknown row filter")
        above = out[b - 1]
    return out


def read_png(media: bytes) -> np.ndarray:
    """The samples, a row of bytes per picture row; ValueError if the file is damaged or of another type."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("chunk checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("no 8-bit picture without interlacing")
    width, height, bpp = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * bpp + 1)
    except (zlib.error, ValueError) as e:
        raise ValueError("picture data") from e
    return unfilter(raw[:, 0], raw[:, 1:], bpp)


def _shrink(image: np.ndarray, axis: int) -> np.ndarray:
    """Means of _SIDE equal spans along an axis; a span shorter than a sample takes the sample it lies in."""
    n = image.shape[axis]
    edges = np.arange(_SIDE + 1) * n // _SIDE
    total = np.concatenate([np.zeros_like(image.take([0], axis)), image.cumsum(axis)], axis)
    low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    shape = [-1, 1] if axis == 0 else [1, -1]
    return (total.take(high, axis) - total.take(low, axis)) / (high - low).reshape(shape)


def cosine_hash(image: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest cosine coefficients exceed their median (the constant one is left out of it)."""
    basis = _cosines()
    low = (basis @ _shrink(_shrink(image.astype(np.float64), 0), 1) @ basis.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def as_png(data: Column, level: int = 6) -> Column:
    """BINARY: a PNG whose samples are the bytes of data (UTF-8 for a string), zero-padded to whole rows."""

    @F.arrow_udf("binary")
    def write(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            yield pa.array([write_png(pad(x or b""), level) for x in part.to_pylist()], pa.binary())

    return write(data.cast("binary"))


def png_features(media: Column) -> Column:
    """STRUCT<payload BINARY, hash BINARY>: the samples read back and their cosine hash; nulls for what can't be read."""

    @F.arrow_udf("payload binary, hash binary")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            payloads, hashes = [], []
            for media in part.to_pylist():
                try:
                    image = None if media is None else read_png(media)
                except ValueError:
                    image = None
                payloads.append(None if image is None else image.tobytes())
                hashes.append(None if image is None or not image.size else cosine_hash(image))
            yield pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.array(hashes, pa.binary())], ["payload", "hash"])

    return read(media)


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `media` (the PNG), `payload` (read back from it) and `media_hash`."""
    stored = df.withColumn("media", as_png(text_of(text))).withColumn("_read", png_features(F.col("media")))
    return stored.withColumn("payload", F.col("_read.payload")).withColumn("media_hash", F.col("_read.hash")).drop("_read")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every whole text of documents as a PNG, reads it back and reports digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_media(docs).select(
        "doc_id",
        F.octet_length(text_of()).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("media_hash")).alias("feature"),
    )
