"""Media columns: texts as greyscale PNG files, and perceptual features of what is read back.

A payload becomes an image of 64 columns of 8-bit samples. The reader walks the chunks, tests every
checksum, inflates the image data and undoes the five row filters; the features are the signs of the low
frequencies of a cosine transform of the image, shrunk to 32 by 32 by area.

Scale: rows stand alone, no shuffle; a task holds one Arrow batch. Defined cases: null and empty text is
one row of zeros; equal texts give equal bytes; damaged files raise MediaError; other columns are kept
by encode() and decode(), but for those named like the new ones, which these replace.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import text_batches, without

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
BATCH_BYTES = 8 << 20


class MediaError(ValueError):
    """The bytes are no PNG of this kind, or a checksum fails."""


def payload(text: str | None) -> bytes:
    """UTF-8, zeros appended up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """The image's rows with one filter, each after its filter byte. 0 none, 1 left, 2 up, 3 mean, 4 Paeth."""
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    up = np.zeros_like(image)
    up[1:] = image[:-1]
    if kind == 3:
        guess = ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    elif kind == 4:
        corner = np.zeros_like(image)
        corner[1:, 1:] = image[:-1, :-1]
        guess = paeth(left, up, corner)
    else:
        guess = (np.zeros_like(image), left, up)[kind]
    return np.concatenate([np.full((len(image), 1), kind, np.uint8), image - guess], axis=1)


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def write_png(data: bytes, kind: int = 2, level: int = 1) -> bytes:
    image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered(image, kind).tobytes(), level)) + chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters: stretches of rows of one kind at once where the kind allows it."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    heads = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
    for at, to in zip(heads, np.append(heads[1:], len(rows)), strict=True):
        kind = kinds[at]
        if kind == 1:
            np.add.accumulate(out[at:to], axis=1, out=out[at:to])
        elif kind == 2:
            if at:
                out[at] += out[at - 1]
            np.add.accumulate(out[at:to], axis=0, out=out[at:to])
        elif kind in (3, 4):
            for y in range(at, to):
                row, up = out[y].tolist(), out[y - 1].tolist() if y else [0] * out.shape[1]
                left = corner = 0
                for x, b in enumerate(up):
                    if kind == 3:
                        left = (row[x] + ((left + b) >> 1)) & 255
                    else:
                        p = left + b - corner
                        near = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                        left = (row[x] + near) & 255
                    row[x], corner = left, b
                out[y] = row
        elif kind > 4:
            raise MediaError(f"row filter {kind}")
    return out


def read_png(media: bytes) -> np.ndarray:
    """The image of an 8-bit greyscale PNG without interlace; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, size, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("a chunk is cut off")
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if size is None or not ended or size[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not an 8-bit greyscale image")
    raw = zlib.decompress(b"".join(data))
    if len(raw) != size[1] * (size[0] + 1):
        raise MediaError("image data of another length")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(size[1], size[0] + 1))


def shares(n: int, side: int) -> np.ndarray:
    """side by n: what part of each of n samples an even area of 1/side of them covers, scaled to sum 1."""
    edges = np.arange(side + 1) * (n / side)
    cover = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.maximum(cover, 0) * (side / n)


_COSINE = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5) * np.arange(LOW)[:, None])
_ACROSS = shares(WIDTH, SIDE)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: low frequencies of the image above their median; the constant part counts as 0."""
    sums = np.zeros((len(image) + 1, image.shape[1]))
    np.cumsum(image, axis=0, out=sums[1:])
    edges = np.arange(SIDE + 1) * (len(image) / SIDE)
    low = np.minimum(edges.astype(np.int64), len(image) - 1)
    at = sums[low] + (edges - low)[:, None] * image[low]
    small = np.diff(at, axis=0) * (SIDE / len(image))
    across = _ACROSS if image.shape[1] == WIDTH else shares(image.shape[1], SIDE)
    waves = _COSINE @ (small @ across.T) @ _COSINE.T
    waves = np.round(waves, 6).ravel()
    waves[0] = 0
    return np.packbits(waves > np.median(waves)).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch], kind: int, level: int, keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "text", BATCH_BYTES):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if keep or n != "text"}
        columns["n_bytes"] = pa.array([len((t or "").encode()) for t in texts], pa.int64())
        columns["media"] = pa.array([write_png(payload(t), kind, level) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def encode(docs: DataFrame, row_filter: int = 2, level: int = 1, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes and media, the text as a PNG file."""
    docs = without(docs, "n_bytes", "media")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.mapInArrow(lambda b: _encode(b, row_filter, level, keep_text), schema)


def _decode(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "media", BATCH_BYTES):
        rows: list[tuple] = []
        for media in batch.column(batch.schema.get_field_index("media")).to_pylist():
            if media is None:
                rows.append((None,) * 6)
                continue
            image = read_png(media)
            data = image.tobytes()
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
        columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if keep or n != "media"}
        for i, (name, kind) in enumerate(_FEATURES):
            columns[name] = pa.array([r[i] for r in rows], pa.int64() if kind == "long" else pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_FEATURES = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]


def decode(media: DataFrame, keep_media: bool = True) -> DataFrame:
    """Reads the media column back; adds sizes, digests and the feature."""
    media = without(media, *[name for name, _ in _FEATURES])
    fields = [f for f in media.schema.fields if keep_media or f.name != "media"]
    schema = T.StructType(fields)
    for name, kind in _FEATURES:
        schema = schema.add(name, kind)
    return media.mapInArrow(lambda b: _decode(b, keep_media), schema)
