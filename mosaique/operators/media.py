"""Decoding, resizing, thumbnails and model input, in numpy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig
from . import jpeg, readers


class Undecodable(ValueError):
    """Bytes that are no image this module can read."""


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG rows without their filters."""
    out = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.int32)
    for y in range(height):
        start = y * (stride + 1)
        kind, row = raw[start], np.frombuffer(raw, dtype=np.uint8, count=stride, offset=start + 1).astype(np.int32)
        if kind == 2:
            row = (row + above) & 255
        elif kind == 1:
            row = (row.reshape(-1, step).cumsum(axis=0) & 255).ravel()
        elif kind in (3, 4):
            done = np.zeros(stride + step, dtype=np.int32)
            up = np.concatenate([np.zeros(step, dtype=np.int32), above])
            for x in range(stride):
                a, b, c = int(done[x]), int(up[x + step]), int(up[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                done[x + step] = (int(row[x]) + guess) & 255
            row = done[step:]
        elif kind:
            raise Undecodable("filter")
        out[y], above = row, row
    return out


#: The passes of an interlaced PNG as first row, first column, steps of rows and of columns.
ADAM7 = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def _samples(raw: bytes, height: int, width: int, channels: int, depth: int) -> np.ndarray:
    """Rows of PNG samples, of two bytes the first."""
    stride = (width * channels * depth + 7) // 8
    rows = _unfilter(raw, height, stride, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return rows[:, : width * channels].reshape(height, width, channels)


def _decode_png(data: bytes) -> np.ndarray:
    at, packed, palette = 8, [], None
    width = height = depth = color = interlace = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth not in (1, 2, 4, 8, 16) or interlace > 1 or color not in (0, 2, 3, 4, 6):
                raise Undecodable("kind of PNG")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color, 0)
    raw = zlib.decompress(b"".join(packed))
    passes = ADAM7 if interlace else [(0, 0, 1, 1)]
    parts = [(y, x, dy, dx, -(-(height - y) // dy), -(-(width - x) // dx)) for y, x, dy, dx in passes if height > y and width > x]
    if not width or not height or len(raw) < sum(h * ((w * channels * depth + 7) // 8 + 1) for *_, h, w in parts):
        raise Undecodable("short PNG")
    pixels, at = np.zeros((height, width, channels), dtype=np.uint8), 0
    for y, x, dy, dx, h, w in parts:
        size = h * ((w * channels * depth + 7) // 8 + 1)
        pixels[y::dy, x::dx] = _samples(raw[at : at + size], h, w, channels, depth)
        at += size
    if color == 3:
        if palette is None:
            raise Undecodable("no palette")
        return palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    if depth < 8:
        pixels = pixels * np.uint8(255 // ((1 << depth) - 1))
    return np.repeat(pixels[:, :, :1], 3, axis=2) if color in (0, 4) else pixels[:, :, :3]


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if size < 40 or bits not in (24, 32) or packing not in (0, 3) or width <= 0 or not height:
        raise Undecodable("kind of BMP")
    step = bits // 8
    stride = (width * step + 3) // 4 * 4
    rows = np.frombuffer(data, dtype=np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)
    pixels = rows[:, : width * step].reshape(abs(height), width, step)[:, :, 2::-1]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)


def decode(data: bytes | None, wanted: Callable[[int, int], tuple[int, int]] | None = None) -> np.ndarray:
    """Pixels (height, width, RGB) by the content, whatever the name; transparency is dropped. PNG, BMP, JPEG
    and GIF (the first frame) are read. wanted lets a JPEG be smaller, as of readers.decode_jpeg."""
    try:
        if data and data.startswith(b"\x89PNG\r\n\x1a\n"):
            return _decode_png(data)
        if data and data.startswith(b"BM"):
            return _decode_bmp(data)
        if data and data.startswith(b"\xff\xd8\xff"):
            return readers.decode_jpeg(data, wanted)
        if data and data.startswith((b"GIF87a", b"GIF89a")):
            return readers.decode_gif(data)
    except (struct.error, zlib.error, ValueError, LookupError, TypeError) as error:
        raise Undecodable(str(error)) from error
    raise Undecodable("unknown format")


def encode_png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


@lru_cache(maxsize=64)
def _lanczos(old: int, new: int, lobes: int = 3) -> np.ndarray:
    """Weights (new, old) of a windowed sinc, wider when an image shrinks."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    x = (np.arange(old) - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """By Lanczos windows of three lobes, without regard to the aspect."""
    mixed = np.einsum("yh,hwc->ywc", _lanczos(pixels.shape[0], height), pixels.astype(np.float64))
    mixed = np.einsum("xw,ywc->yxc", _lanczos(pixels.shape[1], width), mixed)
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def preprocess(pixels: np.ndarray, config: ModelConfig) -> np.ndarray:
    """Model input (3, height, width): resized, scaled to 0..1, standardised."""
    scaled = resize(pixels, config.height, config.width).astype(np.float32) / 255.0
    return ((scaled - np.float32(config.mean)) / np.float32(config.std)).transpose(2, 0, 1)


def thumbnail_dims(width: int, height: int, size: int) -> tuple[int, int]:
    """Width and height that fit a square, cut to whole numbers in single precision, at least 1."""
    f = np.float32
    if width >= height:
        return size, max(1, int(f(height) / f(width) * f(size)))
    return max(1, int(f(width) / f(height) * f(size))), size


def thumbnail(data: bytes | None, size: int, quality: int = 80) -> bytes:
    """A JPEG that fits a square; a large JPEG is decoded at a part of its size."""
    dims: list[tuple[int, int]] = []

    def wanted(width: int, height: int) -> tuple[int, int]:
        dims.append(thumbnail_dims(width, height, size))
        return dims[0]

    pixels = decode(data, wanted)
    width, height = dims[0] if dims else thumbnail_dims(pixels.shape[1], pixels.shape[0], size)
    # large images are thinned first, as a full window over them would see no more
    step = max(1, min(pixels.shape[1] // (4 * width), pixels.shape[0] // (4 * height)))
    return jpeg.encode(resize(pixels[::step, ::step], height, width), quality)


def thumbnails(rows: DataFrame, size: int = 150, key: str = "path", content: str = "content") -> DataFrame:
    """Per distinct key and size: key, size, thumbnail (JPEG bytes, null if it cannot be made), its width and height,
    and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, made = batch.slice(i, 64), []
                for data in part.column(1):
                    try:
                        small = thumbnail(data.as_py(), size)
                        made.append((small, *jpeg.dimensions(small), None))
                    except Undecodable as error:
                        made.append((None, None, None, str(error)))
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string()]
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([size] * len(made), pa.int32()), *columns], ["key", "size", "thumbnail", "width", "height", "error"])

    once = rows.groupBy(key).agg(F.first(content, ignorenulls=True).alias("content"))
    return once.mapInArrow(run, "key string, size int, thumbnail binary, width int, height int, error string").withColumnRenamed("key", key)


def thumbnail_counts(made: DataFrame, column: str = "thumbnail") -> DataFrame:
    """One row: of how many images there is a thumbnail, and of how many there is none."""
    return made.agg(F.count_if(F.col(column).isNotNull()).alias("made"), F.count_if(F.col(column).isNull()).alias("failed"))


class ThumbnailCache:
    """Thumbnails as base64 by path and size, some thousands at most; a batch that is too many for that drops the
    oldest some hundred. Failures are not kept, so they are tried again."""

    def __init__(self, most: int = 4096, dropped: int = 256):
        self.most, self.dropped = most, dropped
        self.held: dict[tuple[str, int], str] = {}

    def batch(self, contents: DataFrame, paths: list[str], size: int = 150, force: bool = False) -> list[str | None]:
        """One entry for each path, null if it has no thumbnail. contents has path and content; only rows of the
        paths that are not held, all with force, are read."""
        wanted = list(dict.fromkeys(p for p in paths if force or (p, size) not in self.held))
        rows = thumbnails(contents.filter(F.col("path").isin(wanted)), size).select("path", F.base64("thumbnail").alias("text")).collect() if wanted else []
        fresh = {r["path"]: r["text"].replace("\r\n", "") for r in rows if r["text"]}
        out = [fresh.get(p) or self.held.get((p, size)) if p in fresh or not force else None for p in paths]
        for path, text in fresh.items():
            if (path, size) not in self.held and len(self.held) >= self.most:
                for key in list(self.held)[: self.dropped]:
                    del self.held[key]
            self.held[path, size] = text
        return out


def jvm_images(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width and pixels (RGB bytes) of what the JVM can decode (jpeg, png, gif, bmp); others are dropped."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                p = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                out.append(np.ascontiguousarray(np.repeat(p, 3, axis=2) if channels == 1 else p[:, :, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["path", "height", "width", "pixels"])

    return rows.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "path string, height int, width int, pixels binary")
