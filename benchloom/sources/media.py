"""Images and videos that need no codec library: PNG and PPM images, raw YUV4MPEG2 videos.

Each becomes frames as kernels take them: height, width, channels, pixels (BGR or grey).  Files that
cannot be read, or are of another format, give no frame; a video that is cut gives its whole frames.
A decoder of one's own for other formats is a function from bytes to an array, given as ``more``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "height int, width int, channels int, pixels binary"
Decoder = Callable[[bytes], "np.ndarray | None"]


def png(data: bytes) -> np.ndarray | None:
    """An image of 8 bits a sample that is not interlaced, channels in file order (RGB); alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 3, 4, 6):
        return None
    width, height, kind = head[0], head[1], head[3]
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width, step), np.int64)
    above = np.zeros((width, step), np.int64)
    for y in range(height):
        rule, line = int(rows[y, 0]), rows[y, 1:].reshape(width, step).astype(np.int64)
        if rule == 1:
            line = line.cumsum(axis=0) % 256
        elif rule == 2:
            line = (line + above) % 256
        elif rule in (3, 4):
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            for x in range(width):
                if rule == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = np.abs(p - left), np.abs(p - above[x]), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                line[x] = left = (line[x] + guess) % 256
                corner = above[x]
        out[y] = above = line
    if kind == 3:
        return None if palette is None else palette[out[..., 0]]
    return out[..., : 1 if kind in (0, 4) else 3].astype(np.uint8)


def ppm(data: bytes) -> np.ndarray | None:
    """A binary PPM or PGM image."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data)
    if not m:
        return None
    channels, width, height = 3 if m[1] == b"6" else 1, int(m[2]), int(m[3])
    body = data[m.end() :]
    size = height * width * channels
    return np.frombuffer(body[:size], np.uint8).reshape(height, width, channels) if len(body) >= size else None


def decoded(data: bytes, more: tuple[Decoder, ...] = ()) -> np.ndarray | None:
    """An image by the first decoder that can read it."""
    for decoder in (png, ppm, *more):
        try:
            if (got := decoder(data)) is not None:
                return got
        except (ValueError, zlib.error, struct.error, IndexError):
            continue
    return None


def row_of(image: np.ndarray) -> tuple[int, int, int, bytes]:
    """An RGB or grey image as a frame."""
    image = image if image.ndim == 3 else image[..., None]
    return (*image.shape, np.ascontiguousarray(image[..., ::-1]).tobytes())


def images(spark: SparkSession, path: str, more: tuple[Decoder, ...] = ()) -> DataFrame:
    """path and frame of the images below a folder that can be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(p, decoded(bytes(c), more)) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame([(p, *row_of(i)) for p, i in got if i is not None], columns=["path", "height", "width", "channels", "pixels"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(read, f"path string, {FRAME}")


def first_readable(wanted: DataFrame, readable: DataFrame) -> DataFrame:
    """(row_id, path): of each row's ``candidates`` the first that could be read; null where none could."""
    rows = wanted.select("row_id", F.posexplode("candidates").alias("at", "path"))
    best = rows.join(readable.select("path").distinct(), "path").groupBy("row_id").agg(F.min_by("path", "at").alias("path"))
    return wanted.select("row_id").join(best, "row_id", "left")


def y4m(data: bytes) -> Iterator[np.ndarray]:
    """The whole frames of a raw video of 8 bits with 4:2:0, 4:4:4 or no colour, as RGB."""
    line, _, body = data.partition(b"\n")
    if not line.startswith(b"YUV4MPEG2"):
        return
    marks = {m[:1]: m[1:].decode() for m in line.split()[1:]}
    width, height, colour = int(marks[b"W"]), int(marks[b"H"]), marks.get(b"C", "420")
    if "p1" in colour:
        return
    half = colour.startswith("420")
    plane = 0 if colour.startswith("mono") else ((width + 1) // 2) * ((height + 1) // 2) if half else width * height
    size = width * height + 2 * plane
    at = 0
    while (end := body.find(b"\n", at)) >= 0 and len(body) >= end + 1 + size:
        planes = np.frombuffer(body, np.uint8, size, end + 1).astype(float)
        y = planes[: width * height].reshape(height, width)
        u = v = np.full_like(y, 128.0)
        if plane:
            u, v = planes[width * height :].reshape(2, *((height + 1) // 2, (width + 1) // 2) if half else (height, width))
            if half:
                u, v = (c.repeat(2, 0).repeat(2, 1)[:height, :width] for c in (u, v))
        u, v = u - 128, v - 128
        yield np.clip(np.rint(np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], axis=2)), 0, 255).astype(np.uint8)
        at = end + 1 + size


def video_frames(spark: SparkSession, path: str) -> DataFrame:
    """name, video, frame and pixels of the videos below a folder; ``video`` is a hash of the name, which is that of the file without its end."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, video, content in zip(pdf["name"], pdf["video"], pdf["content"]):
                for k, frame in enumerate(y4m(bytes(content))):
                    yield pd.DataFrame([(name, video, k, *row_of(frame))], columns=["name", "video", "frame", "height", "width", "channels", "pixels"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    files = files.select(name.alias("name"), "content").withColumn("video", F.xxhash64("name"))
    return files.select("name", "video", "content").mapInPandas(read, f"name string, video bigint, frame bigint, {FRAME}")
