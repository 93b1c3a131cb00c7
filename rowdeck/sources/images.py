"""Image files as rows of pixels.

Spark lists the files, packs them into tasks by their bytes and reads them, from any store it
knows; tasks decode with zlib and numpy. Understood are PNG (not interlaced, up to eight bits
a channel), binary PNM (P5, P6) and uncompressed BMP (24 and 32 bits).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rowdeck.sources.files import read_binary

PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # of the colour types of PNG
GRAY = (299, 587, 114)  # weights of red, green and blue in a thousandth
OUT_BYTES = 1 << 24  # of decoded pixels handed on at once, unless one image is larger
SCHEMA = "path string, height int, width int, image binary, error string"


def to_rgb(pixels: np.ndarray) -> np.ndarray:
    """Height x width x channels (gray, gray and alpha, RGB or RGBA) as RGB; alpha is left out."""
    if pixels.shape[2] < 3:
        return np.repeat(pixels[:, :, :1], 3, axis=2)
    return np.ascontiguousarray(pixels[:, :, :3])


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB, rounded; gray stays."""
    if pixels.shape[2] < 3:
        return np.ascontiguousarray(pixels[:, :, :1])
    weighted = pixels[:, :, :3].astype(np.uint32) @ np.array(GRAY, np.uint32)
    return ((weighted + 500) // 1000).astype(np.uint8)[:, :, None]


def _unfiltered(data: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Undo the row filters of PNG; ``step`` is the bytes of a whole pixel."""
    rows = data.reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # with a blank row above and blank pixels on the left
    for y in range(height):
        kind, line, above, row = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            row[step:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            row[step:] = line + above[step:]
        elif kind in (3, 4):
            left, corner = [0] * step, [0] * step
            up, values = above[step:].tolist(), line.tolist()
            done = []
            for x, value in enumerate(values):
                a, b, c = left[x % step], up[x], corner[x % step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                value = (value + guess) & 255
                done.append(value)
                left[x % step], corner[x % step] = value, b
            row[step:] = done
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out[1:, step:]


def _png(data: bytes) -> np.ndarray:
    at, head, palette, packed = len(PNG), None, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth > 8 or interlaced or colour not in CHANNELS:
        raise ValueError("a kind of PNG that is not supported")
    bits = depth * CHANNELS[colour]
    stride = -(-width * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    rows = _unfiltered(raw, height, stride, max(1, bits // 8))
    if depth < 8:
        unpacked = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        rows = unpacked @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    if colour == 3:
        return palette[rows.reshape(height, width)]
    return rows.reshape(height, width, CHANNELS[colour])


def _pnm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if head is None or not 0 < int(head[4]) < 256:
        raise ValueError("a kind of PNM that is not supported")
    width, height, most, channels = int(head[2]), int(head[3]), int(head[4]), 1 if head[1] == b"5" else 3
    pixels = np.frombuffer(data, np.uint8, width * height * channels, head.end()).reshape(height, width, channels)
    return pixels if most == 255 else (pixels.astype(np.uint32) * 255 // most).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("a kind of BMP that is not supported")
    step, stride = bits // 8, (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    pixels = rows[:: -1 if height > 0 else 1, : width * step].reshape(abs(height), width, step)
    return pixels[:, :, [2, 1, 0]]


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels of an image file, eight bits each; ValueError if it cannot be read."""
    try:
        if data.startswith(PNG):
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, zlib.error, IndexError, TypeError) as error:
        raise ValueError(f"the file is damaged: {error}") from None
    raise ValueError("not an image of a known kind")


def read_images(
    spark: SparkSession, path: str, mode: str = "RGB", pattern: str | None = None, broken: str = "fail"
) -> DataFrame:
    """``(path, height, width, image)``: the pixels of every file below ``path``, rows from the top,
    three bytes each in mode "RGB", one in mode "L".

    ``broken`` says what a file that cannot be decoded does: "fail" the job, or "report" itself in an
    ``error`` column, NULL for good files. Spark does not list files of no bytes. ``pixels`` gives
    the array of a row.
    """
    if mode not in ("RGB", "L"):
        raise ValueError(f"unknown mode: {mode}")
    if broken not in ("fail", "report"):
        raise ValueError("broken files either fail or are reported")
    change = to_rgb if mode == "RGB" else to_gray
    kinds = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("image", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                try:
                    found = change(decode(content.as_py()))
                    rows.append((name.as_py(), found.shape[0], found.shape[1], found.tobytes(), None))
                    size += found.nbytes
                except ValueError as error:
                    if broken == "fail":
                        raise ValueError(f"{name.as_py()}: {error}") from None
                    rows.append((name.as_py(), None, None, None, str(error)))
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    files = read_binary(spark, path, pattern).select("path", "content")
    images = files.mapInArrow(run, SCHEMA)
    return images if broken == "report" else images.drop("error")


def pixels(height: int, width: int, image: bytes) -> np.ndarray:
    """The array of a row: height x width x 3, or height x width x 1."""
    return np.frombuffer(image, np.uint8).reshape(height, width, -1)
