"""Grey pages as PNG bytes, with numpy and zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GREY = np.array([0.299, 0.587, 0.114])


#: Rows undone together along diagonals, where at least one row in so many has a filter that needs the byte before; fewer are undone byte by byte.
DIAGONAL_ROWS, DIAGONAL_SHARE = 1024, 2


def _diagonals(rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows (each after its filter's number) below ``above``. All pixels of a diagonal need only the two diagonals before it."""
    height, stride = len(rows), rows.shape[1] - 1
    width = -(-stride // step)
    raw = np.zeros((height, width * step), np.int16)
    raw[:, :stride] = rows[:, 1:]
    raw = raw.reshape(height, width, step)
    kind = rows[:, 0][:, None]
    up = np.zeros((width + 1, step), np.int16)
    up[1:].reshape(-1)[:stride] = above
    # done[d, y] is the pixel d - y of row y - 1; a pixel before the first is 0, and row 0 is ``above``.
    done = np.zeros((width + height + 1, height + 1, step), np.int16)
    done[: width + 1, 0] = up
    for d in range(1, width + height):  # pixels x of rows y with x + y = d - 1
        low, high = max(0, d - width), min(height, d)
        y = np.arange(low, high)
        a, b, c = done[d, low + 1 : high + 1], done[d, low:high], done[d - 1, low:high]
        k = kind[low:high]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.where(k == 4, paeth, np.where(k == 3, (a + b) >> 1, np.where(k == 2, b, np.where(k == 1, a, 0))))
        done[d + 1, low + 1 : high + 1] = (raw[y, d - 1 - y] + guess) & 255
    y, x = np.arange(height)[:, None], np.arange(width)[None, :]
    return done[x + y + 2, y + 1].reshape(height, -1)[:, :stride].astype(np.uint8)


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Bytes of the rows without their filters; ``step`` is the distance of a byte's neighbour on the left."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    if height and rows[:, 0].max() > 4:
        raise ValueError(f"PNG filter {rows[:, 0].max()}")
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(0, height, DIAGONAL_ROWS):
        some = rows[y : y + DIAGONAL_ROWS]
        slow = np.count_nonzero(some[:, 0] > 2)
        undo = _diagonals if slow * DIAGONAL_SHARE > len(some) else _by_row
        out[y : y + DIAGONAL_ROWS] = undo(some, above, step)
        above = out[min(y + DIAGONAL_ROWS, height) - 1]
    return out


def _by_row(rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    height, stride = len(rows), rows.shape[1] - 1
    out = np.zeros((height, stride), np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            wide = np.zeros(-(-stride // step) * step, np.uint8)
            wide[:stride] = line
            out[y] = np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y] = line + above
        else:
            # Each byte needs the one before it.
            done, up = bytearray(line.tobytes()), above.tobytes()
            for x in range(stride):
                a, b = done[x - step] if x >= step else 0, up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[x] = (done[x] + guess) & 255
            out[y] = np.frombuffer(bytes(done), np.uint8)
        above = out[y]
    return out


def read_png(content: bytes) -> np.ndarray:
    """Grey values 0 to 255 of a PNG without interlacing; colours by their luma, alpha is ignored. Anything else raises ValueError."""
    pixels = _pixels(content)
    return pixels[:, :, 0].copy() if pixels.shape[2] < 3 else np.rint(pixels[:, :, :3] @ GREY).astype(np.uint8)


def read_colours(content: bytes) -> np.ndarray:
    """Red, green and blue of a PNG, as ``read_png`` reads it."""
    pixels = _pixels(content)
    return np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]


def _pixels(content: bytes) -> np.ndarray:
    """height x width x channels of a PNG."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        length, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + length]
        at += 12 + length
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[6] or head[4] or head[3] not in CHANNELS:
        raise ValueError(f"unsupported PNG header {head}")
    width, height, depth, colour = head[:4]
    n = CHANNELS[colour]
    stride = (width * n * depth + 7) // 8
    try:
        rows = _unfilter(zlib.decompress(b"".join(data)), height, stride, max(1, n * depth // 8))
    except zlib.error as e:
        raise ValueError(f"damaged PNG: {e}") from e
    if depth == 16:
        rows = rows[:, ::2]  # the high bytes
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * n]
        if colour == 0:
            rows = rows * np.uint8(255 // (2**depth - 1))
    if colour == 3:
        rows, n = palette[rows].reshape(height, -1), 3
    return rows.reshape(height, width, n)


def write_png(image: np.ndarray) -> bytes:
    """PNG of an array of bytes: height x width (grey) or height x width x 3 (red, green, blue)."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    rows = np.zeros((height, 1 + image.size // height), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def page_images(spark: SparkSession, path: str, pair_id: str = r"(\d+)/[abAB]", side: str = r"/([abAB])[^/]*$", sheet: str = r"(\d+)\.png$") -> DataFrame:
    """pair_id, side, sheet, content of the PNG files under a path, which must exist; a file without a sheet number is sheet 1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    number = lambda p: F.regexp_extract("path", p, 1).try_cast("long")
    return raw.select(number(pair_id).alias("pair_id"), F.upper(F.regexp_extract("path", side, 1)).alias("side"), F.coalesce(number(sheet), F.lit(1)).cast("int").alias("sheet"), "content")
