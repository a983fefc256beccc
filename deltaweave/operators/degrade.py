"""Sheets as scans: a ladder of resolution, compression, skew, noise and blur, with what was done recorded.

Level 1 is a clean raster, level 2 a coarser one compressed as JPEG does (8 x 8
cosine transforms, quantised), level 3 is also turned, noisy and blurred. What a
level does follows from the seed alone, so a lost task gives the same sheet again.
Labels are carried along by the record: ``label_pixels`` turns places of the drawing
into those of the degraded image.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..sources.images import read_png, write_png
from .dealing import dealt

# The luminance table of the JPEG standard, in its order of rows.
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
])
#: Rows transformed at a time.
BAND = 512
RECORD = "level int, dpi int, skew_deg double, jpeg_q int, noise_sigma double, blur_px double"


def record(level: int, seed: int, s: Settings = DEFAULT) -> dict:
    """What a level does to the sheet of a seed."""
    out = {"level": level, "dpi": s.ladder_dpi[level - 1], "skew_deg": 0.0, "jpeg_q": s.jpeg_quality if level >= 2 else None, "noise_sigma": 0.0, "blur_px": 0.0}
    if level >= 3:
        r = random.Random(seed)
        out |= {"skew_deg": round(r.uniform(0.3, 1.2) * r.choice([-1, 1]), 3), "noise_sigma": round(r.uniform(4, 9), 2), "blur_px": round(r.uniform(0.4, 0.9), 2)}
    return out


def resized(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Each new pixel is the mean of the area it covers."""
    for axis in (0, 1):
        rows = np.moveaxis(image.astype(float), axis, 0)
        n, m = len(rows), shape[axis]
        if n != m:
            total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
            at = np.arange(m + 1) * n / m
            low = np.minimum(at.astype(int), n - 1)
            edges = total[low] + (at - low)[:, None] * (total[low + 1] - total[low])
            rows = np.diff(edges, axis=0) * (m / n)
        image = np.moveaxis(rows, 0, axis)
    return np.rint(image)


def compressed(image: np.ndarray, quality: int) -> np.ndarray:
    """What JPEG of a quality leaves of grey values: cosine transforms of 8 x 8 pixels, rounded to steps; borders are repeated to whole blocks."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = np.clip(np.floor((LUMINANCE * scale + 50) / 100), 1, 255)
    k = np.arange(8)
    turn = np.cos((2 * k + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)[:, None]
    h, w = image.shape
    wide = np.pad(image.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    for y in range(0, len(wide), BAND):
        part = wide[y : y + BAND]
        blocks = part.reshape(len(part) // 8, 8, -1, 8).swapaxes(1, 2)
        kept = np.rint(turn @ blocks @ turn.T / steps) * steps
        wide[y : y + BAND] = (turn.T @ kept @ turn).swapaxes(1, 2).reshape(part.shape)
    return np.clip(np.rint(wide[:h, :w] + 128), 0, 255)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of a cubic convolution (a = -1/2) at a distance."""
    t = np.abs(t)
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre as ``label_pixels`` turns labels, by cubic convolution; white comes in."""
    h, w = image.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    wide = np.pad(image.astype(float), 2, constant_values=255.0)
    out = np.empty((h, w))
    x = np.arange(w)[None, :] + 0.5 - w / 2
    for begin in range(0, h, BAND):
        y = np.arange(begin, min(h, begin + BAND))[:, None] + 0.5 - h / 2
        px, py = c * x + s * y + w / 2 - 0.5, -s * x + c * y + h / 2 - 0.5
        x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
        total = np.zeros(px.shape)
        for dy in range(-1, 3):
            row = np.clip(y0 + dy + 2, 0, h + 3)
            for dx in range(-1, 3):
                total += _cubic(py - y0 - dy) * _cubic(px - x0 - dx) * wide[row, np.clip(x0 + dx + 2, 0, w + 3)]
        out[begin : begin + BAND] = np.where((px < -1) | (px > w) | (py < -1) | (py > h), 255.0, total)
    return np.clip(np.rint(out), 0, 255)


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian over three sigma, borders repeated."""
    r = max(1, math.ceil(3 * sigma))
    weights = np.exp(-((np.arange(-r, r + 1) / sigma) ** 2) / 2)
    weights /= weights.sum()
    for axis in (0, 1):
        rows = np.moveaxis(image.astype(float), axis, 0)
        wide = np.concatenate([np.repeat(rows[:1], r, axis=0), rows, np.repeat(rows[-1:], r, axis=0)])
        image = np.moveaxis(sum(w * wide[i : i + len(rows)] for i, w in enumerate(weights)), 0, axis)
    return np.clip(np.rint(image), 0, 255)


def degrade(image: np.ndarray, level: int, seed: int, s: Settings = DEFAULT, base_dpi: int | None = None) -> tuple[np.ndarray, dict]:
    """The image of a sheet drawn at base_dpi (that of level 1 if none is given) as a level gives it, and the record."""
    done = record(level, seed, s)
    ratio = done["dpi"] / (base_dpi or s.ladder_dpi[0])
    image = resized(image, tuple(max(1, round(n * ratio)) for n in image.shape))
    if level >= 2:
        image = compressed(image, done["jpeg_q"])
    if level >= 3:
        image = turned(image, done["skew_deg"])
        image = np.clip(np.rint(image + np.random.default_rng(seed).normal(0, done["noise_sigma"], image.shape)), 0, 255)
        image = blurred(image, done["blur_px"])
    return image.astype(np.uint8), done


def degraded_sheets(images: DataFrame, s: Settings = DEFAULT, base_dpi: int | None = None) -> DataFrame:
    """images(pair_id, side, sheet, content, level, seed) as pair_id, side, sheet, content, width, height and the record (RECORD); one sheet at a time."""
    kinds = dict(images.dtypes)
    columns = [c.split()[0] for c in RECORD.split(", ")]
    schema = f"pair_id {kinds['pair_id']}, side string, sheet int, content binary, width int, height int, {RECORD}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                image, done = degrade(read_png(bytes(r.content)), int(r.level), int(r.seed), s, base_dpi)
                row = (r.pair_id, r.side, r.sheet, write_png(image), image.shape[1], image.shape[0], *[done[c] for c in columns])
                yield pd.DataFrame([row], columns=["pair_id", "side", "sheet", "content", "width", "height", *columns]).astype({"jpeg_q": "Int32"})

    return dealt(images.select("pair_id", "side", "sheet", "content", "level", "seed"), "pair_id", "side", "sheet").mapInPandas(run, schema)


def label_pixels(x_mm: Column, y_mm: Column, width_mm: Column, height_mm: Column, dpi: Column, skew_deg: Column) -> tuple[Column, Column]:
    """A place in mm from the bottom left, in pixels from the top left of the degraded image: scaled, then turned about its centre."""
    scale = dpi / F.lit(25.4)
    cx, cy = width_mm * scale / 2, height_mm * scale / 2
    dx, dy = x_mm * scale - cx, (height_mm - y_mm) * scale - cy
    c, s = F.cos(F.radians(skew_deg)), F.sin(F.radians(skew_deg))
    return cx + dx * c - dy * s, cy + dx * s + dy * c


def pixel_sums(images: DataFrame) -> DataFrame:
    """images with width, height and the sum of grey values of content."""

    @F.pandas_udf("width int, height int, grey long")
    def of(content: pd.Series) -> pd.DataFrame:
        found = [read_png(bytes(c)) for c in content]
        return pd.DataFrame({"width": [i.shape[1] for i in found], "height": [i.shape[0] for i in found], "grey": [int(i.sum(dtype=np.int64)) for i in found]})

    return images.withColumn("_p", of("content")).select(*[c for c in images.columns if c not in ("width", "height", "grey")], "_p.*")
