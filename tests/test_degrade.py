"""The ladder of scans: its kernels against their definitions, records and labels."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.config import from_mapping
from deltaweave.operators import degrade, generation
from deltaweave.sources.images import read_png


def test_compression_against_the_definition():
    rng = np.random.default_rng(1)
    for shape, quality in (((8, 8), 70), ((11, 19), 70), ((16, 8), 20), ((5, 3), 95)):
        image = rng.integers(0, 256, shape)
        h, w = shape
        steps = np.clip(np.floor((degrade.LUMINANCE * (5000 / quality if quality < 50 else 200 - 2 * quality) + 50) / 100), 1, 255)
        want = np.zeros(shape)
        c = lambda k: math.sqrt(1 / 8) if k == 0 else 0.5
        basis = np.array([[[[c(u) * c(v) * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for x in range(8)] for y in range(8)] for v in range(8)] for u in range(8)])
        for y0 in range(0, h, 8):
            for x0 in range(0, w, 8):
                block = np.array([[image[min(y0 + y, h - 1), min(x0 + x, w - 1)] - 128.0 for x in range(8)] for y in range(8)])
                kept = np.array([[np.rint((basis[u, v] * block).sum() / steps[u, v]) * steps[u, v] for v in range(8)] for u in range(8)])
                back = np.einsum("uv,uvyx->yx", kept, basis) + 128
                part = want[y0 : y0 + 8, x0 : x0 + 8]
                part[:] = back[: part.shape[0], : part.shape[1]]
        got = degrade.compressed(image, quality)
        assert np.abs(got - np.clip(want, 0, 255)).max() <= 0.5 + 1e-6


def test_bands_do_not_show(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (70, 50))
    whole = degrade.compressed(image, 70), degrade.turned(image, 0.9)
    monkeypatch.setattr(degrade, "BAND", 16)
    assert (degrade.compressed(image, 70) == whole[0]).all() and (degrade.turned(image, 0.9) == whole[1]).all()


def test_resized_means_areas():
    image = np.random.default_rng(3).integers(0, 256, (12, 9))
    assert (degrade.resized(image, (12, 9)) == image).all()
    assert (degrade.resized(image, (6, 3)) == np.rint(image.reshape(6, 2, 3, 3).mean(axis=(1, 3)))).all()
    want = np.kron(image, np.ones((5, 2))).reshape(5, 12, 6, 3).mean(axis=(1, 3))
    assert np.abs(degrade.resized(image, (5, 6)) - want).max() <= 0.5 + 1e-9


def test_blur_against_the_definition():
    image = np.random.default_rng(4).integers(0, 256, (9, 7))
    sigma, r = 0.7, 3
    w = np.exp(-((np.arange(-r, r + 1) / sigma) ** 2) / 2)
    w /= w.sum()
    at = lambda i, n: min(max(i, 0), n - 1)
    want = [[sum(w[p + r] * w[q + r] * image[at(y + p, 9), at(x + q, 7)] for p in range(-r, r + 1) for q in range(-r, r + 1)) for x in range(7)] for y in range(9)]
    assert np.abs(degrade.blurred(image, sigma) - want).max() <= 0.5 + 1e-9


def test_turning_by_nothing_and_by_a_half():
    image = np.random.default_rng(5).integers(0, 256, (13, 10))
    assert (degrade.turned(image, 0.0) == image).all()
    assert (degrade.turned(image, 180.0) == image[::-1, ::-1]).all()


def test_labels_follow_the_image(spark):
    """A dot of a sheet is found where its label says, on every level."""
    x, y, seen = 400, 120, []
    sheet = np.full((600, 900), 255)
    sheet[y - 6 : y + 6, x - 6 : x + 6] = 0
    for level in (1, 2, 3):
        for seed in (1, 2, 5):
            image, done = degrade.degrade(sheet, level, seed)
            dark = np.clip(200.0 - image, 0, None)
            cy, cx = ((np.indices(image.shape) + 0.5) * dark).sum((1, 2)) / dark.sum()
            mm = 25.4 / 200
            args = [F.lit(float(v)) for v in (x * mm, (600 - y) * mm, 900 * mm, 600 * mm)]
            want = spark.range(1).select(*degrade.label_pixels(*args, F.lit(done["dpi"]), F.lit(done["skew_deg"]))).first()
            assert abs(cx - want[0]) < 1 and abs(cy - want[1]) < 1
            seen.append((level, done["dpi"], done["jpeg_q"], done["skew_deg"] != 0, 4 <= done["noise_sigma"] <= 9, 0.4 <= done["blur_px"] <= 0.9))
            again, same = degrade.degrade(sheet, level, seed)
            assert (again == image).all() and same == done
    assert set(seen) == {(1, 200, None, False, False, False), (2, 150, 70, False, False, False), (3, 120, 70, True, True, True)}


def test_sheets_and_settings(spark):
    boxes = spark.createDataFrame([(1, "A", 5, 5, 10, 10, 0), (1, "A", -3, 15, 10, 300, 90), (2, "B", 8, 8, 2, 2, 200)], "pair_id long, side string, x int, y int, w int, h int, grey int")
    images = generation.draw_sheets(boxes, 40, 60).withColumn("level", F.col("pair_id").cast("int") + 1).withColumn("seed", F.lit(3))
    first = {r["pair_id"]: read_png(bytes(r["content"])) for r in images.collect()}
    assert first[1][10, 10] == 0 and first[1][30, 2] == 90 and first[1][0, 0] == 255 and first[2].shape == (40, 60)
    s = from_mapping({"LADDER_DPI": "100,50,25", "JPEG_QUALITY": "30", "SSIM": "no"})
    assert s.ladder_dpi == (100, 50, 25) and s.jpeg_quality == 30 and s.ssim is False
    got = {r["pair_id"]: r.asDict() for r in degrade.degraded_sheets(images, s).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["jpeg_q"], got[2]["width"], got[2]["height"]) == (30, 20, 30, 15, 10)
    assert read_png(bytes(got[2]["content"])).shape == (10, 15) and got[1]["skew_deg"] == 0 != got[2]["skew_deg"]
    with pytest.raises(IndexError):
        degrade.record(4, 1)
