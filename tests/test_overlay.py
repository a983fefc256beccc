"""Changes drawn onto sheets, and files that executors write."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.operators import overlay
from deltaweave.sources import images, sinks

RED = (208, 48, 48)


def test_box_against_pixels():
    base = np.random.default_rng(1).integers(0, 256, (40, 50, 3), np.uint8)
    for filled, dashed, width in ((True, False, 4), (False, False, 2), (False, True, 3)):
        image = base.copy()
        overlay.draw_box(image, (5, 8, 34, 30), RED, width, filled, dashed)
        for y in range(40):
            for x in range(50):
                if not (5 <= x <= 34 and 8 <= y <= 30):
                    want = base[y, x]
                else:
                    across, down = min(x - 5, 34 - x), min(y - 8, 30 - y)
                    edge = min(across, down) < width
                    if dashed:
                        top, bottom, left, right = y - 8 < width, 30 - y < width, x - 5 < width, 34 - x < width
                        edge = (top and (x - 5) % 10 < 6) or (bottom and (34 - x) % 10 < 6) or (left and (30 - y) % 10 < 6) or (right and (y - 8) % 10 < 6)
                    blend = np.rint(base[y, x] * (1 - 55 / 255) + np.array(RED) * 55 / 255)
                    want = RED if edge else blend if filled else base[y, x]
                assert (image[y, x] == want).all(), (filled, dashed, x, y)
    image = base.copy()
    overlay.draw_box(image, (20, 20, 10, 30), RED, 2)
    assert (image == base).all()


def test_places_and_marks():
    assert overlay.in_pixels((0.5, 0.25, 0.75, 0.5), 200, 100) == (96, 21, 154, 54)
    assert overlay.in_pixels((0.0, 0.0, 1.0, 1.0), 200, 100) == (0, 0, 199, 99)
    sheet = np.full((200, 300), 255, np.uint8)
    visual = {"box": (0.7, 0.6, 0.9, 0.9), "colour": "#8040b0", "width": 4, "filled": False, "dashed": True}
    image = overlay.draw(sheet, [visual], legend=False)
    x0, y0, x1, y1 = overlay.in_pixels(visual["box"], 300, 200)
    outside = np.ones(sheet.shape, bool)
    outside[y0 : y1 + 1, x0 : x1 + 1] = False
    assert (image[outside] == 255).all() and (image[y0 + 9, x0 + 5] == (128, 64, 176)).all()  # the dot of the mark


def test_legend_names_every_kind():
    image = overlay.draw(np.full((160, 240), 255, np.uint8), [])
    for i, (kind, _) in enumerate(overlay.LEGEND):
        assert (image[12 + 20 * i, 12] == overlay.rgb(overlay.STYLE[kind])).all()
        assert (image[12 + 20 * i : 25 + 20 * i, 36:160] == 0).any()
    for tiny in ((5, 5), (20, 14), (30, 400)):
        assert overlay.draw(np.full(tiny, 255, np.uint8), []).shape == (*tiny, 3)
    assert set("".join(t for _, t in overlay.LEGEND)) <= set(overlay.FONT) and all(len(g.split()) == 7 and {len(r) for r in g.split()} == {5} for g in overlay.FONT.values())


def test_every_sheet_is_written(spark, tmp_path):
    blank = images.write_png(np.full((160, 240), 255, np.uint8))
    pages = spark.createDataFrame([(p, s, n, blank) for p in (1, 2) for s in "AB" for n in (1, 2)], "pair_id long, side string, sheet int, content binary")
    rows = [(1, 1, "d1", "A", (0.8, 0.5, 0.9, 0.6), "#d03030", True, False, False), (1, 1, "d2", "A", (0.8, 0.5, 0.9, 0.6), "#2f6fd0", False, False, True)]
    drawn = spark.createDataFrame(rows, f"pair_id long, sheet int, did string, drawn_on string, box {overlay.BOX}, colour string, filled boolean, dashed boolean, is_cascade boolean")
    wide = overlay.with_width(drawn.drop("is_cascade"), drawn)
    assert {r["did"]: r["width"] for r in wide.collect()} == {"d1": 4, "d2": 2}
    found = overlay.overlays(pages, wide)
    assert {(r["pair_id"], r["side"], r["sheet"]): r["n_boxes"] for r in found.collect()} == {(p, s, n): 2 * ((p, s, n) == (1, "A", 1)) for p in (1, 2) for s in "AB" for n in (1, 2)}
    named = found.select(F.format_string("%d/markup_%s_sheet%d.png", "pair_id", F.lower("side"), "sheet").alias("name"), "content")
    for _ in range(2):  # a second run writes the same files
        sinks.write_files(named, str(tmp_path / "out"))
        files = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
        assert files == sorted(f"{p}/markup_{s}_sheet{n}.png" for p in (1, 2) for s in "ab" for n in (1, 2))
    pixels = images.read_colours((tmp_path / "out/1/markup_a_sheet1.png").read_bytes())
    x0, y0, *_ = overlay.in_pixels((0.8, 0.5, 0.9, 0.6), 240, 160)
    assert (pixels[y0, x0] == overlay.rgb("#2f6fd0")).all() and (pixels[y0 + 2, x0 + 2] == overlay.rgb("#d03030")).all()  # the outline above the filling
    assert (images.read_colours((tmp_path / "out/2/markup_b_sheet2.png").read_bytes()) == overlay.draw(np.full((160, 240), 255, np.uint8), [])).all()
    with pytest.raises(Exception, match="stay below"):
        sinks.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), str(tmp_path / "out"))
