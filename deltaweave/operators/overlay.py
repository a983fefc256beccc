"""Changes drawn onto the sheets of both revisions.

Every sheet is written, with or without changes: filled boxes for what was added,
removed or modified, outlines for moves and for cascades (thinner), dashes and a
question mark for visual changes that nothing explains, and a legend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.images import read_png, write_png
from .dealing import dealt
from .rendering import STYLE

# Widths of primary changes and of cascades, opacity of a filling, room around a box, and lengths of dashes and gaps, in pixels.
WIDE, THIN, FILL, ROOM, DASH, GAP = 4, 2, 55 / 255, 4, 6, 4
# The legend's corner, width and height of a line, and its texts.
LEGEND_AT, LEGEND_WIDTH, LEGEND_LINE = (12, 12), 150, 20
LEGEND = (("add", "ADDED"), ("remove", "REMOVED"), ("modify", "MODIFIED"), ("move", "MOVED"), ("unclassified_visual_change", "UNCLASSIFIED CHANGE"))
#: Capital letters of five by seven dots, those that legend and marks need.
FONT = {
    "A": ".###. #...# #...# ##### #...# #...# #...#", "C": ".#### #.... #.... #.... #.... #.... .####", "D": "####. #...# #...# #...# #...# #...# ####.",
    "E": "##### #.... #.... ####. #.... #.... #####", "F": "##### #.... #.... ####. #.... #.... #....", "G": ".#### #.... #.... #.### #...# #...# .####",
    "H": "#...# #...# #...# ##### #...# #...# #...#", "I": "##### ..#.. ..#.. ..#.. ..#.. ..#.. #####", "L": "#.... #.... #.... #.... #.... #.... #####",
    "M": "#...# ##.## #.#.# #.#.# #...# #...# #...#", "N": "#...# ##..# #.#.# #..## #...# #...# #...#", "O": ".###. #...# #...# #...# #...# #...# .###.",
    "R": "####. #...# #...# ####. #.#.. #..#. #...#", "S": ".#### #.... #.... .###. ....# ....# ####.", "U": "#...# #...# #...# #...# #...# #...# .###.",
    "V": "#...# #...# #...# #...# #...# .#.#. ..#..", "?": ".###. #...# ....# ...#. ..#.. ..... ..#..", " ": "..... ..... ..... ..... ..... ..... .....",
}
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def rgb(colour: str) -> tuple[int, int, int]:
    return tuple(int(colour[i : i + 2], 16) for i in (1, 3, 5))


def in_pixels(box, width: int, height: int) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 with room around, inside the sheet; both ends belong to the box."""
    x0, y0, x1, y1 = box
    return max(0, int(x0 * width - ROOM)), max(0, int(y0 * height - ROOM)), min(width - 1, int(x1 * width + ROOM)), min(height - 1, int(y1 * height + ROOM))


def write_text(image: np.ndarray, x: int, y: int, text: str, colour) -> None:
    for i, letter in enumerate(text):
        dots = np.array([[c == "#" for c in row] for row in FONT[letter].split()])
        part = image[y : y + 7, x + 6 * i : x + 6 * i + 5]
        part[dots[: part.shape[0], : part.shape[1]]] = colour


def draw_box(image: np.ndarray, box: tuple[int, int, int, int], colour, width: int, filled: bool = False, dashed: bool = False) -> None:
    """A rectangle within its corners: its border inside, its filling translucent; dashes start at every corner anew."""
    x0, y0, x1, y1 = box
    if x1 < x0 or y1 < y0:
        return
    inside = image[y0 : y1 + 1, x0 : x1 + 1]
    if filled:
        inside[:] = np.rint(inside * (1 - FILL) + np.array(colour) * FILL)
    border = np.zeros(inside.shape[:2], bool)
    border[:width] = border[-width:] = True
    border[:, :width] = border[:, -width:] = True
    if dashed:
        h, w = border.shape
        on = [np.arange(n) % (DASH + GAP) < DASH for n in (w, h)]
        dashes = np.zeros_like(border)
        dashes[:width] |= on[0]
        dashes[-width:] |= on[0][::-1]
        dashes[:, :width] |= on[1][::-1, None]
        dashes[:, -width:] |= on[1][:, None]
        border &= dashes
    inside[border] = colour


def draw_legend(image: np.ndarray) -> None:
    x, y = LEGEND_AT
    high, wide = len(LEGEND) * LEGEND_LINE, LEGEND_WIDTH
    plate = image[y - 4 : y + high + 3, x - 4 : x + wide + 1]
    if not plate.size:
        return
    plate[:] = 255
    plate[[0, -1]] = 0
    plate[:, [0, -1]] = 0
    for i, (kind, text) in enumerate(LEGEND):
        top = y + i * LEGEND_LINE
        draw_box(image, (x, top, min(x + 18, image.shape[1] - 1), min(top + 12, image.shape[0] - 1)), rgb(STYLE[kind]), 3, filled=True)
        write_text(image, x + 26, top + 3, text, 0)


def draw(grey: np.ndarray, boxes: list[dict], legend: bool = True) -> np.ndarray:
    """The sheet in colour with boxes(box, colour, width, filled, dashed), in their order."""
    image = np.repeat(grey[:, :, None], 3, axis=2)
    height, width = grey.shape
    for b in boxes:
        at = in_pixels(b["box"], width, height)
        draw_box(image, at, rgb(b["colour"]), b["width"], b["filled"], b["dashed"])
        if b["dashed"]:
            write_text(image, at[0] + 3, at[1] + 3, "?", rgb(b["colour"]))
    if legend:
        draw_legend(image)
    return image


def overlays(images: DataFrame, drawn: DataFrame, legend: bool = True) -> DataFrame:
    """pair_id, side, sheet, n_boxes, content (PNG) of every sheet of images(pair_id, side, sheet, content).

    drawn: pair_id, sheet, did, drawn_on, box, colour, filled, dashed and width, as ``rendering.boxes``
    gives them; moved outlines and dashes come last, so that fillings do not cover them. One sheet at a time.
    """
    item = F.struct("filled", "did", F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"), F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"), "colour", "dashed", "width")
    grouped = drawn.groupBy("pair_id", "sheet", F.col("drawn_on").alias("side")).agg(F.sort_array(F.collect_list(F.struct((~F.col("filled")).alias("last"), item.alias("b")))).alias("boxes"))
    both = dealt(images.select("pair_id", "side", "sheet", "content").join(grouped, ["pair_id", "side", "sheet"], "left"), "pair_id", "side", "sheet")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                found = [] if r.boxes is None else [b["b"] for b in r.boxes]
                boxes = [{"box": (b["x0"], b["y0"], b["x1"], b["y1"]), **{k: b[k] for k in ("colour", "filled", "dashed", "width")}} for b in found]
                yield pd.DataFrame([(r.pair_id, r.side, r.sheet, len(boxes), write_png(draw(read_png(bytes(r.content)), boxes, legend)))], columns=["pair_id", "side", "sheet", "n_boxes", "content"])

    return both.mapInPandas(run, f"pair_id {dict(images.dtypes)['pair_id']}, side string, sheet int, n_boxes int, content binary")


def with_width(drawn: DataFrame, deltas: DataFrame) -> DataFrame:
    """Boxes with the width of their border: cascades are thinner."""
    cascades = deltas.where("is_cascade").select("pair_id", "did", F.lit(THIN).alias("_thin")).distinct()
    return drawn.join(cascades, ["pair_id", "did"], "left").withColumn("width", F.coalesce("_thin", F.lit(WIDE))).drop("_thin")


def colour_counts(images: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """pair_id, side, sheet, carried, colour, n: pixels of each of the styles' colours in images(..., content).

    With carried columns every sheet also has a row of no colour (null) and n = 0, so that none is lost.
    """
    names = {int.from_bytes(bytes(rgb(c))): c for c in STYLE.values()}
    keep = ["pair_id", "side", "sheet", *carried]
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources.images import read_colours

        for pdf in batches:
            rows = []
            for head, content in zip(pdf[keep].itertuples(index=False, name=None), pdf["content"], strict=True):
                packed = read_colours(bytes(content)).astype(np.int32) @ np.array([1 << 16, 1 << 8, 1], np.int32)
                counts = [(colour, np.count_nonzero(packed == number)) for number, colour in names.items()]
                rows += [(*head, colour, n) for colour, n in counts if n]
                rows += [(*head, None, 0)] if carried else []
            yield pd.DataFrame(rows, columns=[*keep, "colour", "n"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], "colour string, n long"])
    return images.select(*keep, "content").mapInPandas(run, schema)
