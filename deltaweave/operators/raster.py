"""Raster differences and how they join the symbolic changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import geometry as G
from ..functions.text import strip
from ..sources.images import read_png
from .dealing import dealt, merged
from .spatial import touching

REGION = "pair_id long, sheet int, x0 double, y0 double, x1 double, y1 double, area_px int, magnitude double"


def warp(image: np.ndarray, shape: tuple[int, int], scale: float, rotation: float, tx: float, ty: float) -> np.ndarray:
    """Image of side B in the frame and pixels of side A: bilinear, white outside.

    The transform maps shares of B's sheet to shares of A's; a share is a pixel's number by the number of pixels.
    """
    h, w = shape
    y, x = np.mgrid[0:h, 0:w]
    u, v = x / w - tx, y / h - ty
    c, s = np.cos(rotation) / scale, np.sin(rotation) / scale
    px, py = (c * u + s * v) * image.shape[1], (-s * u + c * v) * image.shape[0]
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    fx, fy = px - x0, py - y0
    edge = np.pad(image.astype(float), 1, constant_values=255.0)

    def at(yy, xx):
        inside = (yy >= -1) & (yy <= image.shape[0]) & (xx >= -1) & (xx <= image.shape[1])
        return np.where(inside, edge[np.clip(yy + 1, 0, edge.shape[0] - 1), np.clip(xx + 1, 0, edge.shape[1] - 1)], 255.0)

    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def binarise(image: np.ndarray) -> np.ndarray:
    """Black and white at the threshold that parts the histogram best (largest variance between classes)."""
    counts = np.bincount(np.clip(image, 0, 255).astype(np.uint8).ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return np.where(image > np.nanargmax(np.nan_to_num(between)), 255.0, 0.0)


def _box_mean(image: np.ndarray, k: int) -> np.ndarray:
    """Mean over k x k around each pixel, mirrored at the border."""
    r = k // 2
    total = np.pad(np.pad(image, r, mode="symmetric").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) / (k * k)


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur over an odd window of about three sigma, mirrored inside the border, in whole grey values."""
    k = max(1, round(sigma * 3) | 1)
    weights = np.exp(-(((np.arange(k) - k // 2) / sigma) ** 2) / 2)
    weights /= weights.sum()
    for axis in (0, 1):
        wide = np.moveaxis(image.astype(float), axis, 0)
        n = len(wide)
        places = np.abs(np.arange(-(k // 2), n + k // 2))
        places = np.clip(np.where(places >= n, 2 * (n - 1) - places, places), 0, n - 1)
        image = np.moveaxis(sum(w * wide[places[i : i + n]] for i, w in enumerate(weights)), 0, axis)
    return np.rint(image)


def structural_difference(a: np.ndarray, b: np.ndarray, s: Settings = DEFAULT) -> np.ndarray:
    """1 - SSIM over an odd window of at most ssim_window pixels; without SSIM, and for images under 3 pixels, the difference of blurred images."""
    k = min(s.ssim_window, *a.shape)
    k -= 1 - k % 2
    if k < 3 or not s.ssim:
        return np.abs(_blurred(a, s.blur_sigma) - _blurred(b, s.blur_sigma)) / 255
    a, b = a.astype(float), b.astype(float)
    ma, mb = _box_mean(a, k), _box_mean(b, k)
    n = k * k / (k * k - 1)
    va, vb, cov = (_box_mean(p, k) - q for p, q in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = ((2 * ma * mb + c1) * (2 * n * cov + c2)) / ((ma * ma + mb * mb + c1) * (n * va + n * vb + c2))
    return np.clip(1 - ssim, 0, 1)


def _shifted(mask: np.ndarray, k: int, pick) -> np.ndarray:
    """Least or greatest of the k x k places around each, rows and columns apart, each by doubling."""
    r = k // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, k - 1 - r)
        out = np.moveaxis(np.pad(mask, pad, constant_values=pick is np.minimum), axis, 0)
        have = 1
        while have < k:
            more = min(have, k - have)
            out = pick(out[:-more], out[more:])
            have += more
        mask = np.moveaxis(out, 0, axis)
    return mask


def united(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of the things 0 to n - 1 that each hangs together with, by links x - y."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def strokes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start, end of the runs of a mask's rows, and the number of the 8-connected component that each is part of, from 0."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    wide = mask.shape[1] + 2
    # Runs of the row above from the first that ends at or after the start to the last that starts at or before the end touch a run, also over a corner.
    first = np.searchsorted(row * wide + end, (row - 1) * wide + start)
    last = np.searchsorted(row * wide + start, (row - 1) * wide + end, side="right")
    times = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(row)), times)
    above = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return row, start, end, np.unique(united(len(row), below, above), return_inverse=True)[1]


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components from 1, 0 outside."""
    row, start, end, part = strokes(mask)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(part + 1, end - start)
    return out


#: Images are compared in blocks of so many pixels a side, of which equal ones cost nothing.
BLOCK = 64


def _blocks(n: int) -> list[tuple[int, int]]:
    """Starts and ends of blocks; what is left over goes to the last."""
    starts = list(range(0, max(1, n - BLOCK + 1), BLOCK))
    return list(zip(starts, [*starts[1:], n], strict=True))


def changed_difference(a: np.ndarray, b: np.ndarray, s: Settings = DEFAULT) -> np.ndarray:
    """structural_difference, computed only for blocks around which the images differ; elsewhere it is zero."""
    if not s.ssim:
        return structural_difference(a, b, s)
    out, unequal, r = np.zeros(a.shape), a != b, s.ssim_window // 2
    for y0, y1 in _blocks(a.shape[0]):
        for x0, x1 in _blocks(a.shape[1]):
            top, left = max(0, y0 - r), max(0, x0 - r)
            cut = slice(top, y1 + r), slice(left, x1 + r)
            if unequal[cut].any():
                out[y0:y1, x0:x1] = structural_difference(a[cut], b[cut], s)[y0 - top : y1 - top, x0 - left : x1 - left]
    return out


def change_mask(a: np.ndarray, b: np.ndarray, s: Settings = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Where two images differ, opened and dilated, and by how much."""
    diff = changed_difference(a, b, s)
    mask = diff > s.diff_threshold
    if s.opened > 1:
        mask = _shifted(_shifted(mask, s.opened, np.minimum), s.opened, np.maximum)
    if s.dilated > 1:
        mask = _shifted(mask, s.dilated, np.maximum)
    return mask, diff


def _parts(mask: np.ndarray, diff: np.ndarray, y0: int = 0, x0: int = 0) -> tuple[np.ndarray, ...]:
    """Of each component: x0, y0, x1, y1, pixels and sum of differences; then row, start, end and component of each run."""
    row, start, end, part = strokes(mask)
    n = int(part.max(initial=-1)) + 1
    size = end - start
    flat = np.zeros(n)
    if n:
        np.add.at(flat, part, np.add.reduceat(diff[mask], np.cumsum(size) - size))
    box = [np.full(n, v) for v in (mask.shape[1], mask.shape[0], 0, 0)]
    for out, of, value in zip(box, (np.minimum, np.minimum, np.maximum, np.maximum), (start, row, end, row + 1), strict=True):
        of.at(out, part, value)
    return box[0] + x0, box[1] + y0, box[2] + x0, box[3] + y0, np.bincount(part, size, n).astype(np.int64), flat, row + y0, start + x0, end + x0, part


def _regions(x0, y0, x1, y1, pixels, total, shape: tuple[int, int], s: Settings) -> list[tuple]:
    h, w = shape
    fit = (pixels >= s.least_area) & (pixels <= s.most_area * h * w)
    return list(zip(*(v[fit].tolist() for v in (x0 / w, y0 / h, x1 / w, y1 / h, pixels, total / np.maximum(pixels, 1))), strict=True))


def change_regions(a: np.ndarray, b: np.ndarray, s: Settings = DEFAULT) -> list[tuple]:
    """x0, y0, x1, y1 (shares of the sheet), pixels and mean difference of each region that changed."""
    mask, diff = change_mask(a, b, s)
    return _regions(*_parts(mask, diff)[:6], mask.shape, s)


def raster_regions(rasters: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Regions of rasters(pair_id, sheet, width, height, a, b), with a and b as bytes or arrays of grey values in one frame; one row is one sheet."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                shape = (r.height, r.width)
                a, b = (np.frombuffer(p, np.uint8).reshape(shape) if isinstance(p, bytes) else np.asarray(p, float).reshape(shape) for p in (r.a, r.b))
                rows += [(r.pair_id, r.sheet, *found) for found in change_regions(a, b, s)]
            yield pd.DataFrame(rows, columns=["pair_id", "sheet", "x0", "y0", "x1", "y1", "area_px", "magnitude"]).astype({"area_px": "int32"})

    return rasters.select("pair_id", "sheet", "width", "height", "a", "b").mapInPandas(run, REGION)


TILE = "pair_id long, sheet int, height int, width int, y0 int, x0 int, y1 int, x1 int, top int, left int, part_height int, part_width int, a binary, b binary"
#: A component of a tile (run is null) or a run of one along the tile's border.
PIECE = "pair_id long, sheet int, height int, width int, tile long, part int, x0 int, y0 int, x1 int, y1 int, pixels long, total double, run boolean"


def tiles(a: np.ndarray, b: np.ndarray, s: Settings = DEFAULT, size: int = 0):
    """y0, x0, y1, x1 of the tiles whose surroundings differ, place of those in the sheet, and both images there.

    Around a tile is as much as decides it: half an SSIM window, twice half the
    opening and half the dilation. Where both images are equal nothing is marked.
    """
    size = size or s.tile
    around = (s.ssim_window if s.ssim else max(1, round(s.blur_sigma * 3) | 1)) // 2 + 2 * (s.opened // 2) + s.dilated // 2 + 1
    h, w = a.shape
    for y0 in range(0, h, size):
        for x0 in range(0, w, size):
            y1, x1 = min(h, y0 + size), min(w, x0 + size)
            top, left = max(0, y0 - around), max(0, x0 - around)
            cut = (slice(top, y1 + around), slice(left, x1 + around))
            if (a[cut] != b[cut]).any():
                yield y0, x0, y1, x1, top, left, a[cut], b[cut]


def _tile_pieces(batches, s: Settings):
    for pdf in batches:
        found = []
        for r in pdf.itertuples():
            a, b = (np.frombuffer(p, np.uint8).reshape(r.part_height, r.part_width) for p in (r.a, r.b))
            mask, diff = change_mask(a, b, s)
            core = slice(r.y0 - r.top, r.y1 - r.top), slice(r.x0 - r.left, r.x1 - r.left)
            x0, y0, x1, y1, pixels, total, row, start, end, part = _parts(mask[core], diff[core], r.y0, r.x0)
            head = r.pair_id, r.sheet, r.height, r.width, r.y0 * r.width + r.x0
            found += [(*head, i, *p, None) for i, p in enumerate(zip(*(v.tolist() for v in (x0, y0, x1, y1, pixels, total)), strict=True))]
            edge = (row == r.y0) | (row == r.y1 - 1) | (start == r.x0) | (end == r.x1)
            found += [(*head, i, p, q, e, q + 1, 0, 0.0, True) for i, q, p, e in zip(*(v[edge].tolist() for v in (part, row, start, end)), strict=True)]
        frame = pd.DataFrame(found, columns=[c.split()[0] for c in PIECE.split(", ")])
        yield frame.astype({"run": "boolean"})


def _joined(s: Settings):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The regions of one sheet from its tiles' components, which touch where border runs of neighbours do."""
        edges, parts = pdf[pdf.run.notna()], pdf[pdf.run.isna()]
        number = {key: i for i, key in enumerate(zip(parts.tile, parts.part, strict=True))}
        of = np.array([number[key] for key in zip(edges.tile, edges.part, strict=True)], np.int64)
        y, start, end = (edges[c].to_numpy(np.int64) for c in ("y0", "x0", "x1"))
        order = np.lexsort((start, y))
        y, start, end, of = y[order], start[order], end[order], of[order]
        wide, links = int(pdf.width.iloc[0]) + 2, []
        for up in (0, 1):  # runs of one row that meet at a side, and of two rows; in a row, runs are apart and in order
            first = np.searchsorted(y * wide + end, (y - up) * wide + start)
            last = np.searchsorted(y * wide + start, (y - up) * wide + end, side="right")
            times = np.maximum(last - first, 0)
            links.append((np.repeat(of, times), of[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())]))
        root = united(len(parts), *(np.concatenate(x) for x in zip(*links, strict=True)))
        whole = parts.groupby(root).agg({"x0": "min", "y0": "min", "x1": "max", "y1": "max", "pixels": "sum", "total": "sum"})
        shape = int(pdf.height.iloc[0]), int(pdf.width.iloc[0])
        found = _regions(*(whole[c].to_numpy() for c in whole.columns), shape, s)
        frame = pd.DataFrame([(pdf.pair_id.iloc[0], pdf.sheet.iloc[0], *f) for f in found], columns=[c.split()[0] for c in REGION.split(", ")])
        return frame.astype({"pair_id": "int64", "sheet": "int32", "area_px": "int32"})

    return run


def tiled_regions(cut: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Regions of tiles (TILE): each tile is compared by itself, and what touches over a seam is joined.

    A task holds one tile; of a sheet only its components and the runs along tiles'
    borders come together. The result is that of the whole sheet.
    """
    key = ["pair_id", "sheet", "y0", "x0"]
    pieces = dealt(cut, *key).mapInPandas(lambda batches: _tile_pieces(batches, s), PIECE)
    return pieces.groupBy("pair_id", "sheet").applyInPandas(_joined(s), REGION)


def page_regions(images: DataFrame, transforms: DataFrame, s: Settings = DEFAULT, otsu: bool = False) -> DataFrame:
    """Regions of images(pair_id, side, sheet, content: PNG bytes), side B warped by transforms(pair_id, scale, rotation, tx, ty).

    A sheet that is on one side alone, or whose pair has no transform (it was
    refused), has no regions. One task reads and warps the two sides of a sheet;
    the tiles in which they differ are compared each by itself.
    """
    side = lambda n: images.where(F.col("side") == n).select("pair_id", "sheet", F.col("content").alias(n.lower()))
    both = dealt(side("A").join(side("B"), ["pair_id", "sheet"]).join(transforms.select("pair_id", "scale", "rotation", "tx", "ty"), "pair_id"), "pair_id", "sheet")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a, b = read_png(bytes(r.a)), read_png(bytes(r.b))
                if a.shape != b.shape or (r.scale, r.rotation, r.tx, r.ty) != (1, 0, 0, 0):
                    b = np.rint(warp(b, a.shape, r.scale, r.rotation, r.tx, r.ty)).astype(np.uint8)
                if otsu:
                    a, b = (binarise(i).astype(np.uint8) for i in (a, b))
                for *place, p, q in tiles(a, b, s):
                    yield pd.DataFrame([(r.pair_id, r.sheet, *a.shape, *place, *p.shape, p.tobytes(), q.tobytes())], columns=[c.split()[0] for c in TILE.split(", ")])

    return tiled_regions(both.mapInPandas(run, TILE), s)


PAGE = ["pair_id", "sheet"]


def _texts(elements: DataFrame, side: str) -> DataFrame:
    return elements.where((F.col("side") == side) & (F.col("type") != "geometry") & (strip(F.col("content")) != ""))


def unexplained(regions: DataFrame, boxes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Regions(PAGE, region_id, box) that no symbolic change on their sheet, given by boxes(PAGE, box), explains."""
    rb, db = F.col("left_box"), F.col("right_box")
    near = (G.iou(rb, db) > s.explain_iou) | G.contains(rb, *G.centre(db)) | G.contains(db, *G.centre(rb))
    told = touching(regions, boxes, PAGE).where(near).select(*PAGE, F.col("left_box").alias("box")).distinct()
    return _without(regions, told)


def _without(regions: DataFrame, told: DataFrame) -> DataFrame:
    """Regions whose box is not told(PAGE, box)."""
    return merged(regions).join(told.select(*PAGE, F.col("box").alias("_told")), [regions[c] == told[c] for c in PAGE] + [regions["box"] == F.col("_told")], "left_anti")


def not_confirmed(regions: DataFrame, elements: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Regions not covered (on average of both sides) by a text that is equal on both sides."""

    def cover(side: str) -> DataFrame:
        e = _texts(elements, side).select(*PAGE, "content", F.col("box").alias("right_box"))
        part = touching(regions, e, PAGE, other="right_box").withColumn("part", G.overlap_fraction(F.col("left_box"), F.col("right_box"))).where("part > 0")
        # The best cover of each text is all that can count.
        return merged(part).join(e.distinct(), [*PAGE, "right_box"]).groupBy(*PAGE, "left_box", "content").agg(F.max("part").alias(f"part_{side.lower()}"))

    both = merged(cover("A")).join(cover("B"), [*PAGE, "left_box", "content"]).where((F.col("part_a") + F.col("part_b")) / 2 >= s.text_confirm)
    return _without(regions, both.select(*PAGE, F.col("left_box").alias("box")).distinct())


def residue_kind(n_a: Column, n_b: Column, n_shared: Column) -> Column:
    return F.when((n_a > 0) != (n_b > 0), "extraction_gap").when(n_shared > 0, "graphical").when(n_a > 0, "extraction_gap").otherwise("geometry")


def region_confidence(magnitude: Column, area_px: Column, s: Settings = DEFAULT) -> Column:
    mag = F.greatest(F.lit(0.0), F.least(F.lit(1.0), magnitude))
    size = F.least(F.lit(1.0), area_px / (s.least_area * 20))
    return F.round(F.least(F.lit(s.conf_cap), s.conf_base + s.conf_scale * (0.5 * mag + 0.5 * size)), 4)


def residue(regions: DataFrame, delta_boxes: DataFrame, elements: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The regions that neither a change nor equal text accounts for, each with its kind, zone and confidence."""
    left = not_confirmed(unexplained(regions, delta_boxes, s), elements, s)
    e = elements.where((F.col("type") != "geometry") & (strip(F.col("content")) != "")).select(*PAGE, "side", "content", F.col("box").alias("right_box"))
    wide = left.select(*PAGE, "box", G.padded(F.col("box"), s.near_padding).alias("left_box")).distinct()
    near = touching(wide, e, PAGE, "left_box", "right_box").where(G.intersects(F.col("left_box"), F.col("right_box")))
    near = merged(merged(near).join(e.distinct(), [*PAGE, "right_box"])).join(wide, [*PAGE, "left_box"])
    by_text = near.groupBy(*PAGE, "box", "content").agg(F.max((F.col("side") == "A").cast("int")).alias("a"), F.max((F.col("side") == "B").cast("int")).alias("b"))
    counts = by_text.groupBy(*PAGE, "box").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_shared"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = merged(left).join(counts, [*PAGE, "box"], "left").select(*left.columns, *[zero(c).alias(c) for c in ("n_a", "n_b", "n_shared")])
    return (
        joined.withColumn("visual_change_kind", residue_kind(F.col("n_a"), F.col("n_b"), F.col("n_shared")))
        .withColumn("zone", G.zone(*G.centre(F.col("box"))))
        .withColumn("confidence", region_confidence(F.col("magnitude"), F.col("area_px"), s))
    )
