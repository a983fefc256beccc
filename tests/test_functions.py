from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.functions import geometry as G
from deltaweave.functions import tags as T
from deltaweave.functions import text as X
from deltaweave.operators import alignment, evaluation, raster, sparse
from deltaweave.operators.alignment import lcs, similarity, solve_assignment


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(("x", "y", "zone"), [(0, 0, "A-1"), (1, 1, "J-12"), (0.5, 0.5, "F-7"), (-0.2, 1.7, "J-1"), (0.0833, 0.0999, "A-1")])
def test_zone(spark, x, y, zone):
    assert one(spark, G.zone(F.lit(float(x)), F.lit(float(y)))) == zone


@pytest.mark.parametrize(
    ("text", "type_"),
    [
        ('4"-PV-26-9048-GC11S-38', "line_tag"), ('4"-PV-26-9048-GC11S-38 tail', "line_tag"), ("PIT 9055 26", "instrument"), ("PIT -905 26 SD HH:245 LL:-120", "instrument"), ("PIT 9055 26 SD HH:245", "text"),
        ("26BL9123", "valve_tag"), ("N4203", "nozzle"), ("26-KA-905", "equipment_tag"), ("REV C", "title_field"), ("SHEET 1 OF 4", "title_field"), ("AB-PID-1-2", "unknown"), ("AB12-PID-1-2-3", "title_field"),
        ("6-7. DELETED.", "note_deleted"), ("6. DELETED.", "note_deleted"), ("3. SEE DCN-KP-1234-5", "dcn_note"), ("DCN-KP-1234-5", "unknown"), ("A 2023-05-01 ISSUED", "rev_row"), ("12. text", "note"),
        ("", "unknown"), ("loose", "unknown"), ("two words", "text"), ("  N4203 ", "nozzle"), ("7", "unknown"),
    ],
)
def test_classify(spark, text, type_):
    assert one(spark, T.classify(F.lit(text), F.lit(0.4), F.lit(0.3)))["type"] == type_


def test_classify_places(spark):
    kind = lambda t, x, y: one(spark, T.classify(F.lit(t), F.lit(x), F.lit(y)))
    assert kind("7", 0.01, 0.5)["type"] == "zone_label" and kind("K", 0.01, 0.5)["type"] == "unknown"
    assert kind("free", 0.6, 0.6)["type"] == "datasheet_row" and kind("free", 0.8, 0.9)["confidence"] == 0.5


def test_tokens(spark):
    assert one(spark, X.tokenise(F.lit('See FIT-9050, "A" -- x/y.'))) == ["see", "fit-9050", '"a"', "--", "x/y.", "fit", "9050"]


def test_citations(spark):
    text = "so [A:1:B-3:el_1] and [delta:2:-:d4] but [a:b:c] and [x:[y:z:w]"
    assert [(c["source"], c["zone"], c["id"]) for c in one(spark, X.parse_citations(F.lit(text)))] == [("A", "B-3", "el_1"), ("delta", "-", "d4")]
    assert one(spark, X.citation(F.lit("A"), F.lit(1), F.lit(None).cast("string"), F.lit("e"))) == "[A:1:-:e]"
    assert one(spark, X.sentence_before(F.lit("abcdef [c]"), F.lit("[c]"), 4)) == "def [c]"
    assert one(spark, X.sentence_before(F.lit("abc"), F.lit("[c]"), 4)) == "abc"
    assert one(spark, X.cost_estimate(F.lit(1000), F.lit(500), F.lit(None).cast("double"), F.lit(1.0))) is None


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("abc", "", 0.0), ("ABCBDAB", "BDCABA", 8 / 13), ("same", "same", 1.0), ("ab", "ba", 0.5)])
def test_similarity(spark, a, b, want):
    assert abs(one(spark, X.indel_similarity(F.lit(a), F.lit(b))) - want) < 1e-12
    assert abs(similarity(a, b) - want) < 1e-12


def test_lcs_against_table():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 90))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert lcs(a, b) == t[-1, -1]


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        cost = rng.random((n, m)) if rng.random() < 0.7 else rng.integers(0, 3, (n, m)).astype(float)
        rows, cols = solve_assignment(cost)
        assert len(set(rows)) == len(set(cols)) == min(n, m)
        small, wide = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(wide), len(small)))
        assert abs(cost[rows, cols].sum() - best) < 1e-9


def test_partial_ratio():
    assert evaluation.partial_ratio("note", "the note is here") == 100 and evaluation.partial_ratio("", "") == 100 and evaluation.partial_ratio("", "x") == 0
    assert 70 < evaluation.partial_ratio("notes", "a note x") < 100


def test_boxes(spark):
    b = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    assert one(spark, G.iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0 and one(spark, G.intersects(b(0, 0, 1, 1), b(1, 0, 2, 1))) is False
    assert one(spark, G.overlap_fraction(b(0, 0, 2, 1), b(1, 0, 5, 5))) == 0.5
    assert one(spark, G.border_rect(b(0.01, 0.01, 0.99, 0.99))) and not one(spark, G.border_rect(b(0.1, 0, 1, 1)))


# --- raster


def test_regions_known_cases():
    blank = np.full((60, 80), 255.0)
    assert raster.change_regions(blank, blank) == []
    drawn = blank.copy()
    drawn[20:40, 30:50] = 0
    found = raster.change_regions(blank, drawn)
    assert len(found) == 1 and found[0][0] <= 30 / 80 and found[0][2] >= 50 / 80
    noise = np.random.default_rng(0).integers(0, 256, blank.shape).astype(float)
    assert raster.change_regions(blank, noise) == []  # over a quarter of the sheet
    moved = np.roll(drawn, 2, axis=1)
    assert raster.change_regions(drawn, raster.warp(moved, drawn.shape, 1.0, 0.0, -2 / 80, 0.0)) == []


def test_ssim_against_loop():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (2, 9, 11)).astype(float)
    got = raster.structural_difference(a, b)
    wide = [np.pad(x, 3, mode="symmetric") for x in (a, b)]
    for y in range(9):
        for x in range(11):
            p, q = (w[y : y + 7, x : x + 7].ravel() for w in wide)
            c1, c2 = 6.5025, 58.5225
            s = (2 * p.mean() * q.mean() + c1) * (2 * np.cov(p, q)[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var(ddof=1) + q.var(ddof=1) + c2))
            assert abs(got[y, x] - np.clip(1 - s, 0, 1)) < 1e-9


def test_blurred_difference():
    """Without SSIM, and on images too small for it, blurred images are compared, also where b is the lighter."""
    from dataclasses import replace

    rng = np.random.default_rng(5)
    plain = replace(raster.DEFAULT, ssim=False)
    for shape in ((9, 11), (2, 5), (1, 1), (1, 6)):
        a, b = rng.integers(0, 256, (2, *shape), np.uint8)
        w = np.exp(-0.5 * np.array([-1, 0, 1]) ** 2)
        w /= w.sum()
        mirror = lambda i, n: min(max(abs(i) if abs(i) < n else 2 * (n - 1) - abs(i), 0), n - 1)
        slow = lambda im: np.rint([[sum(w[p] * w[q] * im[mirror(y + p - 1, shape[0]), mirror(x + q - 1, shape[1])] for p in range(3) for q in range(3)) for x in range(shape[1])] for y in range(shape[0])])
        got = raster.structural_difference(a, b, plain)
        assert np.abs(got - np.abs(slow(a) - slow(b)) / 255).max() < 1e-9
        if min(shape) < 3:
            assert (raster.structural_difference(a, b) == got).all()


def test_morphology_against_loop():
    rng = np.random.default_rng(6)
    for k in (1, 2, 3, 4, 9):
        mask = rng.random((13, 17)) < 0.7
        for pick, fill in ((np.minimum, True), (np.maximum, False)):
            wide = np.pad(mask, k, constant_values=fill)
            want = [[pick.reduce(wide[y + k - k // 2 : y + 2 * k - k // 2, x + k - k // 2 : x + 2 * k - k // 2].ravel()) for x in range(17)] for y in range(13)]
            assert (raster._shifted(mask, k, pick) == np.array(want)).all()


@pytest.mark.parametrize("size", [16, 37])
def test_tiles_give_the_whole_sheets_regions(spark, size):
    """Regions over seams, corners and borders, thin lines that cross many tiles, and rings."""
    from dataclasses import replace

    s = replace(raster.DEFAULT, tile=size, least_area=10, most_area=0.9)
    rng = np.random.default_rng(size)
    frames, want = [], []
    for sheet in range(4):
        shape = (int(rng.integers(150, 260)), int(rng.integers(150, 260)))
        a = np.full(shape, 255, np.uint8)
        b = a.copy()
        for image in (a, b, b):
            for _ in range(5):
                y, x = (int(rng.integers(0, n)) for n in shape)
                image[y : y + int(rng.integers(3, 40)), x : x + int(rng.integers(3, 40))] = rng.integers(0, 200)
        b[shape[0] // 2 - 2 : shape[0] // 2 + 2, 20:] = 0
        if sheet == 3:
            b = a.copy()
        frames += [(1, sheet, *shape, *place, *p.shape, p.tobytes(), q.tobytes()) for *place, p, q in raster.tiles(a, b, s)]
        want += [(1, sheet, *f) for f in raster.change_regions(a, b, s)]
    assert len(want) > 8 and not any(w[1] == 3 for w in want)
    got = [tuple(r) for r in raster.tiled_regions(spark.createDataFrame(frames, raster.TILE), s).collect()]
    plain = lambda rows: sorted((*r[:7], round(r[7], 9)) for r in rows)
    assert plain(got) == plain(want)


def test_tile_work_on_a_large_sheet():
    """A sheet of 24 megapixels with thousands of regions, labelled in seconds."""
    mask = np.zeros((4000, 6000), bool)
    mask[::20, ::2] = True
    mask[10::20, :] = True
    began = time.time()
    *_, part = raster.strokes(mask)
    assert part.max() + 1 == 200 * 3000 + 200 and time.time() - began < 30


def test_components_against_flood():
    rng = np.random.default_rng(4)
    for _ in range(20):
        mask = rng.random((12, 15)) < 0.45
        labels = raster.components(mask)
        seen, count = np.zeros(mask.shape, bool), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            count += 1
            stack, cells = [(y, x)], set()
            while stack:
                p, q = stack.pop()
                if 0 <= p < 12 and 0 <= q < 15 and mask[p, q] and not seen[p, q]:
                    seen[p, q] = True
                    cells.add((p, q))
                    stack += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            assert len({labels[c] for c in cells}) == 1
        assert len(np.unique(labels[labels > 0])) == count


def test_otsu():
    image = np.array([[10, 12, 11], [200, 210, 205]])
    assert (raster.binarise(image) == [[0, 0, 0], [255, 255, 255]]).all()


def test_settings_from_mapping():
    from deltaweave.config import DEFAULT, from_mapping

    assert from_mapping({}) == DEFAULT
    found = from_mapping({"DW_MAX_COST": "0.5", "DW_TOP_K": "3", "OTHER": "x"}, "DW_")
    assert (found.max_cost, found.top_k, found.k1) == (0.5, 3, 1.5)


# --- assignment without a matrix


def _elements(r, n, length):
    return [(i, "".join(r.choice("abcd é") for _ in range(r.randrange(length))), r.random(), r.random()) for i in range(n)]


def test_sparse_assignment_equals_the_dense_one(monkeypatch):
    monkeypatch.setattr(sparse, "TRIED", 4)
    r = random.Random(1)
    for case in range(150):
        a, b = (_elements(r, r.randrange(1, 25), r.choice([3, 8, 90])) for _ in range(2))
        if case % 3 == 0:  # nearly the same, many equal costs
            b = [(i, x[1], x[2] + r.choice([0, 0.01]), x[3]) for i, x in enumerate(a) if r.random() < 0.9] or b
        costs = sparse.Costs(a, b, similarity, (0.6, 0.4))
        full = np.array([[0.6 * (1 - similarity(x[1], y[1])) + 0.4 * np.hypot(x[2] - y[2], x[3] - y[3]) for y in b] for x in a])
        assert np.abs(np.array([costs.of(i, np.arange(len(b))) for i in range(len(a))]) - full).max() < 1e-12
        best = sparse.cheapest(costs, 2), sparse.cheapest(costs.flipped(), 2)
        for (_, least), matrix in zip(best, (full, full.T), strict=True):
            assert np.allclose(least, np.sort(matrix, axis=1)[:, :2])
        rows, cols = sparse.assignment(costs, *best)
        p, q = solve_assignment(full)
        assert len(rows) == min(full.shape) == len(set(cols.tolist())) == len(set(rows.tolist()))
        assert abs(full[rows, cols].sum() - full[p, q].sum()) < 1e-9


def test_sparse_and_dense_buckets_agree(monkeypatch):
    r = random.Random(2)
    a = _elements(r, 60, 12)
    b = [(i, x[1] + r.choice(["", "x"]), x[2] + r.gauss(0, 0.01), x[3]) for i, x in enumerate(a) if i % 9] + _elements(r, 5, 12)
    found = []
    for limit in (0, 1 << 30):
        monkeypatch.setattr(alignment, "SPARSE_FROM", limit)
        found.append(sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in alignment._solve_bucket(a, b, alignment.DEFAULT)], key=repr))
    assert found[0] == found[1] and sum(row[3] is not None for row in found[0]) > 40


def test_large_bucket():
    """3,000 a side: the pairs never stand in memory together."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(400)]
    a = [(i, " ".join(r.choice(words) for _ in range(3)), r.random(), r.random()) for i in range(3000)]
    b = [(i, x[1] + ("x" if i % 10 == 0 else ""), x[2] + r.gauss(0, 0.003), x[3]) for i, x in enumerate(a) if i % 20]
    tracemalloc.start()
    found = alignment._solve_bucket(a, b, alignment.DEFAULT)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(f[0] == f[1] for f in found) > 2800 and peak < 3000 * 2850 * 8  # less than one matrix of costs
