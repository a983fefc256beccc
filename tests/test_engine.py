"""From spans, paths and images to changes, search and outputs."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.operators import bubbles, raster, retrieval
from deltaweave.plans import engine, outputs
from deltaweave.sources import images

PAGE = "pair_id long, side string, sheet int"
SPANS = PAGE + ", ord int, text string, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, size double"
PATHS = PAGE + ", ord int, items array<string>, x0 double, y0 double, x1 double, y1 double, start_x double, start_y double"


def filtered(image, kinds, step=1):
    """PNG whose rows carry the given filters in turn, written from the definition."""
    h, stride = image.shape[0], image.size // image.shape[0]
    rows, above = b"", [0] * stride
    for y in range(h):
        line, kind = [int(v) for v in image[y].ravel()], kinds[y % len(kinds)]
        left = lambda x, r: r[x - step] if x >= step else 0
        out = []
        for x in range(stride):
            a, b, c = left(x, line), above[x], left(x, above)
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((line[x] - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        rows += bytes([kind, *out])
        above = line
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    head = struct.pack(">IIBBBBB", image.shape[1], h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    data = zlib.compress(rows)
    return images.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (11, 7), np.uint8), rng.integers(0, 256, (10, 6, 3), np.uint8)
    assert (images.read_png(images.write_png(grey)) == grey).all()
    assert (images.read_png(filtered(grey, [0, 1, 2, 3, 4])) == grey).all()
    luma = np.rint(colour @ np.array([0.299, 0.587, 0.114]))
    assert (images.read_png(filtered(colour, [4, 3, 2, 1, 0], 3)) == luma).all()
    assert (images.read_png(images.write_png(colour)) == luma).all()
    for broken in (b"", b"GIF89a", images.write_png(grey)[:40]):
        with pytest.raises(ValueError, match="PNG"):
            images.read_png(broken)


def test_filters_along_diagonals(monkeypatch):
    rng = np.random.default_rng(2)
    for rows in (1, 3, 1024):
        monkeypatch.setattr(images, "DIAGONAL_ROWS", rows)
        for step, shape in ((1, (11, 7)), (1, (1, 1)), (1, (4, 30)), (3, (10, 6, 3)), (4, (3, 1, 4))):
            image = rng.integers(0, 256, shape, np.uint8)
            rows_of = image.reshape(shape[0], -1)
            raw = filtered(image, [4, 3, 4, 2, 3, 1, 0, 4], step)
            body = zlib.decompress(b"".join(c for k, c in chunks_of(raw) if k == b"IDAT"))
            assert (images._unfilter(body, shape[0], rows_of.shape[1], step) == rows_of).all()
    with pytest.raises(ValueError, match="PNG filter 7"):
        images._unfilter(bytes([7, 0]), 1, 1, 1)


def chunks_of(png):
    at = 8
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        yield kind, png[at + 8 : at + 8 + n]
        at += 12 + n


@pytest.mark.parametrize(("scale", "rotation", "tx", "ty"), [(1.0, 0.0, 0.1, 0.0), (0.9, 0.1, 0.02, -0.03)])
def test_warp_against_points(scale, rotation, tx, ty):
    """A blob of B must stand in A where the transform puts its centre."""
    image = np.full((120, 160), 255.0)
    y, x = 60, 70
    image[y - 3 : y + 4, x - 3 : x + 4] = 0
    out = 255 - raster.warp(image, (100, 200), scale, rotation, tx, ty)
    cy, cx = ((np.indices(out.shape) * out).sum((1, 2)) / out.sum()).tolist()
    u, v = x / 160, y / 120
    want = (scale * (math.cos(rotation) * u - math.sin(rotation) * v) + tx) * 200, (scale * (math.sin(rotation) * u + math.cos(rotation) * v) + ty) * 100
    assert abs(cx - want[0]) < 0.2 and abs(cy - want[1]) < 0.2


def spans_of(spark, pair, side, texts):
    return spark.createDataFrame([(pair, side, 1, i, t, x, y, x + 10, y + 5, x, y + 5, 5.0) for i, (t, x, y) in enumerate(texts)], SPANS)


def paths_of(spark, pair, side, paths):
    return spark.createDataFrame([(pair, side, 1, i, items, *box, *start) for i, (items, box, start) in enumerate(paths)], PATHS)


def size():
    return F.lit(1000.0), F.lit(800.0)


TEXTS = [("AB12-PID-1-2-3", 800.0, 700.0), ("26BL9123", 500.0, 100.0), ("26BL9124", 100.0, 600.0), ("PIT", 300.0, 300.0), ("26", 300.0, 320.0), ("9055", 300.0, 340.0), ("99", 700.0, 20.0)]
PATHS_A = [(["re"], (0.0, 0.0, 1000.0, 800.0), (None, None)), (["c", "c"], (280.0, 290.0, 330.0, 350.0), (None, None)), (["l"], (100.0, 200.0, 400.0, 200.0), (400.0, 200.0)), (["re"], (600.0, 600.0, 650.0, 620.0), (None, None))]


def test_paths_and_bubbles_become_elements(spark):
    got = {r["ord"]: r.asDict() for r in engine.from_spans(spans_of(spark, 1, "A", TEXTS), *size(), paths=paths_of(spark, 1, "A", PATHS_A)).collect()}
    assert sorted(got) == list(range(1, len(got) + 1))
    of = lambda type_: [r for r in got.values() if r["type"] == type_]
    (tag,) = of("instrument")
    assert tag["content"] == "PIT 9055 26" and {a["key"] for a in tag["attrs"]} >= {"func", "loop"}
    assert (tag["box"]["y0"], tag["box"]["y1"]) == (300 / 800, 345 / 800) and len(of("unknown")) == 1
    kinds = {r["geom_kind"]: r for r in of("geometry")}
    assert sorted(kinds) == ["circle", "line", "rect"]  # the border is none
    assert [a["num"] for a in kinds["circle"]["attrs"] if a["key"] == "r_norm"] == [pytest.approx((50 / 1000 + 60 / 800) / 4)]
    assert kinds["line"]["zone"] == "C-5" and kinds["rect"]["zone"] == "H-8"  # start of the line, centre of the rest
    assert {r["confidence"] for r in got.values()} == {1.0}


def test_bubble_padding_is_the_circles(spark):
    t = spark.createDataFrame([(1, "A", 1, i, w, x, 5.0) for i, (w, x) in enumerate([("PIT", 5.0), ("26", 15.9), ("9055", -5.9), ("FT", 16.1)])], PAGE + ", ord int, text string, x double, y double")
    c = spark.createDataFrame([(1, "A", 1, 0, 0.0, 0.0, 10.0, 10.0)], PAGE + ", ord int, x0 double, y0 double, x1 double, y1 double")
    assert [(r["text"], r["func"], r["tokens"]) for r in bubbles.stack_bubbles(t, c).collect()] == [("PIT 9055 26", 0, [0, 1, 2])]


def drawn(extra=()):
    image = np.full((400, 500), 255, np.uint8)
    image[100:140, 50:90] = 0
    for y, x in extra:
        image[y : y + 40, x : x + 60] = 0
    return images.write_png(image)


def test_whole_pipeline(spark, tmp_path):
    for name, content in (("a", drawn()), ("b", drawn([(250, 300)]))):
        (tmp_path / "1" / name).mkdir(parents=True)
        (tmp_path / "1" / name / "1.png").write_bytes(content)
    pictures = images.page_images(spark, str(tmp_path), pair_id=r"/(\d+)/[ab]/", side=r"/([ab])/")
    side_b = [*TEXTS[:2], ("26BL9124", 100.0, 500.0), *TEXTS[3:5], ("9056", 300.0, 340.0), TEXTS[6]]
    spans = spans_of(spark, 1, "A", TEXTS).unionByName(spans_of(spark, 1, "B", side_b))
    paths = paths_of(spark, 1, "A", PATHS_A).unionByName(paths_of(spark, 1, "B", PATHS_A[:3]))
    found = engine.run(spans, *size(), str(tmp_path / "run"), paths, pictures)
    got = [r.asDict() for r in found.deltas.collect()]
    assert sorted((r["kind"], r["element_type"]) for r in got) == [("modify", "instrument"), ("move", "valve_tag"), ("remove", "geometry"), ("unclassified_visual_change", "geometry")]
    (visual,) = (r for r in got if r["did"].startswith("visual."))
    assert visual["box"]["x0"] <= 300 / 500 and visual["box"]["x1"] >= 360 / 500 and visual["zone_b"] == "G-8" and visual["confidence"] <= 0.45
    assert found.boxes().where("dashed").count() == 2 and found.summary().first()["n_deltas"] == 4
    questions = spark.createDataFrame([(7, 1, "What changed in zone G-8?"), (8, 1, "nosuchword"), (9, 2, "zone")], "question_id long, pair_id long, question string")
    hits = found.search(questions).collect()
    assert {r["question_id"] for r in hits} == {7} and min(hits, key=lambda r: r["rank"])["id"] == "visual.000001"
    assert "[delta:1:G-8:visual.000001]" in retrieval.context_lines(found.search(questions)).first()["context"]

    # To the end: reports, drawn sheets, events, and answers through the gate.
    done = outputs.finish(found, str(tmp_path / "run"), pictures)
    files = {str(p.relative_to(done.folder)): p.read_bytes() for p in Path(done.folder).rglob("*") if p.is_file()}
    assert sorted(files) == ["1/markup_a_sheet1.png", "1/markup_b_sheet1.png", "1/report.html", "1/report.json", "1/report.md"] and (done.reports, done.sheets) == (3, 2)
    told = json.loads(files["1/report.json"])
    assert told["n_deltas"] == 4 and sorted(d["kind"] for d in told["deltas"]) == ["modify", "move", "remove", "unclassified_visual_change"]
    assert files["1/report.md"].count(b"\n- ") + files["1/report.md"].count(b"\n  - ") == 4
    assert files["1/report.html"].count(b"data:image/png;base64,") == 2 and base64.b64encode(files["1/markup_a_sheet1.png"]) in files["1/report.html"]
    violet = (images.read_colours(files["1/markup_b_sheet1.png"]) == (128, 64, 176)).all(axis=2)
    assert violet[240:300, 290:370].any()
    events = spark.read.json(str(tmp_path / "run" / "events"))
    assert {"request", "markup", "report"} <= {r["name"] for r in events.collect()} and events.where("name LIKE 'query:%'").count() > 1

    def client(system, prompt, temperature):
        assert system == outputs.SYSTEM
        cited = re.findall(r"\[[^\]]*\]", prompt)[0]
        return {"What changed in zone G-8?": f"It changed {cited}.", "valve": "no citation", "26BL": "see [A:1:B-3:el_unknown]"}.get(prompt.rsplit("Question: ", 1)[1], "REFUSED: no")

    more = spark.createDataFrame([(7, 1, "What changed in zone G-8?"), (8, 1, "nosuchword"), (9, 2, "zone"), (10, 1, "zone")], "question_id long, pair_id long, question string")
    got = {r["question_id"]: (r["refused"], r["reason"], r["n_valid"]) for r in outputs.answered(found, more, client, str(tmp_path / "chat")).collect()}
    assert got == {7: (False, "", 1), 8: (True, "no_evidence", 0), 9: (True, "no_evidence", 0), 10: (True, "model_refused", 0)}


def tokens(text):
    whole = [t.lower() for t in re.findall(r"[A-Za-z0-9\"'/.\-]+", text or "")]
    return whole + [p for t in whole if "-" in t for p in t.split("-") if p]


def test_search_against_loop(spark):
    rows = [(pair, src, f"{src}{i}", 1, zone, text, "note") for pair in (1, 2) for src in ("A", "delta") for i, (zone, text) in enumerate([("F-7", "valve A-1 valve"), (None, "pump in F-7"), ("B-2", None), ("F-7", "loop 26 valve")])]
    chunks = spark.createDataFrame(rows, "pair_id long, source string, id string, sheet int, zone string, content string, kind string")
    asked = [(1, 1, "valve valve in zone F-7"), (2, 2, "pump renumber"), (3, 3, "valve")]
    questions = spark.createDataFrame(asked, "question_id long, pair_id long, question string")
    aliases = retrieval.load_aliases(spark)
    got = {(r["question_id"], r["source"], r["id"]): r["score"] for r in retrieval.search(chunks, questions, aliases).collect()}
    want = {}
    for q, pair, text in asked:
        docs = [(r[1], r[2], tokens(r[5]) + (["zone", *tokens(r[4])] if r[4] else [])) for r in rows if r[0] == pair]
        mean = sum(len(d[2]) for d in docs) / max(1, len(docs))
        terms = tokens(text) + [t for phrase, t in retrieval.ALIASES if phrase in text.lower()]
        for source, id_, words in docs:
            n, score = Counter(words), 0.0
            for t in terms:
                df = sum(t in d[2] for d in docs)
                if n[t]:
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * n[t] * 2.5 / (n[t] + 1.5 * (0.25 + 0.75 * len(words) / mean))
            if score > 0:
                want[q, source, id_] = round(score * (1.5 if source == "delta" else 1.0), 6)
    assert got == pytest.approx(want) and {q for q, *_ in got} == {1, 2}


def test_alias_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Set Point": ["setpoints", "limit"]}')
    assert sorted(tuple(r) for r in retrieval.load_aliases(spark, str(tmp_path / "a.json")).collect()) == [("set point", "limit"), ("set point", "setpoints")]
    assert retrieval.load_aliases(spark, str(tmp_path / "none.json")).count() == 0


def test_held_out_elements(spark):
    df = spark.createDataFrame([(1, "A", 1, " PIT 1 ", 10.04, 20.0, 900.0, 30.0), (1, "A", 1, "  ", 0.0, 0.0, 1.0, 1.0)], PAGE + ", text string, x0 double, y0 double, x1 double, y1 double")
    (r,) = engine.held_out_elements(df, *size(), "a").collect()
    assert r["eid"] == "a:" + hashlib.sha1(b"PIT 1|10.0,20.0").hexdigest()[:10] and r["zone"] == "A-6" and r["text"] == "PIT 1"
