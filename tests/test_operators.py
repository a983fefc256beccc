from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.functions import geometry as G
from deltaweave.functions import tags as T
from deltaweave.operators import alignment, bubbles, deltas, edits, evaluation, identity, registration, rendering, retrieval, runs
from deltaweave.operators.trace import Tracer, tree
from deltaweave.plans import engine
from deltaweave.sources import documents as sources
from deltaweave.streaming import revisions


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_runs_follow_the_neighbour(spark):
    spans = spark.createDataFrame(
        [(1, "A", 1, i, t, x0, 0.0, x1, 10.0, x0, y, 10.0) for i, (t, x0, x1, y) in enumerate([("a", 0.0, 10.0, 8.0), ("b", 10.2, 20.0, 8.0), ("c", 25.0, 30.0, 12.0), ("far", 70.0, 80.0, 8.0), ("d", 0.0, 5.0, 30.0)])],
        sources.SPANS,
    )
    found = runs.run_text(runs.span_runs(spans), F.lit(100.0), F.lit(100.0))
    assert rows(found, "text") == [("ab",), ("c",), ("d",), ("far",)]


def test_bands_against_loop(spark):
    rng = np.random.default_rng(0)
    words = [(1, "A", 1, i, f"w{i}", "90", float(rng.integers(0, 300)), float(rng.integers(0, 80)), 20.0, float(rng.integers(8, 14))) for i in range(60)]
    df = spark.createDataFrame([*words, (1, "A", 1, 99, "low", "-1", 0.0, 0.0, 1.0, 1.0), (1, "A", 1, 98, " ", "95.0", 0.0, 0.0, 1.0, 1.0), (1, "A", 1, 97, "odd", "", 0.0, 0.0, 1.0, 1.0)], "pair_id long, side string, sheet int, ord int, text string, conf string, left double, top double, width double, height double")
    got = dict(rows(runs.word_bands(runs.clean_words(df)), "ord", "band"))
    seed, n, want = None, 0, {}
    for w in sorted(words, key=lambda w: (w[7], w[6], w[3])):
        if seed is None or abs(w[7] - seed[7]) > 0.5 * seed[9]:
            seed, n = w, n + 1
        want[w[3]] = n
    assert got == want


def test_bubbles(spark):
    page = (1, "A", 1)
    tokens = [(*page, i, t, x, y, 4.0) for i, (t, x, y) in enumerate([("PIT", 5.0, 3.0), ("26", 5.0, 9.0), ("9055", 5.0, 6.0), ("FT", 50.0, 3.0), ("27", 50.0, 9.0), ("77", 90.0, 90.0)])]
    circles = [(*page, 0, 0.0, 0.0, 10.0, 10.0), (*page, 1, 45.0, 0.0, 55.0, 10.0), (*page, 2, 0.0, 0.0, 10.0, 10.0)]
    t = spark.createDataFrame(tokens, "pair_id long, side string, sheet int, ord int, text string, x double, y double, size double")
    c = spark.createDataFrame(circles, "pair_id long, side string, sheet int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert rows(bubbles.stack_bubbles(t, c), "circle", "text") == [(0, "PIT 9055 26")]


def found_pair(spark, side_a, side_b):
    made = [(1, s, i, t, c, f) for s, items in (("A", side_a), ("B", side_b)) for i, (t, c, f) in enumerate(items)]
    df = spark.createDataFrame(made, "pair_id long, side string, ord int, type string, content string, field string")
    r = identity.precheck(df).first()
    return r["tier"], r["is_pair"]


def test_precheck_tiers(spark):
    title = lambda v: ("title_field", v, "drawno")
    tag = lambda v: ("valve_tag", v, None)
    assert found_pair(spark, [title("X")], [title("X")]) == ("drawing_number", True)
    assert found_pair(spark, [title("X")], [title("Y")]) == ("drawing_number", False)
    assert found_pair(spark, [title(""), tag("a")], [title(""), tag("a")]) == ("tag_overlap", True)
    assert found_pair(spark, [("equipment_tag", "E1", None)], [("equipment_tag", "E1", None)]) == ("equipment", True)
    assert found_pair(spark, [tag(x) for x in "abcdefg"], [tag(x) for x in "ghijk"]) == ("tag_overlap", False)
    assert found_pair(spark, [tag("a")], [("text", "b", None)]) == ("none", True)


def test_registration_cases(spark):
    schema = "pair_id long, ax double, ay double, bx double, by double"
    got = {r["pair_id"]: r for r in registration.similarity(spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4), (2, 0.1, 0.2, 0.5, 0.5), (2, 0.9, 0.9, 0.5, 0.5)], schema)).collect()}
    assert all((r["scale"], r["rotation"], r["tx"], r["ty"]) == (1.0, 0.0, 0.0, 0.0) for r in got.values())


def test_confidence_cases(spark):
    c = lambda **k: spark.range(1).select(deltas.confidence(*[F.lit(k[n]).cast("boolean" if n.startswith("in") else "double") for n in ("in_a", "in_b", "ca", "cb", "margin", "near")])).first()[0]
    both = {"in_a": True, "in_b": True, "near": None}
    assert c(**both, ca=1.0, cb=1.0, margin=None) == 1.0 and c(**both, ca=0.8, cb=0.8, margin=1.0) == 0.64 and c(**both, ca=1.0, cb=1.0, margin=-0.2) == 0
    one = {"in_a": True, "in_b": False, "ca": 0.9, "cb": None, "margin": None}
    assert [c(**one, near=n) for n in (0.55, 0.75, 0.95, None)] == [0.0, 0.45, 0.9, 0.9]


def test_cascades(spark):
    def run(items):
        made = [(1, 1, f"d{i}", "instrument", None, f"e{i}", n, f, old, new) for i, (n, f, old, new) in enumerate(items)]
        df = spark.createDataFrame(made, "pair_id long, sheet int, did string, element_type string, id_a string, id_b string, n_changes int, field string, old_num double, new_num double")
        return rows(deltas.cascades(df, ["pair_id", "sheet"]), "did", "is_cascade", "primary_did")

    five = run([(1, "loop", 100.0 + i, 61.0 + i) for i in range(5)])
    assert [r[1] for r in five] == [False, True, True, True, True] and {r[2] for r in five[1:]} == {"d0"}
    assert not any(r[1] for r in run([(1, "loop", 100.0, 61.0)] * 2))
    mixed = run([(1, "loop", 100.0, 61.0)] * 3 + [(2, "loop", 100.0, 61.0)])
    assert [r[1] for r in mixed] == [False, True, True, False]


@pytest.mark.parametrize(
    ("kind", "type_", "fields", "cascade", "want"),
    [("modify", "instrument", ["setpoints"], False, "critical"), ("modify", "line_tag", ["pipe_class"], False, "high"), ("move", "instrument", [], False, "low"), ("modify", "instrument", ["setpoints"], True, "low"),
     ("add", "datasheet_row", [], False, "medium"), ("remove", "nozzle", [], False, "high"), ("add", "note", [], False, "low"), ("modify", "equipment_tag", ["seq"], False, "high"), ("modify", "note", ["note_no"], False, "low")],
)
def test_severity(spark, kind, type_, fields, cascade, want):
    names = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
    assert spark.range(1).select(deltas.severity(F.lit(kind), F.lit(type_), names, F.lit(cascade))).first()[0] == want


def test_adjudication_asks_once_for_each_text(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "c", "d")], "k int, old_content string, new_content string")
    assert rows(deltas.adjudicate(df, lambda a, b: {"a": True}.get(a)), "k", "judged") == [(1, True), (2, True), (3, None)]


def test_matches_of_a_bucket(spark):
    schema = "pair_id long, sheet int, bucket string, ord int, content string, x double, y double"
    a = spark.createDataFrame([(1, 1, "t", 0, "alpha", 0.1, 0.1), (1, 1, "t", 1, "beta", 0.5, 0.5), (1, 1, "u", 2, "only", 0.5, 0.5)], schema)
    b = spark.createDataFrame([(1, 1, "t", 7, "beta", 0.5, 0.5), (1, 1, "t", 8, "alpha!", 0.1, 0.1), (1, 1, "t", 9, "zzzz", 0.9, 0.9)], schema)
    none = spark.createDataFrame([], "pair_id long, scale double, rotation double, tx double, ty double")
    got = {(r["ord_a"], r["ord_b"]): r for r in alignment.match_elements(a, b, none).collect()}
    assert set(got) == {(0, 8), (1, 7), (None, 9), (2, None)}
    assert got[1, 7]["cost"] == 0 and got[1, 7]["margin"] > 0 and got[2, None]["near_miss"] is None and got[None, 9]["near_miss"] > 0.55


def test_bm25_counts_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "valve pump"), (2, "valve"), (3, "other words here")], "doc_id int, text string")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.lit(6).alias("total"))
    score = lambda terms: dict(rows(retrieval.bm25(retrieval.postings(docs, F.col("text")), total, spark.createDataFrame([(1, t) for t in terms], "question_id int, term string")), "doc_id", "score"))
    once, twice = score(["valve"]), score(["valve", "valve"])
    assert set(once) == {1, 2} and all(abs(twice[k] - 2 * once[k]) < 1e-12 for k in once)


def test_gate(spark):
    answers = spark.createDataFrame([(1, "fine [A:1:-:x]"), (2, "REFUSED: no"), (3, "no citation"), (4, "bad [A:1:-:x] [B:1:-:y]"), (5, "none [A:1:-:x]"), (6, "typo [B:9:Z-9:x]")], "answer_id int, answer string")
    known = spark.createDataFrame([(i, "x") for i in range(1, 7)], "answer_id int, id string")
    hits = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6)], "answer_id int")
    got = rows(retrieval.gate(answers, retrieval.validate(retrieval.cited(answers), known), hits), "answer_id", "reason", "n_valid")
    assert got == [(1, "", 1), (2, "model_refused", 0), (3, "no_citation", 0), (4, "unknown_citation", 1), (5, "no_evidence", 1), (6, "", 1)]


def test_greedy_match(spark):
    schema = "pair_id long, ord int, kind string, sheet int, zone string, description string"
    p = spark.createDataFrame([(1, 0, "add", 1, "A-1", "valve added: x"), (1, 1, "add", 1, "B-2", "note added: strainer"), (1, 2, "move", 1, "A-1", "m")], schema)
    t = spark.createDataFrame([(1, 0, "add", 1, "A-1", "something else"), (1, 1, "add", 1, "C-3", "note added: strainers"), (1, 2, "add", 1, "C-3", "quite different text")], schema)
    assert rows(evaluation.greedy_match(p, t), "pred", "truth", "same_zone") == [(0, 0, True), (1, 1, False)]


def test_scores_of_nothing(spark):
    got = spark.range(1).select(*evaluation.precision_recall(F.lit(0), F.lit(0), F.lit(0))).first()
    assert tuple(got) == (1.0, 1.0, 1.0)
    assert tuple(spark.range(1).select(*evaluation.precision_recall(F.lit(0), F.lit(2), F.lit(2))).first()) == (0.0, 0.0, 0.0)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.5, True), (1.0, False)], "confidence double, correct boolean")
    assert rows(evaluation.calibration(df), "band", "n", "precision") == [(0, 0, None), (1, 1, 1.0), (2, 0, None), (3, 1, 0.0)]


def test_tracer(spark):
    t = Tracer()
    with pytest.raises(ValueError, match="no"), t.span("outer"), t.span("inner", tokens=3):
        raise ValueError("no")
    df = t.table(spark)
    assert rows(df, "name", "status", "error_type") == [("inner", "error", "ValueError"), ("outer", "error", "ValueError")]
    assert rows(tree(df), "level", "path") == [(0, "outer"), (1, "outer/inner")]
    assert len([json.loads(x) for x in t.lines().splitlines()]) == 2


def test_html_report_records(spark):
    df = spark.createDataFrame([(1, 1, 1, "add", "a </script> b"), (1, 1, 2, "move", "c")], "pair_id long, sheet int, position int, kind string, description string")
    page = rendering.html_report(df, ["kind", "description"]).first()["report"]
    body = page.split("const rows=", 1)[1].split(";const by", 1)[0]
    assert "</script>" not in body and [r["kind"] for r in json.loads(body.replace("<\\/", "</"))] == ["add", "move"]


def elements_of(spark, texts, side):
    made = [(1, side, 1, i, t, x, y, x + 0.02, y + 0.01, x, y) for i, (t, x, y) in enumerate(texts)]
    df = spark.createDataFrame(made, "pair_id long, side string, sheet int, run int, text string, x0 double, y0 double, x1 double, y1 double, anchor_x double, anchor_y double")
    return engine.text_elements(df)


BASE = [("AB12-PID-1-2-3", 0.8, 0.9), ("26-KA-905", 0.3, 0.3)] + [(f"PIT {9000 + i} 26", 0.05 + 0.19 * i, 0.2) for i in range(5)] + [("6. DELETED.", 0.4, 0.4), ("26BL9123", 0.5, 0.1), ("N4203", 0.6, 0.1)]


def test_whole_comparison(spark):
    side_b = [("AB12-PID-1-2-3", 0.8, 0.9), ("26-KA-905", 0.3, 0.3)] + [(f"PIT {8961 + i} 26", 0.05 + 0.19 * i, 0.2) for i in range(5)] + [("6-7. DELETED.", 0.4, 0.4), ("26BL9123", 0.5, 0.2), ("12. NEW NOTE", 0.2, 0.5)]
    found = engine.compare(elements_of(spark, BASE, "A").unionByName(elements_of(spark, side_b, "B")))
    got = [r.asDict() for r in found.deltas.collect()]
    kinds = sorted((r["kind"], r["element_type"], r["is_cascade"]) for r in got)
    assert kinds == sorted([("modify", "instrument", False)] + [("modify", "instrument", True)] * 4 + [("modify", "note_deleted", False), ("move", "valve_tag", False), ("remove", "nozzle", False), ("add", "note", False)])
    assert [r["semantic_null"] for r in got if r["element_type"] == "note_deleted"] == [True]
    assert {r["severity"] for r in got if r["kind"] == "remove"} == {"high"}
    assert found.report().first()["report"].startswith("# Changes") and found.boxes().count() == 16 and found.chunks().count() == 29
    s = found.summary().first()
    assert (s["n_deltas"], s["n_primary"], s["n_cascade"]) == (9, 5, 4)


def test_same_revision_has_no_changes(spark):
    found = engine.compare(elements_of(spark, BASE, "A").unionByName(elements_of(spark, BASE, "B")))
    assert found.deltas.count() == 0 and found.precheck.first()["is_pair"]


def test_refused_pair_has_no_changes(spark):
    other = [("AB12-PID-9-9-9", 0.8, 0.9), *BASE[1:]]
    found = engine.compare(elements_of(spark, BASE, "A").unionByName(elements_of(spark, other, "B")))
    assert found.deltas.count() == 0 and found.precheck.first()["tier"] == "drawing_number"


def test_span_source(spark, tmp_path):
    lines = [{"text": "26BL9123", "x0": 1, "y0": 2, "x1": 3, "y1": 4}, {"x0": 1}, {"text": "no box"}]
    (tmp_path / "12").mkdir()
    (tmp_path / "12" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json")
    got = sources.extract_spans(sources.files(spark, str(tmp_path)), pair_id=r"/(\d+)/a")
    assert rows(got, "pair_id", "side", "text") == [(12, "A", "26BL9123")]
    (tmp_path / "12" / "b.dwg").write_bytes(b"AC1032")
    dwg = sources.files(spark, str(tmp_path)).where("extension = 'dwg'")
    assert dwg.select(sources.is_dwg(F.col("extension"), F.col("magic"))).first()[0]
    with pytest.raises(Exception, match="no extractor for dwg"):
        sources.extract_spans(dwg).collect()


def test_stream_of_revisions(spark, tmp_path):
    """Rows that come late, in any order, still stand between their neighbours in time; those behind the watermark are dropped."""
    schema = "k long, at timestamp, price double, name string"
    source = tmp_path / "in"

    def add(n, data):
        spark.createDataFrame(data, "k long, at string, price double, name string").select("k", F.concat(F.lit("2024-01-01 "), "at").cast("timestamp").alias("at"), "price", "name").coalesce(1).write.parquet(str(source / f"b={n}"))
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        revisions.compare_stream(stream, "k", "at", ["price", "name"], str(tmp_path / "out"), str(tmp_path / "check"), "1 hour").awaitTermination()
        got = spark.read.schema(schema + ", kind string, fields array<string>").parquet(str(tmp_path / "out")) if (tmp_path / "out").exists() else spark.createDataFrame([], schema + ", kind string, fields array<string>")
        return sorted((r["k"], f"{r['at']:%H:%M}", r["kind"], ",".join(r["fields"])) for r in got.collect())

    add(0, [(1, "01:00", 1.0, "a"), (2, "01:10", 2.0, None)])
    add(1, [(1, "01:40", 9.0, "z"), (1, "01:20", 1.5, "a"), (3, "01:30", 3.0, "c")])
    add(2, [(1, "01:30", 1.5, "b"), (2, "01:50", 2.0, None), (2, "01:45", 2.0, "x")])  # between rows that came before
    found = add(3, [(9, "05:00", 0.0, "")])
    want = [(1, "01:00", "add", ""), (1, "01:20", "modify", "price"), (1, "01:30", "modify", "name"), (1, "01:40", "modify", "price,name")]
    want += [(2, "01:10", "add", ""), (2, "01:45", "modify", "name"), (2, "01:50", "modify", "name"), (3, "01:30", "add", "")]
    assert found == want
    assert add(4, [(1, "01:35", 7.0, "late"), (1, "04:30", 9.0, "z")]) == want  # the first is behind the watermark, the second waits
    assert add(5, [(9, "09:00", 0.0, "")]) == sorted([*want, (1, "04:30", "same", ""), (9, "05:00", "add", "")])


def test_element_ids_ignore_what_does_not_count(spark):
    b = G.box(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])
    ids = spark.range(1).select(*[T.element_id(F.lit(s), F.lit(t), F.lit(c), b).alias(n) for n, s, t, c in (("a", 1, "note", "x"), ("b", 1, "note", "x"), ("c", 2, "note", "x"))]).first()
    assert ids["a"] == ids["b"] != ids["c"] and len(ids["a"]) == 15


def test_references_of_any_number(spark):
    df = spark.createDataFrame([("SEE NOTE 4, NOTE 5 AND NOTE 123456. NOTE 9x KEYNOTE 7",), ("",), (None,), ("NOTE 5",)], "t string")
    got = [r[0] for r in df.select(edits.update_references(F.col("t"), 5)).collect()]
    assert got == ["SEE NOTE 4, NOTE 6 AND NOTE 123457. NOTE 9x KEYNOTE 7", "", None, "NOTE 6"]


def test_symbol_swap_and_reroute(spark):
    shapes = spark.createDataFrame([(1, "circle", 0.2, 0.2, 0.4, 0.4), (2, "rect", 0.0, 0.0, 0.4, 0.2), (3, "line", 0.0, 0.0, 1.0, 0.0)], "k int, kind string, x0 double, y0 double, x1 double, y1 double")
    got = {r["k"]: (r["kind"], *(round(r[c], 6) for c in ("x0", "y0", "x1", "y1"))) for r in edits.swap_symbol(shapes, F.col("k") < 3).collect()}
    assert got == {1: ("rect", 0.2, 0.2, 0.4, 0.4), 2: ("circle", 0.1, 0.0, 0.3, 0.2), 3: ("line", 0.0, 0.0, 1.0, 0.0)}
    lines = spark.createDataFrame([(1, 0, 0.1, 0.2, 0.6, 0.2), (2, 0, 0.9, 0.1, 0.9, 0.8), (3, 0, 0.0, 0.0, 1.0, 1.0)], "line_id int, seg int, x0 double, y0 double, x1 double, y1 double")
    got = [(r["line_id"], r["seg"], *(round(r[c], 6) for c in ("x0", "y0", "x1", "y1"))) for r in edits.reroute(lines, F.col("line_id") < 3, 0.1).orderBy("line_id", "seg").collect()]
    assert got == [
        (1, 0, 0.1, 0.2, 0.1, 0.3), (1, 1, 0.1, 0.3, 0.6, 0.3), (1, 2, 0.6, 0.3, 0.6, 0.2),
        (2, 0, 0.9, 0.1, 0.8, 0.1), (2, 1, 0.8, 0.1, 0.8, 0.8), (2, 2, 0.8, 0.8, 0.9, 0.8), (3, 0, 0.0, 0.0, 1.0, 1.0),
    ]


def test_trace_trees_of_any_depth(spark):
    rows = [("c", f"s{i}", f"s{i - 1}" if i else None, f"n{i}") for i in range(12)] + [("c", "x", "missing", "orphan")]
    got = {r["span_id"]: r["level"] for r in tree(spark.createDataFrame(rows, "correlation_id string, span_id string, parent_id string, name string")).collect()}
    assert got == {f"s{i}": i for i in range(12)}


def test_touching_boxes_against_loop(spark):
    """Dots, lines, full sheets, boxes outside the sheet, on grid lines and with common borders; repeated and null ones."""
    from deltaweave.operators.spatial import touching

    rng = random.Random(7)
    grid = lambda: rng.choice([rng.random(), rng.randrange(-2, 11) / 8, rng.randrange(0, 513) / 512])
    sides = []
    for _ in range(2):
        rows = []
        for i in range(150):
            x, y, w, h = grid(), grid(), rng.choice([0, 1 / 512, 0.01, 0.125, 0.5, 3]), rng.choice([0, 1 / 512, 0.03, 0.25, 1])
            rows.append((i % 3, (x, y, x + w, y + h)))
        sides.append([*rows, rows[0], (0, None), (0, (None, 0.0, 1.0, 1.0))])
    schema = "page int, box struct<x0: double, y0: double, x1: double, y1: double>"
    found = touching(*[spark.createDataFrame(s, schema) for s in sides], ["page"])
    got = [(r["page"], tuple(r["left_box"]), tuple(r["right_box"])) for r in found.collect()]
    whole = [{(p, b) for p, b in s if b is not None and None not in b} for s in sides]
    want = {(p, a, b) for p, a in whole[0] for q, b in whole[1] if p == q and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_touching_on_a_crowded_page(spark):
    """100,000 boxes a side on one page, by equality of cells alone."""
    from deltaweave.operators.spatial import touching

    made = lambda seed: spark.range(100_000).select(F.lit(1).alias("page"), F.rand(seed).alias("x"), F.rand(seed + 1).alias("y")).select("page", G.box(F.col("x"), F.col("y"), F.col("x") + 0.002, F.col("y") + 0.002).alias("box"))
    found = touching(made(1), made(3), ["page"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert 100_000 < found.count() < 250_000  # about 100,000 ** 2 * 0.004 ** 2


def test_edits_without_a_target_fail(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "target string, n int")
    elements = spark.createDataFrame([("a",), ("b",), ("b",)], "content string")
    assert sorted(r["n"] for r in edits.with_targets(wanted, elements, "content").collect()) == [1, 2, 3]
    for rows, name in (([("a", 1), ("zz top", 4)], "zz top"), ([(None, 5)], "null")):
        with pytest.raises(Exception, match=f"no element holds the text to edit: {name}"):
            edits.with_targets(spark.createDataFrame(rows, "target string, n int"), elements, "content").collect()


def test_added_and_removed_elements(spark):
    pairs = spark.createDataFrame([(1,), (2,)], "pair_id long")
    added = {r["pair_id"]: r.asDict() for r in edits.add_instruments(pairs).collect()}
    assert added[1]["content"] == "PIT 9748 26 SD HH:160 LL:75" and all(0.15 <= r["x"] <= 0.75 and 0.15 <= r["y"] <= 0.85 for r in added.values())
    e = spark.createDataFrame([(1, i, "valve_tag" if i % 2 else "note", f"26BL{i}", 0.5, 0.5) for i in range(6)] + [(2, 9, "note", "x", 0.1, 0.1)], "pair_id long, k long, type string, content string, x double, y double")
    chosen = set()
    for seed in range(8):
        kept, gone = edits.remove_one(e, F.col("type") == "valve_tag", "k", seed)
        (r,) = gone.collect()
        assert r["type"] == "valve_tag" and kept.count() == 6 and kept.where(f"k = {r['k']}").count() == 0
        chosen.add(r["k"])
    assert len(chosen) > 1
    (label,) = edits.labelled("remove", gone).collect()
    assert tuple(label) == (1, "remove", "valve_tag", "F-7", f"valve_tag {r['content']} removed")
