"""Pair scores, the plain matcher, labels and controls, against plain loops."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from deltaweave.operators import evaluation
from deltaweave.operators.alignment import similarity

CHANGE = "pair_id long, ord int, kind string, sheet int, zone string, description string, semantic_null boolean, is_cascade boolean, confidence double"
KINDS = ("add", "remove", "modify", "move")


def loop_match(preds, truth, floor=60.0):
    used, out = set(), []
    for p in preds:
        open_ = [t for t in truth if t["ord"] not in used and t["kind"] == p["kind"] and t["sheet"] == p["sheet"]]
        like = {t["ord"]: 100 * similarity(p["description"], t["description"]) for t in open_}
        here = [t for t in open_ if t["zone"] == p["zone"]]
        best = None
        for t in here:
            if best is None or like[t["ord"]] > like[best["ord"]]:
                best = t
        if best is None:
            for t in open_:
                if like[t["ord"]] >= floor and (best is None or like[t["ord"]] >= like[best["ord"]]):
                    best = t
        if best is not None:
            used.add(best["ord"])
            out.append((p["ord"], best["ord"]))
    return out


def made(rng, pair, n, visual):
    words = ["valve", "pump", "line", "note", "tag"]
    kinds = KINDS + (evaluation.VISUAL,) * visual
    row = lambda i: (pair, i, rng.choice(kinds), rng.randint(1, 2), rng.choice(["A-1", "B-2"]), " ".join(rng.choices(words, k=4)), rng.random() < 0.2, rng.random() < 0.3, rng.random())
    return [row(i) for i in range(n)]


def test_pair_scores_against_loop(spark):
    rng = random.Random(5)
    preds = [r for pair in (1, 2, 3) for r in made(rng, pair, 25, 1)]
    truth = [r for pair in (1, 2, 4) for r in made(rng, pair, 20, 0)]
    p, t = (spark.createDataFrame(x, CHANGE) for x in (preds, truth))
    got = evaluation.score_pairs(p, t)
    names = [c.split()[0] for c in CHANGE.split(", ")]
    cards = {r["pair_id"]: r.asDict() for r in got.card.collect()}
    by_kind = {(r["pair_id"], r["kind"]): (r["tp"], r["fp"], r["fn"]) for r in got.by_kind.collect()}
    assert set(cards) == {1, 2, 3, 4}
    for pair, card in cards.items():
        ps, ts = ([dict(zip(names, r, strict=True)) for r in rows if r[0] == pair] for rows in (preds, truth))
        nulls, real = [x for x in ts if x["semantic_null"]], [x for x in ts if not x["semantic_null"]]
        claimed = loop_match(ps, nulls)
        taken = {i for i, _ in claimed}
        counted = [x for x in ps if x["ord"] not in taken and not x["semantic_null"] and x["kind"] != evaluation.VISUAL]
        hits = loop_match(counted, real)
        assert (card["tp"], card["fp"], card["fn"]) == (len(hits), len(counted) - len(hits), len(real) - len(hits))
        for scope, part in (("primary", False), ("cascade", True)):
            want = [x for x in real if x["is_cascade"] == part]
            assert card[f"{scope}_recall"] == (round(len(loop_match(counted, want)) / len(want), 4) if want else 1.0)
        assert card["null_emission_rate"] == (round(len(claimed) / len(nulls), 4) if nulls else None)
        flagged = [x for x in ps if x["semantic_null"]]
        hit = len(loop_match(flagged, nulls))
        assert card["null_precision"] == (round(hit / len(flagged), 4) if flagged else 1.0)
        assert card["null_recall"] == (round(hit / len(nulls), 4) if nulls else 1.0)
        assert (card["n_truth"], card["n_null"], card["n_pred"]) == (len(real), len(nulls), len(ps))
        assert card["n_visual"] == sum(x["kind"] == evaluation.VISUAL for x in ps)
        for kind in KINDS:
            k_p, k_t = [x for x in counted if x["kind"] == kind], [x for x in real if x["kind"] == kind]
            n = len(loop_match(k_p, k_t))
            if k_p or k_t:
                assert by_kind[pair, kind] == (n, len(k_p) - n, len(k_t) - n)
    assert got.real.where("correct").count() == sum(c["tp"] for c in cards.values())


def loop_naive(a, b):
    out = []
    for type_ in {x[0] for x in a + b}:
        pool = {}
        for x in b:
            if x[0] == type_:
                pool.setdefault(x[2], []).append(x)
        left = []
        for x in (x for x in a if x[0] == type_):
            if pool.get(x[2]):
                y = pool[x[2]].pop(0)
                out.append((type_, "moved" if math.hypot(x[3] - y[3], x[4] - y[4]) > 0.04 else "unchanged", x[1], y[1]))
            else:
                left.append(x)
        rest = [y for group in pool.values() for y in group]
        scored = [(100 * similarity(x[2], y[2]), x[1], y[1]) for x in left for y in rest]
        used_a, used_b = set(), set()
        for s, i, j in sorted((z for z in scored if z[0] >= 55), key=lambda z: -z[0]):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((type_, "modified", i, j))
        out += [(type_, "removed", x[1], None) for x in left if x[1] not in used_a] + [(type_, "added", None, y[1]) for y in rest if y[1] not in used_b]
    return sorted(out, key=repr)


def test_plain_matcher_against_loop(spark):
    rng = random.Random(9)
    side = lambda n: [(rng.choice(["note", "tag"]), i, "".join(rng.choices("abc", k=rng.randint(1, 6))), rng.random() / 10, rng.random() / 10) for i in range(n)]
    a, b = side(60), side(50)
    df = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "pair_id long, type string, ord int, content string, x double, y double")
    got = evaluation.naive_match(df(a), df(b))
    assert sorted(((r["type"], r["status"], r["ord_a"], r["ord_b"]) for r in got.collect()), key=repr) == loop_naive(a, b)
    assert {r["status"] for r in evaluation.naive_match(df(a), df([])).collect()} == {"removed"}


def test_net_changes(spark):
    reference = spark.createDataFrame(
        [(1, "modify", "a1", "b1", "A-1", "B-1", ["x"]), (1, "add", None, "b2", None, "C-3", []), (1, "remove", "a3", None, "D-4", None, [])],
        "pair_id long, kind string, id_a string, id_b string, zone_a string, zone_b string, field_changes array<string>",
    )
    emitted = spark.createDataFrame(
        [(1, "modify", "a1", "b1", 0, ["old"], True), (1, "modify", "a1", "b1", 1, ["older"], False), (1, "add", None, "b2", 2, ["kept"], True), (1, "move", "a9", "b9", 3, [], True)],
        "pair_id long, kind string, id_a string, id_b string, ord int, field_changes array<string>, is_cascade boolean",
    )
    got = {r["kind"]: (r["zone_b"], r["field_changes"], r["is_cascade"]) for r in evaluation.net_changes(emitted, reference).collect()}
    assert got == {"modify": ("B-1", ["x"], False), "add": ("C-3", ["kept"], True), "remove": (None, [], None)}


def test_canary_and_residue_precision(spark):
    a = spark.createDataFrame([(1, "a1", "x"), (1, "a2", "same"), (2, "a1", "q")], "pair_id long, id string, text string")
    b = spark.createDataFrame([(1, "b1", "y"), (1, "b2", "same"), (2, "b1", "q")], "pair_id long, id string, text string")
    truth = spark.createDataFrame([(1, 1, "a1", "b1", False), (1, 2, "a2", "b2", False), (1, 3, "a1", None, True), (2, 1, "a1", "b1", True)], "pair_id long, did long, id_a string, id_b string, semantic_null boolean")
    got = {r["pair_id"]: (r["n_real"], r["n_hit"], r["recall"]) for r in evaluation.canary_recall(a, b, truth).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 1.0)}
    visual = spark.createDataFrame([(1, "A-1", "A-1"), (1, "C-1", None), (2, "A-1", "A-1")], "pair_id long, zone_a string, zone_b string")
    labels = spark.createDataFrame([(1, "Z-9", "A-1", False), (1, "C-1", None, True), (3, None, None, False)], "pair_id long, zone_a string, zone_b string, semantic_null boolean")
    assert tuple(evaluation.residue_precision(visual, labels).first()) == (3, 1, 0.3333)
    none = evaluation.residue_precision(visual.where("false"), labels).select(F.struct("*")).first()[0]
    assert (none["n_visual"], none["precision"]) == (0, None)


def test_trace_lines(spark):
    from deltaweave.operators import trace

    made = [("a", "ask", 1.0, 1.25, "ok", {"model": "m", "tokens_in": "5"}, None, None), ("b", "read", 1.0, None, "error", {"path": "x", "n": "2"}, "ValueError", "no"), ("c", "run", 2.0, 2.0, "ok", {}, None, None)]
    df = spark.createDataFrame(made, "span_id string, name string, start_ts double, end_ts double, status string, attrs map<string,string>, error_type string, error_message string")
    got = {r["span_id"]: (r["is_model"], r["text"]) for r in trace.lines(df).collect()}
    assert got["a"] == (True, "ask [250.0ms] OK\n  model=m tokens_in=5 tokens_out=None cost_usd=None")
    assert got["b"][1].splitlines()[:2] == ["read [?] ERROR", "  ! ValueError: no"] and set(got["b"][1].splitlines()[2].strip().split(", ")) == {"path=x", "n=2"}
    assert got["c"] == (False, "run [0.0ms] OK")


def test_annotation_looks(spark):
    from deltaweave.operators import rendering

    made = [(1, "a", "add", "note", False, "new note"), (1, "b", "move", "note", False, ""), (1, "c", "modify", "note", True, None), (1, "d", "unclassified_visual_change", "geometry", False, None)]
    df = spark.createDataFrame(made, "pair_id long, did string, kind string, element_type string, is_cascade boolean, description string")
    got = {r["did"]: (r["opacity"], r["width"], r["title"], r["info"]) for r in rendering.annotation_looks(df, "x").collect()}
    assert got == {"a": (0.25, 2.5, "x: add", "new note"), "b": (0.9, 2.5, "x: move", "move (note)"), "c": (0.9, 1.0, "x: modify", "modify (note)"), "d": (0.9, 2.5, "x: unclassified_visual_change", "unclassified visual change")}


def test_similar_texts_against_all_pairs(spark):
    """Every floor, lengths that differ, empty and null texts, repeated characters, and groups that never mix."""
    from deltaweave.operators.similar import similar_texts

    rng = random.Random(3)
    text = lambda: "".join(rng.choices("aab c1é", k=rng.choice([0, 1, 2, 5, 9, 14])))
    sides = [[(i % 2, text()) for i in range(70)] + [(0, None), (1, "Pump 26"), (1, "Pump  26 A")] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "g int, text string") for s in sides)
    for floor in (1.0, 40.0, 60.0, 80.0, 100.0):
        found = similar_texts(a, b, ["g"], floor).collect()
        got = {(r["g"], r["text_a"], r["text_b"]): r["score"] for r in found}
        want = {(g, x or "", y or ""): 100 * similarity(x or "", y or "") for g, x in sides[0] for h, y in sides[1] if g == h}
        assert len(got) == len(found) and got == {k: v for k, v in want.items() if v >= floor}


def test_bands_of_a_page_with_many_words(spark):
    """A page streams through its task."""
    from deltaweave.operators import runs

    n = 300_000
    words = spark.range(n).select(
        F.lit(1).cast("long").alias("pair_id"), F.lit("A").alias("side"), F.lit(1).alias("sheet"), F.col("id").cast("int").alias("ord"), F.lit("w").alias("text"), F.lit(90.0).alias("conf"),
        (F.col("id") % 10 * 20.0).alias("left"), (F.floor(F.col("id") / 10) * 10.0 + F.col("id") % 3).alias("top"), F.lit(15.0).alias("width"), F.lit(8.0).alias("height"),
    )
    sizes = runs.word_bands(words).groupBy("band").count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    assert tuple(sizes) == (n // 10, 10, 10)
