"""Operators 11, 12 and 13 against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.llm import negatives, runindex, variants

from .cases import documents, texts

# --- 11: negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, v int, num int, place int, score bigint"


def vector_rows():
    r = random.Random(2)
    centres = [[r.gauss(0, 0.4) for _ in range(12)] for _ in range(4)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in centres[i % 4]], r.choice([i % 4, i % 4, 7])) for i in range(260)]
    rows += [(300, None, 1), (350, [None] * 12, 1), (400, [math.nan] + [0.1] * 11, 1), (450, [math.inf] * 12, 1), (500, [0.5] * 12, None), (None, [0.5] * 12, 1)]
    rows += [(550, [0.0] * 12, 1), (600, [], 2), (650, [0.5, 0.25], 2), (700, [1.0] * 14, 3)]  # shorter and longer
    rows += [rows[3], rows[3], rows[50], (51, rows[3][1], 3), (52, rows[3][1], 1)]  # repeated rows, equal vectors, one id with other vectors
    rows += [(i, [0.5] * 12, 5) for i in range(800, 860)]  # ties
    return rows


def slow_negatives(rows, every):
    width = max((len(v) for _, v, _ in rows if v), default=0)
    fine = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v) + (0,) * (width - len(v))) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for i, lab, a in fine:
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, b, strict=True)), j, other) for j, other, b in fine if j != i)
        for p, j, _ in [s for s in scored if s[2] == lab][:5]:
            inside = [s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out.update((i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside[:3]))
    return out


def mined(spark, rows, every=10, **settings):
    made = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(3)
    found = negatives.hard_negatives(made, F.col("vec_id") % every == 0, **settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("block_values", [1 << 21, 60])
def test_negatives_equal_brute_force(spark, monkeypatch, block_values):
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = vector_rows()
    want = slow_negatives(rows, 10)
    assert len(want) > 100 and mined(spark, rows, block_values=block_values) == want


def test_negatives_of_nothing(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [0.5], 1), (2, [0.5], 2)])  # no anchor
    assert not mined(spark, [(0, None, 1), (10, [], 1)])
    assert not mined(spark, [(0, [0.5], 1), (1, [-0.5], 1), (2, [-0.4], 2)])  # a positive below zero


def test_large_components_stay_whole():
    a, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**22, 5.0]])
    assert negatives._exact(a, x)[0] == 2**62 + 15
    assert negatives._exact(a * 2, x * 2)[0] == negatives.LARGEST


def test_survivors_lose_nothing():
    """Whatever the rotation, bounds hold: all pairs inside the limits are found, others are not."""
    g = np.random.default_rng(4)
    for width in (1, 3, 16, 64):
        a, x = np.floor(g.normal(0, 60, (40, width))), np.floor(g.normal(0, 60, (300, width)) * g.uniform(0, 2, (300, 1)))
        q = np.linalg.qr(g.normal(size=(width, width)))[0]
        slack = np.linalg.norm(q.T @ q - np.eye(width)) + 8 * width**2 * np.finfo(float).eps
        cuts = sorted({max(1, round(width * s)) for s in negatives.STAGES})
        exact = (a @ x.T).astype(int)
        low = np.sort(exact, axis=1)[:, -4].astype(float)
        high = np.sort(exact, axis=1)[:, -2].astype(float)
        allowed = g.random(exact.shape) < 0.9
        i, j, s = negatives.survivors(negatives.Turned(a, q, cuts), negatives.Turned(x, q, cuts), allowed, low, high, cuts, slack)
        want = np.nonzero(allowed & (exact >= low[:, None]) & (exact <= high[:, None]))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(*(w.tolist() for w in want), strict=True)) and (s == exact[i, j]).all()


# --- 12: run-length index


def slow_repeats(pieces, window):
    seen, out = set(), []
    for p, b in enumerate(pieces):
        for i in range(len(b) - window + 1):
            out += [(p, i)] if b[i : i + window] in seen else []
            seen.add(b[i : i + window])
    return out


def test_index_marks_later_windows():
    r = random.Random(3)
    for _ in range(300):
        window = r.choice([3, 5, 9, 20])
        base = bytes(r.choice(b"ab\x00") for _ in range(r.randrange(1, 80)))
        pieces = []
        for _ in range(r.randrange(1, 12)):
            i = r.randrange(len(base))
            pieces.append(bytes(r.choice(b"ab") for _ in range(r.randrange(1, 40))) if r.random() < 0.3 else base[i : i + r.randrange(1, 60)])
        piece, at = runindex.repeats(pieces, window)
        assert list(zip(piece.tolist(), at.tolist(), strict=True)) == slow_repeats(pieces, window)


def test_runs_shrink_with_repeats():
    r = random.Random(1)
    piece = bytes(r.choice(b"abcdefgh") for _ in range(150))

    def runs(pieces):
        n = sum(len(p) + 1 for p in pieces)
        text, rest = np.zeros(n, np.int16), np.zeros(n, np.int64)
        at = 0
        for p in pieces:
            text[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
            rest[at : at + len(p) + 1] = np.arange(len(p), -1, -1)
            at += len(p) + 1
        packed = np.zeros(n, np.int64)
        for i in range(runindex.PACKED):
            packed = (packed << 9) | np.where(rest > i, np.append(text, np.zeros(7, np.int16))[i : i + n], 0)
        order = runindex.suffixes(packed, rest)
        assert order.tolist() == sorted(range(n), key=lambda i: (text[i : i + rest[i]].tolist(), i))
        link, shared, count = runindex.matches(text, rest, order)
        for a, b in zip(order, order[1:], strict=False):
            x, y = text[a : a + rest[a]], text[b : b + rest[b]]
            least = min(len(x), len(y))
            assert link[b] == a and shared[b] == next((i for i in range(least) if x[i] != y[i]), least)
        return count

    same = runs([piece] * 20)
    assert same < 150 + 30 and runs([bytes(r.choice(b"abcdefgh") for _ in range(150)) for _ in range(20)]) > 8 * same


def slow_cut(rows, window):
    """Multiset of (doc_id, kept, n_bytes, n_removed, n_spans)."""
    order = sorted({(i is not None, i or 0, t) for i, t in rows}, key=lambda d: d[:2])
    ids = [d[:2] for d in order]
    assert len(set(ids)) == len(ids), "the order of texts of one id is left to their hashes"
    seen, found = set(), {}
    for known, i, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\x01" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        found[known, i, text] = (kept, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))))
    return Counter((i, *found[i is not None, i or 0, t]) for i, t in rows)


def cut(spark, rows, **settings):
    made = runindex.remove_repeated_bytes(documents(spark, [(i, t, "s") for i, t in rows]).repartition(3), **settings)
    assert made.columns == ["doc_id", "kept", "n_bytes", "n_removed", "spans"]
    return Counter((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], len(r["spans"])) for r in made.collect())


@pytest.mark.parametrize("settings", [{}, {"most": 2}, {"window": 40, "core": 12}, {"window": 41, "core": 13, "most": 3}])
def test_cut_equals_brute_force(spark, monkeypatch, settings):
    monkeypatch.setattr(runindex, "INDEX_BYTES", 5000)
    monkeypatch.setattr(runindex, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(runindex, "SLAB", 700)
    rows = [(i, t) for i, t, _ in texts()]
    once = {i: t for i, t in rows if i != 115}  # rows of one id with other texts have a test of their own
    rows = [(i, t) for i, t in rows if i != 115 and once[i] == t]
    r = random.Random(8)
    lines = ["".join(r.choice("abcdeé文 ") for _ in range(r.randrange(90, 260))) for _ in range(4)]
    rows += [(200 + i, "".join(r.choice([lines[r.randrange(4)], f"only {r.random()} here ", "yy " * 60]) for _ in range(r.randrange(1, 7)))) for i in range(60)]
    assert cut(spark, rows, **settings) == slow_cut(rows, settings.get("window", 100))


def test_common_passage_with_other_ends(spark, monkeypatch):
    """A passage in all documents makes hot cores whose pieces differ; splitting them loses no window."""
    monkeypatch.setattr(runindex, "BLOCK_BYTES", 2000)
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghij ") for _ in range(300))
    rows = [(i, f"{r.random()}"[:12] + passage + f"{i % 17:04}" + passage[:150] + f"{r.random()}") for i in range(120)]
    assert cut(spark, rows, most=4) == slow_cut(rows, 100)


def test_texts_of_one_id(spark):
    line = "".join(random.Random(4).choices("abcdefghijkl", k=160))
    found = sorted(cut(spark, [(1, line + "a"), (1, line + "b"), (1, line + "b")]).elements())
    assert len(found) == 3 and sorted(f[3] for f in found) in ([0, 160, 160], [0, 0, 160])  # equal rows alike, one of the two texts first
    assert found[0][1:] == found[1][1:] or found[1][1:] == found[2][1:]


def test_cut_of_nothing(spark):
    assert not cut(spark, [])
    assert cut(spark, [(None, None), (1, "")]) == Counter({(None, b"", 0, 0, 0): 1, (1, b"", 0, 0, 0): 1})


# --- 13: variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(counts, factor=5):
    best = {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        form = min(around, key=lambda x: (-counts[x], x), default=None)
        best[w] = (form if form is not None and counts[form] >= factor * n else None, len(around))
    out = Counter()
    for w, (form, k) in best.items():
        root = w
        while best[root][0] is not None:
            root = best[root][0]
        out[w, form, root, counts[w], k, counts[form] if form is not None else None] += 1
    return out


def slow_counts(rows):
    out = Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def grouped(spark, counts, **settings):
    made = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n bigint, near int").repartition(3)
    found = variants.variants(made.drop("near"), **settings)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize(("group", "cells"), [(1 << 20, 1 << 21), (40, 200)])
def test_variants_equal_brute_force(spark, monkeypatch, group, cells):
    monkeypatch.setattr(variants, "CELLS", cells)
    r = random.Random(group)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(6, 10))) for _ in range(250)} | {"aaaaaa", "aaaaaaa", "y" * 300, "y" * 301, "ÿ" * 6, "a×÷bcd"}
    words |= {"prefix" + "".join(r.choice("xy") for _ in range(r.randrange(0, 8))) for _ in range(80)}  # one head for many
    counts = {w: 5 * 5 ** r.randrange(6) + r.randrange(3) for w in words}
    assert grouped(spark, counts, group=group) == slow_variants(counts)


def test_active_nodes_equal_brute_force():
    r = random.Random(1)
    for _ in range(200):
        words = sorted({(r.randrange(2), bytes(r.choice(b"abc") for _ in range(r.randrange(6)))) for _ in range(r.randrange(1, 60))})
        codes = np.zeros((len(words), max(1, *(len(w) for _, w in words)) if len(words) > 1 else max(1, len(words[0][1]))), np.uint8)
        for i, (_, w) in enumerate(words):
            codes[i, : len(w)] = list(w)
        x, y = variants.near_rows(np.array([g for g, _ in words]), codes, np.array([len(w) for _, w in words]))
        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if words[i][0] == words[j][0] and near(words[i][1], words[j][1])]
        assert sorted(tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)) == want


def test_words_of_documents(spark):
    r = random.Random(6)
    vocabulary = ["Apfelbaum", "APFELBAUM", "apfelbäum", "Éclairs", "éclairs", "kurz", "sixsix", "sevens7sevens", "naïveté×x"]
    rows = [(i if i % 40 else None, " ".join(r.choice(vocabulary) for _ in range(50)) + "\n12,Apfelbaumen") for i in range(400)] + [(7, None), (8, "")]
    counts = slow_counts(rows)
    assert any(len(w) == 8 and w in "apfelbaum" or w == "pfelbaum" for w in slow_counts(rows * 3))  # some lost a code point
    found = variants.counted(documents(spark, [(i, t, "s") for i, t in rows]))
    assert {r["word"]: r["n"] for r in found.collect()} == counts
    assert grouped(spark, counts) == slow_variants(counts)


def test_variants_of_nothing(spark):
    assert not grouped(spark, {})
    assert not variants.counted(documents(spark, [(1, "nur kurz da", "s"), (2, None, "s")])).collect()


def test_queries(spark):
    """The registered queries at the smallest size against brute force."""
    from deltaweave.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op13_variants"](spark, path).collect())) == slow_variants(slow_counts(rows))
    want = Counter((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for (i, kept, n, gone, spans), k in slow_cut(rows, 100).items() for _ in range(k))
    assert Counter(map(tuple, QUERIES["op12_runindex"](spark, path).collect())) == want
