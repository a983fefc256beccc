"""Operators 8 and 9: brute force on odd cases, no Python in their plans, and the SQL that must agree."""

from __future__ import annotations

import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from deltaweave.llm import decontamination, mixing

from .cases import PASSAGE, documents, texts

ITEMS = "item_id bigint, text string, doc_id int, n_item int, hash int"


def item_rows():
    w = PASSAGE.split()
    return [
        (1, " ".join(w[5:45]), 0, 0, 0), (2, " ".join(w[5:45]).upper() + "!", 0, 0, 0), (3, "never seen words stand in here at all", 0, 0, 0), (4, None, 0, 0, 0), (5, "", 0, 0, 0),
        (6, "too few words", 0, 0, 0), (7, " ".join(w[20:50] + ["z"] * 2), 0, 0, 0), (8, " ".join(w[20:30] + ["q", "r", "s"] + w[40:50]), 0, 0, 0), (1, " ".join(w[5:45]), 0, 0, 0),
        (9, "é é İ ı ß ẞ", 0, 0, 0), (None, " ".join(w[5:45]), 0, 0, 0),
    ]


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment(spark):
    docs, items = texts(), item_rows()
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontamination.contained_items(documents(spark), spark.createDataFrame(items, ITEMS)).collect()}
    want = set()
    for i, t, _ in docs:
        for k, x, *_ in items:
            s = shingles(x)
            both = len(s & shingles(t))
            if s and i is not None and k is not None and both >= math.ceil(0.8 * len(s)):
                want.add((i, k, len(s), both))
    assert got == want and {105, 106, 107} <= {g[0] for g in got}


def test_document_sketches_by_size_class(spark):
    hashed = spark.createDataFrame([(1, -5), (1, 3), (2, 9), (2, 20), (3, None)], "doc_id bigint, hash bigint")
    bounds = spark.createDataFrame([(2, 10), (5, 3)], "size_class int, bound bigint")
    got = Counter(tuple(r) for r in decontamination.document_sketches(hashed, bounds).collect())
    assert got == Counter([(1, 2, -5), (1, 5, -5), (1, 2, 3), (1, 5, 3), (2, 2, 9)])


@pytest.mark.parametrize(("docs", "items"), [([], item_rows()), (texts(), []), ([], [])])
def test_containment_empty(spark, docs, items):
    assert decontamination.contained_items(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect() == []


def test_contaminated_documents_go(spark):
    kept = Counter(r["doc_id"] for r in decontamination.drop_contaminated(documents(spark), spark.createDataFrame(item_rows(), ITEMS)).collect())
    want = Counter(i for i, _, _ in texts())
    for i in (105, 106, 107, 117):  # 117 holds the item of six words
        del want[i]
    assert kept == want
    rows = [(None, PASSAGE, "s"), (None, "clean", "s"), (1, PASSAGE, "s"), (1, "another text", "s"), (1, "another text", "s")]
    kept = Counter(r["text"] for r in decontamination.drop_contaminated(documents(spark, rows), spark.createDataFrame(item_rows(), ITEMS)).collect())
    assert kept == {"clean": 1, "another text": 2}


def plans(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_plans(spark):
    docs = documents(spark)
    for df in (decontamination.contained_items(docs, spark.createDataFrame(item_rows(), ITEMS)), mixing.schedule(docs)):
        assert not re.search("Python|Pandas|Arrow(?!Eval)", plans(df).replace("ArrowToRow", ""))


@pytest.mark.parametrize("weights", [None, {"s0": 0.7, "s1": 0.2, "s2": 0.1}])
def test_schedule_keeps_within_one_block(spark, weights):
    docs = documents(spark)
    rows = [r.asDict() for r in mixing.schedule(docs, weights, block_bytes=64, cycle=20).collect()]
    assert Counter((r["doc_id"], r["source"], r["bytes"]) for r in rows) == Counter((i, s or "", len((t or "").encode()) + 1) for i, t, s in texts())
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    by: dict[int, set[str]] = {}
    for r in rows:
        by.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(v) == 1 for v in by.values())  # one block in each slot


def test_cycle_deviates_less_than_one_block(spark):
    shared = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1), ("d", 7), ("e", 3)], "source string, share bigint")
    got = sorted((r["slot"], r["source"], r["turn"]) for r in mixing.cycle_pattern(shared).collect())
    d = 22
    assert [s for s, _, _ in got] == list(range(d))
    for name, a in (("a", 10), ("b", 1), ("c", 1), ("d", 7), ("e", 3)):
        served = 0
        for t, (_, source, _) in enumerate(got, 1):
            served += source == name
            assert abs(served - a * t / d) < 1


@pytest.mark.parametrize("shares", [{f"s{i:04}": 1 + i % 3 for i in range(700)}, {f"s{i:04}": 2 for i in range(500)}, {f"s{i}": 1 + 7 * i for i in range(20)}])
def test_cycle_of_many_sources(spark, shares):
    """Every block runs inside its own source's window, with sources of one share scheduled as one."""
    shared = spark.createDataFrame(list(shares.items()), "source string, share bigint")
    got = mixing.cycle_pattern(shared).collect()
    d = sum(shares.values())
    assert sorted(r["slot"] for r in got) == list(range(d)) and Counter(r["source"] for r in got) == Counter(shares)
    for r in got:
        a = shares[r["source"]]
        assert r["turn"] * d // a <= r["slot"] < -(-(r["turn"] + 1) * d // a)


def test_offsets_do_not_overlap(spark):
    rows = sorted((r["source"], r["offset"], r["bytes"]) for r in mixing.schedule(documents(spark)).collect())
    seen = Counter()
    for source, offset, size in rows:
        if (source, offset) != ("s2", -1):
            seen[source, offset] += 1
    by: dict[str, int] = {}
    for source, offset, size in rows:
        assert offset >= 0
        by[source] = max(by.get(source, 0), offset + size)
    total = Counter()
    for source, _, size in rows:
        total[source] += size
    assert by == dict(total)


def test_mix_keeps_whole_rows(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert set(r["doc_id"] for r in mixed.collect()) <= {i for i, _, _ in texts()}
    assert mixing.schedule(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).collect() == []


def test_mix_keeps_every_row_in_slot_order(spark):
    rows = [(i, "word " * 400, "hot") for i in range(60)] + [(100 + i, "x", f"small{i % 7}") for i in range(14)] + texts()
    docs = documents(spark, rows)
    settings = {"block_bytes": 512, "cycle": 20}
    got = mixing.mix(docs, **settings).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in docs.collect())
    first: dict[int | None, tuple[int, int]] = {}
    placed = mixing.schedule(docs, **settings).collect()
    assert not all(r["in_mix"] for r in placed)  # some lie past the first sources to run out
    for r in placed:
        first[r["doc_id"]] = min(first.get(r["doc_id"], (1 << 62, 0)), (r["slot"], r["offset"]))
    order = [first[r["doc_id"]] for r in got]
    assert order == sorted(order)


def test_many_sources(spark):
    """100,000 domains: the cycle has a slot for each at least, and is scheduled in time that grows with its slots."""
    n = 100_000
    docs = spark.range(n + 400).select(
        F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("s"), F.when(F.col("id") < n, F.col("id")).otherwise(F.col("id") % 4).cast("string")).alias("source"), F.lit(4).alias("n_chars"),
    )
    began = time.time()
    found = mixing.schedule(docs, block_bytes=5).cache()
    assert found.count() == n + 400 and found.select("slot").distinct().count() == n + 400 and time.time() - began < 120
    late = found.where((F.col("slot") < F.col("release")) | (F.col("slot") >= F.col("deadline")))
    assert late.count() == 0
    found.unpersist()


def test_many_shares(spark):
    """5,000 sources with shares from 1 to 40 and a cycle of 102,500 slots."""
    shared = spark.range(5000).select(F.col("id").cast("string").alias("source"), (F.col("id") % 40 + 1).alias("share"))
    began = time.time()
    pattern = mixing.cycle_pattern(shared).cache()
    assert pattern.count() == 102_500 == pattern.select("slot").distinct().count() and time.time() - began < 120
    at = pattern.join(shared, "source")
    early, late = F.floor(F.col("turn") * 102_500 / F.col("share")), F.ceil((F.col("turn") + 1) * 102_500 / F.col("share"))
    assert at.where((F.col("slot") < early) | (F.col("slot") >= late)).count() == 0
    pattern.unpersist()
