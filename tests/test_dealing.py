"""Work that bytes do not tell is dealt to many tasks, and joins of what compresses well are no broadcasts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.config import DEFAULT
from deltaweave.operators import degrade, evaluation, generation, overlay, raster, similar

CHANGES = "pair_id long, ord int, kind string, sheet int, zone string, description string"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_greedy_joins_are_not_broadcast(spark):
    a = spark.createDataFrame([(1, i, "add", 1, "A-1", f"text {i}") for i in range(4)], CHANGES)
    found = evaluation.greedy_match(a, a)
    assert "BroadcastHashJoin" not in physical(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, i, i, True) for i in range(4)]


def test_naive_joins_of_leftovers_are_not_broadcast(spark):
    one = spark.createDataFrame([("abc", 1)], "text string, g int")
    assert "BroadcastHashJoin" not in physical(similar.similar_texts(one, one, ["g"], 60.0))


def test_touching_and_residue_are_not_broadcast(spark):
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x0", 0.1), ("y0", 0.1), ("x1", 0.2), ("y1", 0.2))])
    page = spark.range(3).select(F.col("id").alias("pair_id"), F.lit(1).alias("sheet"), box.alias("box"))
    regions = page.withColumn("region_id", F.col("pair_id")).withColumn("area_px", F.lit(200)).withColumn("magnitude", F.lit(0.5))
    texts = page.withColumn("side", F.lit("A")).withColumn("type", F.lit("text")).withColumn("content", F.lit("x"))
    assert "BroadcastHashJoin" not in physical(raster.residue(regions, page.where("pair_id = 9"), texts))


@pytest.mark.parametrize("text", ["", "aab", "abcabc", "ÄäÄ x  x", "ﬀ𝄞𝄞"])
def test_marks_number_equal_characters(spark, text):
    marks = spark.range(1).select(similar._marks(F.lit(text)).alias("m")).first()["m"]
    chars = [c for c in text if ord(c) < 1 << 16]  # others are counted, not named
    want = {f"{chars[: i + 1].count(c):06d}{c}" for i, c in enumerate(chars)} if text else {""}
    assert want <= set(marks) and len(set(marks)) == len(marks) and marks == sorted(marks, reverse=True)


def test_drawing_is_dealt(spark):
    rows = [(i, "A", 1, 1, 4, 4, 0) for i in range(60)]
    boxes = spark.createDataFrame(rows, "pair_id long, side string, x int, y int, w int, h int, grey int").coalesce(1)
    images = generation.draw_sheets(boxes, 20, 30)
    drawn = spark.createDataFrame([], "pair_id long, sheet int, did string, drawn_on string, box struct<x0: double, y0: double, x1: double, y1: double>, colour string, filled boolean, dashed boolean, width int")
    scans = degrade.degraded_sheets(images.withColumn("level", F.lit(1)).withColumn("seed", F.lit(1)))
    for df in (images, overlay.overlays(images, drawn), scans):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_colour_counts_carry_sheets_without_colours(spark):
    images = generation.draw_sheets(spark.createDataFrame([(1, "A", 0, 0, 0, 0, 0)], "pair_id long, side string, x int, y int, w int, h int, grey int"), 20, 30)
    assert overlay.colour_counts(images).collect() == []
    assert [tuple(r) for r in overlay.colour_counts(images.withColumn("tag", F.lit(7)), ("tag",)).collect()] == [(1, "A", 1, 7, None, 0)]


def test_equal_blocks_are_not_compared(monkeypatch):
    r = np.random.default_rng(4)
    a = r.integers(0, 256, (300, 410)).astype(np.uint8)
    b = a.copy()
    b[100:110, 200:215] = 255 - b[100:110, 200:215]
    b[299, 409] ^= 255
    whole, seen, real = raster.structural_difference(a, b), [], raster.structural_difference
    monkeypatch.setattr(raster, "structural_difference", lambda x, y, s: seen.append(x.size) or real(x, y, s))
    found = raster.changed_difference(a, b, DEFAULT)
    assert np.abs(found - whole).max() < 1e-9 and sum(seen) < a.size / 4


def test_states_are_weighed_in_one_shuffle_of_a_level(spark):
    from deltaweave.llm import suffix_tree

    level = spark.createDataFrame([(1, 10, 30, 40, 0.7375, -3.0), (2, 10, 5, 40, 0.1125, -3.0), (3, 11, 2, 40, 0.0375, -0.1)], "key long, prefix long, c long, n long, share double, below double")
    found = suffix_tree._states(level)
    assert physical(found).count("Exchange hashpartitioning") == 1
    rows = {r["key"]: r for r in found.collect()}
    rest = (40 - 35 + 0.5 * 2) / 40
    own = np.log(0.7375 + rest * np.exp(-3.0))
    assert rows[1]["value"] == pytest.approx((own - np.log(rest) + 3.0) / np.log(10)) and rows[1]["below"] == pytest.approx(own)
    assert tuple(rows[1]["state"]) == (10, 40, pytest.approx(np.log10(rest))) and rows[2]["state"] is None
    assert rows[3]["value"] is None and rows[3]["below"] == -0.1 and rows[3]["state"] is None


def test_sought_terms_travel_packed_and_texts_go_to_all_buckets(spark):
    from deltaweave.llm import suffix_tree
    from deltaweave.llm._store import Scratch

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(40)), False) for i in range(400)], "doc_id long, text string, held_out boolean").coalesce(2)
    tree = suffix_tree.learn(docs, Scratch(spark, "test"))
    top, _, _ = suffix_tree._head(tree, 3, 0, 0)
    with suffix_tree.Shared(spark.sparkContext, top) as shared:
        rows = docs.mapInArrow(suffix_tree._score(shared, 64), suffix_tree.SOUGHT.format(kind="bigint")).collect()
    keys = [r for r in rows if r["keys"] is not None]
    assert len(keys) <= 2 * 128 and sum(len(r["keys"]) // 8 for r in keys) > 400 * 40 and all(len(r["keys"]) == 4 * len(r["texts"]) for r in keys)
    own = [r["bucket"] for r in rows if r["keys"] is None]
    assert len(own) == 400 and max(map(own.count, set(own))) <= 2 * (400 // 128 + 1)
