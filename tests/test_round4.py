"""Findings of round 4: work that grows with classes of sets, not with their pairs."""

from __future__ import annotations

import random

import duckdb

from deltaweave import queries
from deltaweave.operators import identity
from deltaweave.sources import adapters
from deltaweave.sources.documents import SPANS, files, opened

from .test_round3_size import documents


def total(spark, what: str) -> int:
    """Sum of a figure over the stages so far."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def shuffled_rows(spark, df) -> int:
    """Rows that running df writes to shuffles."""
    before = total(spark, "shuffleWriteRecords")
    df.write.format("noop").mode("overwrite").save()
    return total(spark, "shuffleWriteRecords") - before


def test_similar_sets_by_blocks_of_classes(spark, monkeypatch):
    """Copies, sets with the same shared items, and classes of many blocks, against all pairs."""
    monkeypatch.setattr(identity, "BLOCK", 3)
    r = random.Random(14)
    sets = {}
    for _ in range(40):  # shared items, and for some one of their own
        s = frozenset(r.sample("abcdef", r.randrange(0, 3)))
        for _ in range(r.randrange(1, 9)):
            own = {f"own{len(sets)}"} if r.random() < 0.5 or not s else set()
            sets[len(sets)] = s | own
            if r.random() < 0.3:
                sets[len(sets)] = s | own
    sets |= {1000 + i: frozenset({"only", "these"}) for i in range(20)}
    rows = [(i, x) for i, s in sets.items() for x in s]
    df = spark.createDataFrame([*rows, (None, "a"), (None, "b")], "id long, item string")
    for least in (0.3, 0.5, 1.0):
        want = {(a, b, len(s & t), len(s & t) / len(s | t)) for a, s in sets.items() for b, t in sets.items() if a < b and len(s & t) / len(s | t) >= least}
        got = [tuple(x) for x in identity.similar_sets(df, "id", "item", least).select("a", "b", "shared", "jaccard").collect()]
        assert set(got) == want and len(got) == len(want)


def test_revision_pairs_of_furniture_are_not_shuffled(spark, tmp_path):
    """A line that all have and one of their own: every two are a pair, and no pair goes through a shuffle."""
    n = 1500
    texts = [f"one line of furniture that stands in all of them\nand line {i} which stands in this one alone" for i in range(n)]
    found = queries.revision_pairs(spark, documents(spark, tmp_path, texts))
    assert found.count() == n * (n - 1) // 2
    assert {tuple(x) for x in found.select("shared", "jaccard").distinct().collect()} == {(1, 0.333333)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as they are at size
    try:
        assert shuffled_rows(spark, queries.revision_pairs(spark, str(tmp_path))) < 40 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_adapter_spans_list_no_folders(spark, tmp_path):
    """Tasks do not grow with files: nobody lists a folder of each pair."""
    part = "/root/testdata/sf0.01/part.parquet"
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + i * 100000 AS p_partkey) FROM '{part}', (SELECT unnest(range(0, 4)) AS i) q) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.sql(queries.ORACLES["adapter_spans"]).fetchall()
    before = total(spark, "numCompleteTasks")
    found = queries.adapter_spans(spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    assert total(spark, "numCompleteTasks") - before < 40 < len({r[1] for r in want})
    assert sorted(got) == sorted(want)


def test_span_files(spark, tmp_path):
    """One file a pair and side, whatever their letters; a second run replaces the first; large files come in many frames."""
    made = lambda rows: spark.createDataFrame([(p, s, 1, i, t, 1.0, 2.0, 3.0, 4.0, 0.5, 3.5, 9.0) for p, s, i, t in rows], SPANS)
    path = str(tmp_path / "spans")
    adapters.write_spans(made([(5, "A", 0, "gone")]), path)
    rows = [(1, "A", i, f"x\né{i}") for i in range(20000)] + [(2, "B", 0, "b"), (2, "A", 0, "a"), (3, "a/b c%", 7, "odd"), (None, "A", 0, "none")]
    written = adapters.write_spans(made(rows), path)
    assert written.count() == 5 == sum(f.is_file() for f in (tmp_path / "spans").rglob("*"))
    back = adapters.read_spans(opened(written), pair=r"pair_id=(\d+)", side=r"/side=([ab])/").select("pair_id", "side", "ord", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted([(p, s if len(s) == 1 else "", 0 if s == "a/b c%" else i, t) for p, s, i, t in rows], key=str)
    again = adapters.read_spans(files(spark, path), pair=r"pair_id=(\d+)", side=r"/side=([ab])/").select("pair_id", "side", "ord", "text").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, back), key=str)
