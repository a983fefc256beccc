"""Findings of round 3: repeated keys, questions to all their pairs, shards in the order of the mix."""

from __future__ import annotations

import json
from collections import Counter

import duckdb

import corpus_pipeline
from deltaweave import queries
from deltaweave.llm import sharding
from deltaweave.operators import rendering

DATA = "/root/testdata/sf0.001"


def test_names_of_repeated_keys(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{DATA}/part.parquet' UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey, p_name || ' new' AS p_name) FROM '{DATA}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.sql(queries.DESCRIBED).fetchall()
    got = [tuple(r) for r in queries.delta_descriptions(spark, str(tmp_path)).select("k", "description").collect()]
    assert len({k for k, _ in got}) < len(got) and sorted(got) == sorted(want)


def test_reports_of_repeated_keys(spark, tmp_path):
    """Reports agree with their SQL in all that it fixes: it leaves the order of the changes of one key open, code does not."""
    part = DATA.replace("sf0.001", "sf0.01") + "/part.parquet"
    duckdb.sql(f"COPY (SELECT * FROM '{part}' UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM '{part}') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    # The changes of a report in its order, and the key of one.
    forms = {
        "markdown_report": (lambda r: r.removeprefix("# Changes\n\n").removesuffix("\n").split("\n"), lambda x: int(x.rpartition(" k")[2])),
        "json_report": (lambda r: [json.dumps(x) for x in json.loads(r)["deltas"]], lambda x: json.loads(x)["k"]),
        "html_report": (lambda r: [json.dumps(x) for x in json.loads(r.removeprefix(rendering.HTML_HEAD).removesuffix(rendering.HTML_TAIL))], lambda x: json.loads(x)["k"]),
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name, (changes, key) in forms.items():
        want = dict(con.sql(queries.ORACLES[name]).fetchall())
        got = dict(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).select("pair_id", "report").collect()))
        try:
            spark.conf.set("spark.sql.shuffle.partitions", "3")
            again = dict(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).select("pair_id", "report").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == again and got.keys() == want.keys()
        n_open = 0
        for pair, report in want.items():
            mine, other = changes(got[pair]), changes(report)
            assert Counter(mine) == Counter(other) and [key(x) for x in mine] == [key(x) for x in other] == sorted(map(key, mine))
            free = len(set(map(key, set(mine)))) < len(set(mine))
            assert free or got[pair] == report
            n_open += free
        assert n_open


def test_questions_meet_all_pairs_of_their_class(spark):
    pairs = {r["pair_id"] for r in queries.precheck(spark, DATA).collect()}
    asked = {r["pair_id"] for r in queries.chat_runs(spark, DATA).collect()}
    items = {r["item_id"] % 4 for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id").collect()}
    assert asked == {p for p in pairs if p % 4 in items}


def test_shards_follow_the_order_of_the_stage_before(spark, tmp_path):
    rows = [(i * 7919 % 1000, f"text {i}", "en", "s", 6) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = corpus_pipeline.assign_shards(spark, docs, "").collect()
    plain = {(r["doc_id"], r["shard"]) for r in sharding.shard_documents(docs, corpus_pipeline.SHARDS).collect()}
    assert {(r["doc_id"], r["shard"]) for r in found} == plain
    for s in range(corpus_pipeline.SHARDS):
        mine = sorted((r["slot"], r["doc_id"]) for r in found if r["shard"] == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)
