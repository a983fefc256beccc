"""Calls of models, verdicts that outlive a run, and traces of real queries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from deltaweave.operators import models, trace


def test_who_answers_and_judges():
    plain = models.backends({"LLM_AUTH_TOKEN": "t", "LLM_API_KEY": "k", "LLM_BASE_URL": ""}, "m")
    assert plain.self_judging and plain.judges == plain.answers and plain.answers.credentials() == {"auth_token": "t"} and plain.answers.model == "m"
    other = models.backends({"LLM_API_KEY": "k", "LLM_MODEL": "x", "LLM_BASE_URL": "u", "JUDGE_LLM_AUTH_TOKEN": "j"}, "m")
    assert not other.self_judging and other.answers.credentials() == {"api_key": "k", "base_url": "u"}
    assert other.judges.credentials() == {"auth_token": "j", "base_url": "u"} and other.judges.model == "x"
    named = models.backends({"LLM_API_KEY": "k", "JUDGE_MODEL": "y", "JUDGE_LLM_API_KEY": ""}, "m")
    assert not named.self_judging and (named.answers.model, named.judges.model) == ("m", "y")
    with pytest.raises(RuntimeError, match="credentials"):
        models.backends({}, "m").answers.credentials()


class Counting:
    """A client that notes its calls in a file, since executors are other processes."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, system, prompt, temperature):
        with open(self.path, "a") as f:
            f.write(json.dumps([system, prompt, temperature]) + "\n")
        if "picky" in prompt and temperature is not None or "broken" in prompt:
            raise ValueError(f"refused {temperature}")
        return prompt.upper()

    def calls(self):
        with open(self.path) as f:
            return sorted((json.loads(line) for line in f), key=repr)


def test_calls_are_tried_once_more_without_temperature(spark, tmp_path):
    client = Counting(tmp_path / "calls")
    rows = [(1, "s", "hello"), (2, "s", "picky"), (3, "s", "broken"), (4, "s", "hello"), (5, None, None)]
    found = models.asked(spark.createDataFrame(rows, "k int, system string, prompt string").coalesce(1), client).orderBy("k").collect()
    assert [(r["k"], r["reply"], r["attempts"], r["error"]) for r in found] == [(1, "HELLO", 1, None), (2, "PICKY", 2, None), (3, None, 2, "ValueError: refused None"), (4, "HELLO", 1, None), (5, "", 1, None)]
    assert client.calls() == sorted([["s", "hello", 0.0], ["s", "picky", 0.0], ["s", "picky", None], ["s", "broken", 0.0], ["s", "broken", None], ["", "", 0.0]], key=repr)
    again = models.asked(spark.createDataFrame([(1, "s", "broken")], "k int, system string, prompt string"), client, temperature=None).first()
    assert again["attempts"] == 1 and again["error"] == "ValueError: refused None"


def test_verdicts_outlive_a_run(spark, tmp_path):
    path, calls = str(tmp_path / "verdicts"), tmp_path / "calls"
    calls.touch()

    def judge(a, b, where=str(calls)):
        with open(where, "a") as f:
            f.write(json.dumps([a, b]) + "\n")
        return None if a is None else a.lower() == (b or "").lower()

    made = lambda rows: spark.createDataFrame(rows, "k int, old_content string, new_content string")
    said = lambda df: sorted((r["k"], r["judged"]) for r in df.collect())
    first = [(1, "a", "A"), (2, "a", "b"), (3, "a", "A"), (4, None, "x")]
    assert said(models.judged(made(first), judge, path)) == [(1, True), (2, False), (3, True), (4, None)]
    assert sorted(calls.read_text().splitlines()) == sorted(json.dumps(x) for x in (["a", "A"], ["a", "b"], [None, "x"]))
    assert said(models.judged(made([*first, (5, "c", "C"), (6, "c", None)]), judge, path)) == [(1, True), (2, False), (3, True), (4, None), (5, True), (6, False)]
    assert len(calls.read_text().splitlines()) == 5  # two more, the others were known
    assert said(models.judged(made([]), judge, path)) == [] and len(calls.read_text().splitlines()) == 5


def test_agreement(spark):
    rows = [("x", True, True), ("x", True, False), ("x", None, None), ("x", False, None), ("y", False, False)]
    got = {r["g"]: tuple(r)[1:] for r in models.agreement(spark.createDataFrame(rows, "g string, hand boolean, judged boolean"), ["g"]).collect()}
    assert got == {"x": (4, 2, 0.5), "y": (1, 1, 1.0)}


def test_spans_of_real_queries(spark, tmp_path):
    tracer = trace.Tracer()
    spark.range(3).count()  # ended before
    with tracer.span("request", pair=7), trace.QuerySpans(spark, tracer):
        assert spark.range(10).groupBy((F.col("id") % 2).alias("m")).count().collect()
        with pytest.raises(Exception, match="(?i)divi"):
            spark.sql("SELECT assert_true(id < 2, 'no division') FROM range(5)").collect()
    with tracer.span("later"), trace.QuerySpans(spark, trace.Tracer()) as other:
        spark.range(4).count()  # after
    assert len(other.tracer.rows) == 1 and other.tracer.rows[0]["parent_id"] is None
    tracer.rows.pop()
    rows = [r.asDict() for r in tracer.table(spark).collect()]
    queries = [r for r in rows if r["name"].startswith("query:")]
    (root,) = (r for r in rows if r["name"] == "request")
    assert [q["status"] for q in queries].count("error") == 1 < len(queries) and all(q["parent_id"] == root["span_id"] and int(q["attrs"]["nodes"]) > 0 for q in queries)
    (failed,) = (q for q in queries if q["status"] == "error")
    assert "no division" in failed["error_message"]
    found = json.loads(trace.tree_json(tracer.table(spark)).first()["tree"])
    assert found["correlation_id"] == tracer.correlation_id and [s["name"] for s in found["spans"]] == ["request"]
    assert len(found["spans"][0]["children"]) == len(queries) and found["spans"][0]["attrs"] == {"pair": "7"}
    for n in (1, 2):
        trace.append_events(tracer.table(spark), str(tmp_path / "events"))
        lines = spark.read.json(str(tmp_path / "events"))
        assert lines.count() == (1 + len(queries)) * n and lines.where("duration_ms IS NULL").count() == 0


def test_trees_as_json(spark):
    rows = [("r", "a", None, "top", 1.0, 3.0), ("r", "b", "a", "second", 2.5, None), ("r", "c", "a", "first", 1.5, 2.0), ("r", "d", "c", "deep", 1.6, 1.7), ("r", "x", "y", "loop", 1.0, 1.0), ("r", "y", "x", "loop", 1.0, 1.0), ("q", "a", None, "other", 0.0, 0.5)]
    rows += [("deep", str(i), str(i - 1) if i else None, "n", float(i), float(i)) for i in range(120)]
    spans = spark.createDataFrame([(*r, "ok", {}, None, None) for r in rows], trace.SPANS)
    found = {r["correlation_id"]: json.loads(r["tree"])["spans"] for r in trace.tree_json(spans).collect()}
    names = lambda s: (s["name"], [names(c) for c in s["children"]])
    assert [names(s) for s in found["r"]] == [("top", [("first", [("deep", [])]), ("second", [])])] and [names(s) for s in found["q"]] == [("other", [])]
    assert found["r"][0]["duration_ms"] == 2000 and found["r"][0]["children"][1]["duration_ms"] is None
    depth, at = 0, found["deep"]
    while at:
        depth, at = depth + 1, at[0]["children"]
    assert depth == 120
    assert trace.tree(spans.where("correlation_id = 'deep'")).agg(F.max("level")).first()[0] == 119  # beyond Spark's own limit of levels
