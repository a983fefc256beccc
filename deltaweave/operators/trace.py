"""Spans of a run: recording on the driver, analysis as a table."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "correlation_id string, span_id string, parent_id string, name string, start_ts double, end_ts double, status string, attrs map<string,string>, error_type string, error_message string"


@dataclass
class Tracer:
    """Nested spans; an error is noted on its span and raised again. Not for several threads."""

    correlation_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    rows: list[dict] = field(default_factory=list)
    _open: list[str] = field(default_factory=list)

    @contextlib.contextmanager
    def span(self, name: str, **attrs):
        row = {"correlation_id": self.correlation_id, "span_id": uuid.uuid4().hex, "parent_id": self._open[-1] if self._open else None, "name": name, "start_ts": time.time(), "end_ts": None, "status": "ok", "attrs": {k: str(v) for k, v in attrs.items()}, "error_type": None, "error_message": None}
        self.rows.append(row)
        self._open.append(row["span_id"])
        try:
            yield row["attrs"]
        except BaseException as e:
            row |= {"status": "error", "error_type": type(e).__name__, "error_message": str(e)}
            raise
        finally:
            row["end_ts"] = time.time()
            self._open.pop()

    def lines(self) -> str:
        return "".join(json.dumps(r) + "\n" for r in self.rows)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SPANS)


def rollup(spans: DataFrame, by: list[str]) -> DataFrame:
    """by, n_spans, n_errors, total_s, longest_s of spans(by, start_s, end_s, status)."""
    took = F.col("end_s") - F.col("start_s")
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("status") == "error").alias("n_errors"), F.sum(took).alias("total_s"), F.max(took).alias("longest_s"))


_TREE = """
WITH RECURSIVE found(correlation_id, span_id, name, level, path) AS (
  SELECT correlation_id, span_id, name, 0, name FROM {spans} WHERE parent_id IS NULL
  UNION ALL
  SELECT s.correlation_id, s.span_id, s.name, f.level + 1, concat_ws('/', f.path, s.name)
  FROM {spans} s JOIN found f ON s.correlation_id = f.correlation_id AND s.parent_id = f.span_id
) SELECT correlation_id, span_id, name, level, path FROM found"""
#: Trees may be as deep and as large as they are; a span is met once at most, since it has one parent.
UNBOUNDED = {"spark.sql.cteRecursionLevelLimit": "-1", "spark.sql.cteRecursionRowLimit": "-1"}


def tree(spans: DataFrame) -> DataFrame:
    """correlation_id, span_id, name, level, path, by a recursive query: each level is joined from the one before it alone.

    Nothing runs while the plan is built. The session's limits of recursion are
    lifted, since they hold when the result is read. A span whose parent is not
    there, or that is its own ancestor, is in no tree and left out.
    """
    spark = spans.sparkSession
    for name, value in UNBOUNDED.items():
        spark.conf.set(name, value)
    return spark.sql(_TREE, spans=spans.select("correlation_id", "span_id", "parent_id", "name"))


# A span with any of these attributes is a call of a model.
MODEL_MARKS = ("tokens_in", "tokens_out", "cost_usd")


def lines(spans: DataFrame) -> DataFrame:
    """span_id, is_model, text: what a printed trace says of spans(span_id, name, start_ts, end_ts, status, attrs, error_type, error_message).

    The name with milliseconds (? while it is open) and OK or ERROR, then lines for
    an error and for the attributes, of which a model's call shows model, tokens and
    cost alone; a value it lacks is None.
    """
    attrs = F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>"))
    is_model = F.arrays_overlap(F.map_keys(attrs), F.array(*[F.lit(m) for m in MODEL_MARKS]))
    took = F.when(F.col("end_ts").isNull(), "?").otherwise(F.format_string("%.1fms", (F.col("end_ts") - F.col("start_ts")) * 1000))
    ok = F.col("status") == "ok"
    head = F.concat(F.col("name"), F.lit(" ["), took, F.lit("] "), F.when(ok, "OK").otherwise("ERROR"))
    shown = lambda k: F.concat(F.lit(k + "="), F.coalesce(attrs[k], F.lit("None")))
    model = F.concat(F.lit("  "), F.concat_ws(" ", *[shown(k) for k in ("model", *MODEL_MARKS)]))
    plain = F.concat(F.lit("  "), F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), ", "))
    error = F.concat(F.lit("  ! "), F.coalesce("error_type", F.lit("None")), F.lit(": "), F.coalesce("error_message", F.lit("None")))
    text = F.concat_ws("\n", head, F.when(~ok, error), F.when(is_model, model).when(F.size(attrs) > 0, plain))
    return spans.select("span_id", is_model.alias("is_model"), text.alias("text"))


def tree_json(spans: DataFrame) -> DataFrame:
    """correlation_id, tree: a JSON object for each run, its spans nested in their parents and in the order of their starts.

    The spans of one run come together in a task. A span whose parent is not there, or
    that is its own ancestor, is left out, as in ``tree``.
    """
    kind = dict(spans.dtypes)["correlation_id"]

    def run(key, found):
        rows = found.astype(object).where(found.notna(), None).sort_values(["start_ts", "span_id"]).to_dict("records")
        children: dict = {}
        for r in rows:
            children.setdefault(r["parent_id"], []).append(r)

        def node(r: dict) -> dict:
            took = None if r["end_ts"] is None or r["start_ts"] is None else round((r["end_ts"] - r["start_ts"]) * 1000, 3)
            own = {k: r[k] for k in ("name", "start_ts", "end_ts", "status", "error_type", "error_message")}
            return own | {"duration_ms": took, "attrs": dict(r["attrs"] or {}), "children": []}

        roots, open_ = [], []
        for r in children.get(None, []):
            roots.append(node(r))
            open_.append((r["span_id"], roots[-1]))
        while open_:  # no recursion: a tree may be deep
            span, made = open_.pop()
            for r in children.get(span, []):
                made["children"].append(node(r))
                open_.append((r["span_id"], made["children"][-1]))
        return pd.DataFrame({"correlation_id": [key[0]], "tree": [json.dumps({"correlation_id": key[0], "spans": roots}, default=str)]})

    return spans.groupBy("correlation_id").applyInPandas(run, f"correlation_id {kind}, tree string")


def append_events(spans: DataFrame, path: str) -> None:
    """One JSON line for each span, added to those below a folder that all executors share."""
    took = F.round((F.col("end_ts") - F.col("start_ts")) * 1000, 3)
    spans.withColumn("duration_ms", took).write.mode("append").option("ignoreNullFields", "false").json(path)


class _Reports:
    """Spark's reports of ended queries, for whoever listens. Java knows Python objects by proxies that it cannot find again, so there is one for a session and it stays."""

    _of: dict[int, _Reports] = {}

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    def __init__(self):
        self.listening: list[QuerySpans] = []

    @classmethod
    def of(cls, spark: SparkSession) -> _Reports:
        from pyspark.java_gateway import ensure_callback_server_started

        if id(spark._jsparkSession) not in cls._of:
            ensure_callback_server_started(spark.sparkContext._gateway)
            cls._of[id(spark._jsparkSession)] = found = cls()
            spark._jsparkSession.listenerManager().register(found)
        return cls._of[id(spark._jsparkSession)]

    def onSuccess(self, action, query, nanoseconds):  # noqa: N802
        for spans in self.listening:
            spans.note(action, query, nanoseconds / 1e9, None)

    def onFailure(self, action, query, exception):  # noqa: N802
        for spans in self.listening:
            spans.note(action, query, 0.0, str(exception.getMessage() or exception.toString()).splitlines()[0])


class QuerySpans:
    """Feeds a tracer: every query that Spark ends meanwhile becomes a span, below the one open then.

    ``with QuerySpans(spark, tracer): ...``; the plan's root and the number of its
    nodes are attributes. Spark reports queries after they end, so leaving the block
    waits until all reports are in.
    """

    def __init__(self, spark: SparkSession, tracer: Tracer, wait_ms: int = 30_000):
        self.spark, self.tracer, self.wait_ms = spark, tracer, wait_ms

    def __enter__(self) -> QuerySpans:
        self._wait()  # what ended before is not reported here
        self.parent = self.tracer._open[-1] if self.tracer._open else None
        _Reports.of(self.spark).listening.append(self)
        return self

    def __exit__(self, *_) -> None:
        self._wait()
        _Reports.of(self.spark).listening.remove(self)

    def _wait(self) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(self.wait_ms)

    def note(self, action: str, query, seconds: float, error: str | None) -> None:
        plan, end = query.executedPlan(), time.time()
        self.tracer.rows.append({
            "correlation_id": self.tracer.correlation_id, "span_id": uuid.uuid4().hex, "parent_id": self.parent, "name": f"query:{action}", "start_ts": end - seconds, "end_ts": end,
            "status": "ok" if error is None else "error", "attrs": {"plan": str(plan.nodeName()), "nodes": str(len(plan.toString().splitlines()))}, "error_type": None if error is None else "QueryError", "error_message": error,
        })
