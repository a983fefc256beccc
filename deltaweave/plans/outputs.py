"""From changes to what people get: reports, drawn sheets, and answers that stand on evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import deltas, models, overlay, rendering, retrieval, trace
from ..sources import sinks
from .engine import Comparison, written

FIELDS = ["did", "kind", "element_type", "zone_a", "zone_b", "description", "severity", "confidence", "is_cascade", "semantic_null"]
#: What a model is told; its answers are checked for the rest.
SYSTEM = "Answer from the context alone. Cite every statement by the bracketed citation of its line. If the context does not answer the question, reply REFUSED: and why."


@dataclass
class Written:
    """Where the outputs of a run are, and how many files of each kind."""

    folder: str
    reports: int
    sheets: int


def reports(found: Comparison, pictures: DataFrame | None = None) -> DataFrame:
    """name, content of the files report.json, report.md and report.html of every pair that was compared; a pair without changes has empty ones."""
    ordered = deltas.report_order(found.deltas)
    compared = found.precheck.where("is_pair").select("pair_id")
    kinds = {
        "json": (rendering.json_report(ordered, FIELDS), '{"n_deltas":0,"deltas":[]}'),
        "md": (rendering.markdown_report(ordered), "# Changes\n\nnone\n"),
        "html": (rendering.html_report(ordered, FIELDS, pictures), rendering.HTML_HEAD + "[]" + rendering.HTML_TAIL),
    }
    out = None
    for kind, (made, empty) in kinds.items():
        files = compared.join(made, "pair_id", "left").select(F.concat(F.col("pair_id").cast("string"), F.lit(f"/report.{kind}")).alias("name"), F.encode(F.coalesce("report", F.lit(empty)), "UTF-8").alias("content"))
        out = files if out is None else out.unionByName(files)
    return out


def drawn_sheets(found: Comparison, images: DataFrame, legend: bool = True) -> DataFrame:
    """pair_id, side, sheet, n_boxes, content of every sheet of the pairs compared, with its changes drawn."""
    accepted = images.join(found.precheck.where("is_pair").select("pair_id"), "pair_id", "left_semi")
    return overlay.overlays(accepted, overlay.with_width(found.boxes(), found.deltas), legend)


def finish(found: Comparison, folder: str, images: DataFrame | None = None, tracer: trace.Tracer | None = None) -> Written:
    """Write reports, and drawn sheets if there are images, as files by pair below a folder that all executors share.

    Executors write the files themselves. With a tracer the steps and Spark's queries
    are spans, added to the events below the folder whether or not a step fails.
    """
    spark = found.deltas.sparkSession
    tracer = tracer or trace.Tracer()
    sheets = None
    try:
        with tracer.span("request"):
            if images is not None:
                with tracer.span("markup") as attrs, trace.QuerySpans(spark, tracer):
                    sheets = written(drawn_sheets(found, images), f"{folder}/drawn")
                    named = F.format_string("%s/markup_%s_sheet%d.png", F.col("pair_id").cast("string"), F.lower("side"), "sheet")
                    sinks.write_files(sheets.select(named.alias("name"), "content"), f"{folder}/out")
                    attrs["n_sheets"] = str(sheets.count())
            with tracer.span("report") as attrs, trace.QuerySpans(spark, tracer):
                files = written(reports(found, sheets), f"{folder}/reports")
                sinks.write_files(files, f"{folder}/out")
                attrs["n_reports"] = str(files.count())
    finally:
        trace.append_events(tracer.table(spark), f"{folder}/events")
    return Written(f"{folder}/out", files.count(), 0 if sheets is None else sheets.count())


def answered(found: Comparison, questions: DataFrame, client: models.Client, folder: str, aliases: DataFrame | None = None, s: Settings = DEFAULT, temperature: float | None = 0.0) -> DataFrame:
    """question_id, pair_id, answer, refused, reason, n_valid, error of questions(question_id, pair_id, question).

    A question without hits, as every one about a refused pair, is refused without
    a call. Replies are stored below the folder, so no plan that reads the answers asks
    again. What a reply cites must be among its question's hits.
    """
    hits = written(found.search(questions, aliases, s), f"{folder}/hits")
    context = retrieval.context_lines(hits)
    prompt = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    requests = questions.join(context, "question_id").select("question_id", F.lit(SYSTEM).alias("system"), prompt.alias("prompt"))
    replies = written(models.asked(requests, client, temperature).select("question_id", F.col("reply").alias("answer"), "error"), f"{folder}/replies")
    every = questions.select("question_id", "pair_id").join(replies, "question_id", "left")
    answers = every.select(F.col("question_id").alias("answer_id"), F.coalesce("answer", F.lit("")).alias("answer"))
    known = hits.select(F.col("question_id").alias("answer_id"), "id")
    gated = retrieval.gate(answers, retrieval.validate(retrieval.cited(answers), known), known)
    return every.join(gated.withColumnRenamed("answer_id", "question_id"), "question_id").select("question_id", "pair_id", "answer", "refused", F.when(F.col("error").isNotNull(), "call_failed").otherwise(F.col("reason")).alias("reason"), "n_valid", "error")
