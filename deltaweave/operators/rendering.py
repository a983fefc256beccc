"""What the renderers draw, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

STYLE = {"add": "#1b9e4b", "remove": "#d03030", "modify": "#d98a00", "move": "#2f6fd0", "unclassified_visual_change": "#8040b0"}


def boxes(deltas: DataFrame, elements: DataFrame) -> DataFrame:
    """pair_id, sheet, did, drawn_on, box, colour, filled, dashed.

    Adds are drawn on side B, removes on side A, the others on both; moves and
    cascades are outlines, visual changes dashed. deltas has id_a, id_b and box.
    """
    side = lambda s: elements.where(F.col("side") == s).select("pair_id", F.col("id").alias(f"id_{s.lower()}"), F.col("box").alias(f"_box_{s.lower()}")).dropDuplicates(["pair_id", f"id_{s.lower()}"])
    joined = deltas.join(side("A"), ["pair_id", "id_a"], "left").join(side("B"), ["pair_id", "id_b"], "left")
    drawn = joined.withColumn("_on", F.explode(F.when(F.col("kind") == "add", F.array(F.lit("B"))).when(F.col("kind") == "remove", F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))))
    colour = F.coalesce(F.create_map(*[F.lit(x) for kv in STYLE.items() for x in kv])[F.col("kind")], F.lit("#808080"))
    visual = F.col("kind") == "unclassified_visual_change"
    at = F.coalesce(F.when(F.col("_on") == "A", F.col("_box_a")).otherwise(F.col("_box_b")), F.col("box"))
    return drawn.select("pair_id", "sheet", "did", F.col("_on").alias("drawn_on"), at.alias("box"), colour.alias("colour"), (~F.col("is_cascade") & ~F.col("kind").isin("move") & ~visual).alias("filled"), visual.alias("dashed")).where("box IS NOT NULL")


def annotations(drawn: DataFrame, width: Column, height: Column, pad: float = 1.5) -> DataFrame:
    """Boxes in the units of their sheets."""
    return drawn.withColumn("box", G.to_units(F.col("box"), width, height, pad))


# Opacity of filled boxes and of outlines, border width in points of primary changes and of cascades.
OPACITY, WIDTH = (0.25, 0.9), (2.5, 1.0)


def annotation_looks(deltas: DataFrame, title: str = "change") -> DataFrame:
    """pair_id, did, opacity, width, title, info of the annotations of deltas: what a PDF writer sets on each box.

    A description that is missing or empty becomes the kind and the element's type.
    """
    plain = F.when(F.col("kind") == "unclassified_visual_change", "unclassified visual change").otherwise(F.concat(F.col("kind"), F.lit(" ("), F.col("element_type"), F.lit(")")))
    filled = ~F.col("is_cascade") & ~F.col("kind").isin("move", "unclassified_visual_change")
    return deltas.select(
        "pair_id", "did", F.when(filled, OPACITY[0]).otherwise(OPACITY[1]).alias("opacity"), F.when(F.col("is_cascade"), WIDTH[1]).otherwise(WIDTH[0]).alias("width"),
        F.concat(F.lit(title + ": "), F.col("kind")).alias("title"), F.coalesce(F.nullif(F.col("description"), F.lit("")), plain).alias("info"),
    )


def json_report(deltas: DataFrame, fields: list[str]) -> DataFrame:
    """pair_id, report: a JSON object for each pair with its changes in report order (column position)."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("sheet", "position", F.struct(*fields).alias("d")))), lambda x: x["d"])
    return deltas.groupBy("pair_id").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n_deltas"), items.alias("deltas"))).alias("report"))


def markdown_report(deltas: DataFrame) -> DataFrame:
    """pair_id, report: a line for each change, primary ones first level, cascades below."""
    line = F.concat(F.when(F.col("is_cascade"), "  - ").otherwise("- "), F.lit("**"), F.col("kind"), F.lit("** ["), F.col("severity"), F.lit("] "), F.col("description"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sheet", "position", line.alias("l")))), lambda x: x["l"])
    return deltas.groupBy("pair_id").agg(F.concat(F.lit("# Changes\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("report"))


HTML_HEAD = (
    "<!doctype html><meta charset=utf-8><title>Changes</title><input id=q placeholder=Search><select id=k><option value=''>all kinds</option></select>"
    "<label><input type=checkbox id=c checked>cascades</label><table id=t></table><script>const rows="
)
HTML_TAIL = (
    ";const by=id=>document.getElementById(id);for(const k of new Set(rows.map(r=>r.kind)))by('k').add(new Option(k));"
    "function draw(){by('t').replaceChildren(...rows.filter(r=>(!by('k').value||r.kind==by('k').value)&&(by('c').checked||!r.is_cascade)&&JSON.stringify(r).toLowerCase().includes(by('q').value.toLowerCase()))"
    ".map(r=>{const tr=document.createElement('tr');for(const v of Object.values(r)){tr.insertCell().textContent=v}return tr}))}"
    "for(const id of ['q','k','c'])by(id).oninput=draw;draw()</script>"
)


def html_report(deltas: DataFrame, fields: list[str], pictures: DataFrame | None = None) -> DataFrame:
    """pair_id, report: one page for each pair with its records and filters by kind, cascade and text; and with its sheets, if there are pictures(pair_id, side, sheet, content)."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("sheet", "position", F.struct(*fields).alias("d")))), lambda x: x["d"])
    head = deltas.groupBy("pair_id").agg(F.concat(F.lit(HTML_HEAD), F.regexp_replace(F.to_json(items), "</", "<\\\\\\\\/"), F.lit(HTML_TAIL)).alias("report"))
    if pictures is None:
        return head
    name = F.concat(F.col("side"), F.col("sheet").cast("string"))
    image = F.concat(F.lit("<figure><img alt='"), name, F.lit("' src='data:image/png;base64,"), F.translate(F.base64("content"), "\r\n", ""), F.lit("'><figcaption>"), name, F.lit("</figcaption></figure>"))
    # The sheets of a pair are one page, as a reader wants them.
    sheets = pictures.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "side", image.alias("i")))), lambda x: x["i"]), "").alias("_sheets"))
    whole = F.concat(F.coalesce("report", F.lit(HTML_HEAD + "[]" + HTML_TAIL)), F.coalesce("_sheets", F.lit("")))
    return head.join(sheets, "pair_id", "full_outer").select("pair_id", whole.alias("report"))
