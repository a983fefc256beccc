"""Made-up sheets, edit scripts, label mapping and questions; everything follows from keys, so runs agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import write_png
from .dealing import dealt

#: kind of element, how many a sheet has at least, and how many more by key.
COMPOSITION = (
    ("zone_label", 44, 1), ("title_field", 6, 1), ("rev_row", 1, 1), ("datasheet_row", 5, 1), ("note", 14, 7), ("dcn_note", 1, 1), ("instrument", 8, 7), ("line_tag", 10, 7), ("valve_tag", 8, 5),
    ("nozzle", 6, 5), ("line", 6, 1), ("circle", 1, 1), ("equipment_tag", 1, 1),
)
EDITS = ("insert_note", "delete_note", "renumber_family", "pipe_class", "setpoint", "reword", "move", "add_instrument", "remove_valve", "symbol_swap")
KINDS = ("edited", "null_ident", "null_prod", "null_reword", "not_a_pair")


def sheet_elements(pairs: DataFrame) -> DataFrame:
    """pair_id, type, n (number within type), x, y for every element of every pair's sheet.

    Counts and places come from the key by small modular steps; all is one expansion
    of a literal table, with no shuffle.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(low).alias("low"), F.lit(more).alias("more"), F.lit(i).alias("i")) for i, (k, low, more) in enumerate(COMPOSITION)])
    each = pairs.select("pair_id", F.explode(kinds).alias("k")).select("pair_id", "k.*")
    every = each.select("pair_id", "type", "i", F.explode(F.sequence(F.lit(1), F.col("low") + (F.col("pair_id") * 31 + F.col("i") * 17) % F.col("more"))).alias("n"))
    at = lambda a, b: ((F.col("pair_id") * a + F.col("i") * b + F.col("n") * 7919) % 1000) / 1000.0
    return every.select("pair_id", "type", "n", at(37, 101).alias("x"), at(53, 211).alias("y"))


def edit_scripts(pairs: DataFrame, low: int = 2, high: int = 8, shape: float = 1.1) -> DataFrame:
    """pair_id, place, edit: one more edit than the whole part of a Pareto variate, two to eight of them, few far more often than many; the revision bump is last."""
    u = ((F.col("pair_id") * 7919 + 13) % 997 + 1) / 998.0
    count = F.greatest(F.lit(low), F.least(F.lit(high), 1 + F.floor(F.pow(u, F.lit(-1.0 / shape)) + 1e-9))).cast("int")
    places = pairs.select("pair_id", F.explode(F.sequence(F.lit(1), count + 1)).alias("place"), count.alias("n"))
    chosen = F.element_at(F.array(*[F.lit(e) for e in EDITS]), ((F.col("pair_id") * 131 + F.col("place") * 29) % len(EDITS) + 1).cast("int"))
    return places.select("pair_id", "place", F.when(F.col("place") > F.col("n"), "bump_revision").otherwise(chosen).alias("edit"))


def pair_kind(pair_id: Column, edited: int = 6) -> Column:
    """Six edited pairs for each of the four controls."""
    at = pair_id % (edited + len(KINDS) - 1)
    return F.when(at < edited, KINDS[0]).otherwise(F.element_at(F.array(*[F.lit(k) for k in KINDS[1:]]), (F.greatest(at - edited, F.lit(0)) + 1).cast("int")))


def to_pixels(x_mm: Column, y_mm: Column, height_mm: Column, dpi: Column) -> tuple[Column, Column]:
    """Labels in mm from the bottom left, in pixels from the top left."""
    return x_mm / 25.4 * dpi, (height_mm - y_mm) / 25.4 * dpi


def draw_sheets(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """pair_id, side, sheet, content (PNG): a white sheet for each pair and side with its boxes(pair_id, side, x, y, w, h, grey) filled in pixels, darker ones last."""
    things = F.sort_array(F.collect_list(F.struct((-F.col("grey")).alias("light"), "x", "y", "w", "h"))).alias("things")
    grouped = dealt(boxes, "pair_id", "side").groupBy("pair_id", "side").agg(things)

    def draw(things: pd.Series) -> pd.Series:
        out = []
        for sheet in things:
            image = np.full((height, width), 255, np.uint8)
            for t in sheet:
                image[max(t["y"], 0) : max(t["y"] + t["h"], 0), max(t["x"], 0) : max(t["x"] + t["w"], 0)] = -t["light"]
            out.append(write_png(image))
        return pd.Series(out, dtype=object)

    return grouped.select("pair_id", "side", F.lit(1).alias("sheet"), F.pandas_udf(draw, "binary")("things").alias("content"))


def questions(deltas: DataFrame) -> DataFrame:
    """did, question, expected: one question for each primary change, and one that must be refused for every fifth."""
    asked = F.when(F.col("kind") == "add", F.concat(F.lit("What was added in zone "), F.col("zone"), F.lit("?"))).when(F.col("kind") == "remove", F.concat(F.lit("What was removed from zone "), F.col("zone"), F.lit("?")))
    asked = asked.when(F.col("kind") == "move", F.concat(F.lit("Where did "), F.col("content"), F.lit(" move?"))).otherwise(F.concat(F.lit("How did "), F.col("content"), F.lit(" change?")))
    primary = deltas.where("NOT is_cascade")
    return primary.select("did", asked.alias("question"), F.lit("answer").alias("expected")).unionByName(
        primary.where("did % 5 = 0").select("did", F.concat(F.lit("Who approved "), F.col("content"), F.lit("?")).alias("question"), F.lit("refuse").alias("expected"))
    )


def unfaithful(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements whose first word does not occur in their page's text; a faithful rendering leaves none."""
    word = F.regexp_extract("content", r"^\s*(\S+)", 1)
    return elements.withColumn("_word", word).join(pages, "page_id").where((F.col("_word") != "") & ~F.contains(F.col("page_text"), F.col("_word"))).drop("_word", "page_text")
