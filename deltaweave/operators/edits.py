"""Edit operators that turn one revision into the next, on tables of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def insert_note(notes: DataFrame, by: list[str], at: int, text: str) -> DataFrame:
    """Insert a note at a number; later notes move up by one. notes(by, note_no, body)."""
    moved = notes.withColumn("note_no", F.when(F.col("note_no") >= at, F.col("note_no") + 1).otherwise(F.col("note_no")))
    new = notes.select(*by).distinct().select(*by, F.lit(at).cast("int").alias("note_no"), F.lit(text).alias("body"))
    return moved.unionByName(new)


def update_references(text: Column, at: int) -> Column:
    """NOTE n in running text, for every n from ``at`` on, becomes NOTE n + 1."""
    rest = F.split(text, r"\bNOTE \d+\b")
    numbers = F.regexp_extract_all(text, F.lit(r"\bNOTE (\d+)\b"), 1)

    def renumbered(digits: Column) -> Column:
        n = digits.try_cast("decimal(38,0)")
        return F.concat(F.lit("NOTE "), F.when(n >= at, (n + 1).cast("string")).otherwise(digits))

    return F.array_join(F.zip_with(rest, numbers, lambda piece, digits: F.concat(piece, F.coalesce(renumbered(digits), F.lit("")))), "")


def delete_note(notes: DataFrame, doomed: Column) -> DataFrame:
    """A deleted note keeps its number and says so."""
    return notes.withColumn("body", F.when(doomed, "DELETED.").otherwise(F.col("body")))


def collapse_deleted(notes: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring deleted notes become one with a range. by, lo, hi, body."""
    order = Window.partitionBy(*by).orderBy("note_no")
    gone = F.col("body") == "DELETED."
    joins = gone & (F.lag("body").over(order) == "DELETED.") & (F.lag("note_no").over(order) == F.col("note_no") - 1)
    run = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return notes.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("note_no").alias("lo"), F.max("note_no").alias("hi"), F.first("body").alias("body")).drop("_run")


def renumber_family(elements: DataFrame, family: Column, column: str, offset: int) -> DataFrame:
    return elements.withColumn(column, F.when(family, F.col(column) + offset).otherwise(F.col(column)))


def set_value(elements: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """A new pipe class, setpoint, datasheet value or body text."""
    return elements.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def reword(elements: DataFrame, column: str, phrases: DataFrame) -> DataFrame:
    """Replace texts that have an equivalent in phrases(old, new); Spark broadcasts them if it finds them small."""
    return elements.join(phrases, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def move(elements: DataFrame, where: Column, dx: float, dy: float) -> DataFrame:
    hold = lambda c, d: F.when(where, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + d))).otherwise(F.col(c))
    return elements.withColumn("x", hold("x", dx)).withColumn("y", hold("y", dy))


def add_instruments(pairs: DataFrame, func: str = "PIT", system: str = "26", first_loop: int = 9700) -> DataFrame:
    """pair_id, type, content, x, y: one new instrument for each of pairs(pair_id), its loop, setpoint and place by the key."""
    loop = (first_loop + (F.col("pair_id") * 37 + 11) % 100).cast("string")
    high = F.element_at(F.array(F.lit("140"), F.lit("160"), F.lit("245")), (F.col("pair_id") % 3 + 1).cast("int"))
    place = lambda step, low, share: low + share * ((F.col("pair_id") * step) % 1000) / 1000.0
    content = F.concat_ws(" ", F.lit(func), loop, F.lit(system), F.concat(F.lit("SD HH:"), high), F.lit("LL:75"))
    return pairs.select("pair_id", F.lit("instrument").alias("type"), content.alias("content"), place(7919, 0.15, 0.6).alias("x"), place(104729, 0.15, 0.7).alias("y"))


def remove_one(elements: DataFrame, where: Column, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Elements without one of those of each pair that fit, and the removed ones: that whose key's hash is least; pairs without any keep all."""
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    doomed = elements.where(where).groupBy("pair_id").agg(F.min_by(key, F.struct(drawn, key)).alias(key))
    return elements.join(doomed, ["pair_id", key], "left_anti"), elements.join(doomed, ["pair_id", key], "left_semi")


def labelled(kind: str, elements: DataFrame) -> DataFrame:
    """pair_id, kind, element_type, zone, description of changes that add or remove elements(pair_id, type, content, x, y)."""
    zone = G.zone(F.col("x"), F.col("y"))
    verb = {"add": " added", "remove": " removed"}[kind]
    return elements.select("pair_id", F.lit(kind).alias("kind"), F.col("type").alias("element_type"), zone.alias("zone"), F.concat("type", F.lit(" "), "content", F.lit(verb)).alias("description"))


def swap_symbol(shapes: DataFrame, where: Column) -> DataFrame:
    """The other symbol at the same place: circles become squares of their radius and rectangles circles; shapes(kind, x0, y0, x1, y1)."""
    half = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    kind = F.when(F.col("kind") == "circle", "rect").when(F.col("kind") == "rect", "circle").otherwise(F.col("kind"))
    boxed = {"x0": cx - half, "y0": cy - half, "x1": cx + half, "y1": cy + half}
    return shapes.withColumns({"kind": F.when(where, kind).otherwise(F.col("kind"))} | {c: F.when(where, v).otherwise(F.col(c)) for c, v in boxed.items()})


def reroute(lines: DataFrame, where: Column, by: float) -> DataFrame:
    """A straight line becomes three, round a corner pair at a distance: lines(line_id, seg, x0, y0, x1, y1) inside the sheet.

    Lines that are more level go up or down, others sideways; towards the side with
    more room. Lines elsewhere stay as they are.
    """
    level = F.abs(F.col("x1") - F.col("x0")) >= F.abs(F.col("y1") - F.col("y0"))
    mid = F.when(level, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    off = F.when(mid < 0.5, by).otherwise(-by)
    dx, dy = F.when(level, 0.0).otherwise(off), F.when(level, off).otherwise(0.0)
    a, b = (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))
    a2, b2 = (a[0] + dx, a[1] + dy), (b[0] + dx, b[1] + dy)
    part = lambda p, q: F.struct(p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1"))
    parts = F.when(where, F.array(part(a, a2), part(a2, b2), part(b2, b))).otherwise(F.array(part(a, b)))
    rest = [c for c in lines.columns if c not in ("seg", "x0", "y0", "x1", "y1")]
    return lines.select(*rest, "seg", F.posexplode(parts).alias("part", "p")).select(*rest, (F.col("seg") * 3 + F.col("part")).alias("seg"), "p.*")


def bump_revision(label: Column) -> Column:
    """The next letter; Z stays."""
    return F.when(label >= "Z", label).otherwise(F.chr(F.ascii(label) + 1))


def append_dcn(dcns: Column, new: Column) -> Column:
    return F.concat(F.coalesce(dcns, F.array().cast("array<string>")), F.array(new))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def missing_targets(wanted: DataFrame, elements: DataFrame, column: str) -> DataFrame:
    """Edits whose target text occurs nowhere."""
    return wanted.join(elements.select(F.col(column).alias("target")).distinct(), "target", "left_anti")


def with_targets(wanted: DataFrame, elements: DataFrame, column: str) -> DataFrame:
    """Edits wanted(target, ...) as they are; the query that reads them fails at the first whose target text occurs nowhere, and names it."""
    there = elements.select(F.col(column).alias("target"), F.lit(True).alias("_there")).distinct()
    failed = F.raise_error(F.concat(F.lit("no element holds the text to edit: "), F.coalesce("target", F.lit("null")))).cast("boolean")
    return wanted.join(there, "target", "left").where(F.coalesce("_there", failed)).select(*wanted.columns)
