"""Column builders over normalised boxes; a box is a struct x0, y0, x1, y1 with y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS, COLUMNS = "ABCDEFGHIJ", 12


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def zone(x: Column, y: Column) -> Column:
    """Row letter and column number on the fixed grid; points outside fall into the border cells."""
    cell = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), (v * n).cast("int")))
    return F.concat_ws("-", F.substr(F.lit(ROWS), cell(y, len(ROWS)) + 1, F.lit(1)), (cell(x, COLUMNS) + 1).cast("string"))


def zone_label_shaped(text: Column, x: Column, y: Column, margin: float = 0.02) -> Column:
    edge = (x <= margin) | (x >= 1 - margin) | (y <= margin) | (y >= 1 - margin)
    return text.rlike(r"^([1-9]|1[0-2]|[A-J])$") & edge


def border_rect(b: Column, margin: float = 0.03) -> Column:
    return (b["x0"] <= margin) & (b["y0"] <= margin) & (b["x1"] >= 1 - margin) & (b["y1"] >= 1 - margin)


def contains(b: Column, x: Column, y: Column) -> Column:
    return (b["x0"] <= x) & (x <= b["x1"]) & (b["y0"] <= y) & (y <= b["y1"])


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h)


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union == 0, 0.0).otherwise(overlap(a, b) / F.nullif(union, F.lit(0.0)))


def overlap_fraction(region: Column, b: Column) -> Column:
    """Share of the region that b covers."""
    return F.when(area(region) <= 0, 0.0).otherwise(overlap(region, b) / F.nullif(area(region), F.lit(0.0)))


def padded(b: Column, by: float) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def apply_similarity(x: Column, y: Column, scale: Column, rotation: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    c, s = F.cos(rotation), F.sin(rotation)
    return scale * (c * x - s * y) + tx, scale * (s * x + c * y) + ty


def to_units(b: Column, width: Column, height: Column, pad: float) -> Column:
    """A box in the units of its sheet, padded and held inside it."""
    hold = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    return box(hold(b["x0"] * width - pad, width), hold(b["y0"] * height - pad, height), hold(b["x1"] * width + pad, width), hold(b["y1"] * height + pad, height))


def path_kind(items: Column) -> Column:
    """Kind of a drawn path from its item codes: re (rectangle), c (curve), l (line)."""
    only = lambda code: F.forall(items, lambda i: i == code)
    return (
        F.when(F.exists(items, lambda i: i == "re"), "rect").when((F.size(items) > 0) & only("c"), "circle").when((F.size(items) > 0) & only("l"), "line").otherwise("other")
    )


def geometry_class(kind: Column, b: Column) -> Column:
    """struct(geom_kind, r_norm, confidence, rule) of a drawn path; null for the border of a sheet, which is no element."""
    made = lambda radius, confidence, rule: F.struct(kind.alias("geom_kind"), radius.cast("double").alias("r_norm"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))
    none = F.lit(None).cast("double")
    radius = (b["x1"] - b["x0"] + b["y1"] - b["y0"]) / 4
    return F.when((kind == "rect") & border_rect(b), None).when(kind == "circle", made(radius, 1.0, "geom:circle")).when(kind == "line", made(none, 1.0, "geom:line")).otherwise(made(none, 0.5, "geom:other"))
