"""Typed changes: field differences, kinds, confidence, cascades, severity, semantic nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.tags import match_group

PROCESS_TYPES = ("instrument", "line_tag", "valve_tag", "nozzle", "equipment_tag")
SEVERITIES = ("low", "medium", "high", "critical")


def differs(a: Column, b: Column, s: Settings = DEFAULT) -> Column:
    """Numbers differ beyond the tolerance; a missing value differs from any other."""
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) > s.numeric_tolerance).otherwise(~a.eqNullSafe(b))


def field_changes(attrs_a: DataFrame, attrs_b: DataFrame, keys: list[str], s: Settings = DEFAULT) -> DataFrame:
    """keys, key, old_num, old_str, new_num, new_str of each attribute that changed.

    Attributes are long tables (keys, key, num, str), so the difference is one full
    outer join, and numbers stay apart from strings of digits.
    """
    side = lambda d, n: d.select(*keys, "key", F.col("num").alias(f"{n}_num"), F.col("str").alias(f"{n}_str"))
    both = side(attrs_a, "old").join(side(attrs_b, "new"), [*keys, "key"], "full_outer")
    return both.where(differs(F.col("old_num"), F.col("new_num"), s) | ~F.col("old_str").eqNullSafe(F.col("new_str")))


def kind(in_a: Column, in_b: Column, n_changes: Column, moved: Column) -> Column:
    """add, remove, modify, move, or null where nothing changed."""
    return F.when(~in_a, "add").when(~in_b, "remove").when(n_changes > 0, "modify").when(moved, "move")


def confidence(in_a: Column, in_b: Column, conf_a: Column, conf_b: Column, margin: Column, near_miss: Column, s: Settings = DEFAULT) -> Column:
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    two = F.when(margin.isNull(), 1.0).otherwise(unit(margin)) * conf_a * conf_b
    guard = F.when(near_miss.isNull(), 1.0).otherwise(unit((near_miss - s.max_cost) / s.near_miss_margin))
    return F.round(F.when(in_a & in_b, two).otherwise(F.coalesce(conf_a, conf_b) * guard), 4)


def cascades(modified: DataFrame, scope: list[str], s: Settings = DEFAULT) -> DataFrame:
    """Adds offset, family_size, is_cascade, primary_did.

    modified(scope, did, element_type, id_a, id_b, n_changes, field, old_num,
    new_num): changes of a single number by the same step form a family; of three
    or more all but the one with the smallest id are cascades.
    """
    offset = F.when((F.col("n_changes") == 1) & (F.col("field") != "type"), F.round(F.col("new_num") - F.col("old_num"), 6))
    named = modified.withColumn("offset", offset).withColumn("_group", match_group(F.col("element_type")))
    family = Window.partitionBy(*scope, "_group", "field", "offset")
    first = family.orderBy(F.coalesce("id_b", "id_a", F.lit("")), "did")
    grouped = named.withColumn("family_size", F.when(F.col("offset").isNotNull() & (F.col("offset") != 0), F.count(F.lit(1)).over(family)).otherwise(0).cast("long"))
    found = grouped.withColumn("_first", F.first("did").over(first))
    cascade = (F.col("family_size") >= s.cascade_size) & (F.col("did") != F.col("_first"))
    return found.withColumn("is_cascade", cascade).withColumn("primary_did", F.when(cascade, F.col("_first"))).drop("_first", "_group")


def severity(kind_: Column, element_type: Column, fields: Column, is_cascade: Column) -> Column:
    """fields: array of the names of changed fields."""
    process, sheet_row = element_type.isin(*PROCESS_TYPES), element_type == "datasheet_row"
    has = lambda f: F.coalesce(F.array_contains(fields, f), F.lit(False))
    modify = (
        F.when((element_type == "instrument") & has("setpoints"), "critical")
        .when((element_type == "line_tag") & has("pipe_class"), "high")
        .when(element_type == "equipment_tag", "high")
        .when(process | sheet_row, "medium")
        .otherwise("low")
    )
    one_sided = F.when(process, "high").when(sheet_row, "medium").otherwise("low")
    return F.when(is_cascade, "low").when(kind_ == "modify", modify).when(kind_.isin("add", "remove"), one_sided).otherwise("low")


def severity_rank(severity_: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), severity_) - 1


def semantic_null(kind_: Column, element_type: Column, fields: Column, is_cascade: Column) -> Column:
    """A placeholder note whose range changed: numbering bookkeeping, not a change of meaning."""
    return (kind_ == "modify") & (element_type == "note_deleted") & ~is_cascade & ~F.array_contains(fields, "type") & F.array_contains(fields, "range")


def adjudicate(deltas: DataFrame, judge: Callable[[str, str], bool | None]) -> DataFrame:
    """Adds judged: the judge's word on each distinct (old_content, new_content), asked once; null where it cannot tell."""

    def ask(batches):
        for pdf in batches:
            pdf["judged"] = [judge(a, b) for a, b in zip(pdf["old_content"], pdf["new_content"], strict=True)]
            yield pdf

    asked = deltas.select("old_content", "new_content").distinct().mapInPandas(ask, "old_content string, new_content string, judged boolean")
    return deltas.join(asked, ["old_content", "new_content"], "left")


def summary(deltas: DataFrame, by: list[str]) -> DataFrame:
    primary = ~F.col("is_cascade")
    counts = [F.count_if(primary & (F.col("kind") == k)).alias(f"n_{k}") for k in ("add", "remove", "modify", "move")]
    levels = [F.count_if(F.col("severity") == x).alias(f"n_{x}") for x in SEVERITIES]
    return deltas.groupBy(*by).agg(F.count(F.lit(1)).alias("n_deltas"), F.count_if(primary).alias("n_primary"), F.count_if(F.col("is_cascade")).alias("n_cascade"), *counts, *levels)


def report_order(deltas: DataFrame) -> DataFrame:
    """Adds position: kinds in fixed order, most severe first, then as found."""
    kinds = F.array_position(F.array(*[F.lit(k) for k in ("add", "remove", "modify", "move", "unclassified_visual_change")]), F.col("kind"))
    order = Window.partitionBy("pair_id", "sheet").orderBy(kinds, -severity_rank(F.col("severity")), "did")
    return deltas.withColumn("position", F.row_number().over(order).cast("int"))


def keyed_diff(a: DataFrame, b: DataFrame, key: list[str], compared: dict[str, str], place: tuple[str, str], carried: tuple[str, ...] = (), s: Settings = DEFAULT) -> DataFrame:
    """key, kind, n_changes, fields and the values on both sides of rows that changed between two keyed revisions.

    compared maps each column to 'number' or 'text'; place names the two coordinates
    that make a move. One full outer join on the key, which a bucketed table has for free.
    """
    left = a.select(*key, *[F.col(c).alias(f"{c}_a") for c in (*compared, *place, *carried)], F.lit(True).alias("_a"))
    right = b.select(*key, *[F.col(c).alias(f"{c}_b") for c in (*compared, *place, *carried)], F.lit(True).alias("_b"))
    both = left.join(right, key, "full_outer")
    changed = [F.when(differs(F.col(f"{c}_a"), F.col(f"{c}_b"), s) if t == "number" else ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), F.lit(c)) for c, t in compared.items()]
    x, y = place
    far = F.sqrt(F.pow(F.col(f"{x}_a") - F.col(f"{x}_b"), 2) + F.pow(F.col(f"{y}_a") - F.col(f"{y}_b"), 2)) > s.move_threshold
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    found = both.withColumn("fields", F.when(in_a & in_b, F.array_compact(F.array(*changed))).otherwise(F.array().cast("array<string>")))
    return found.withColumn("n_changes", F.size("fields")).withColumn("kind", kind(in_a, in_b, F.col("n_changes"), far)).where("kind IS NOT NULL").drop("_a", "_b")
