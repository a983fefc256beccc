"""Registration of frame B onto frame A by anchors that both sides share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import strip

ANCHOR_TYPES = ("title_field", "equipment_tag", "zone_label")


def anchors(elements: DataFrame) -> DataFrame:
    """pair_id, sheet, content, ax, ay, bx, by: anchor texts that are unique on either side of a sheet.

    elements(pair_id, side, sheet, type, content, x, y) with box centres.
    """
    only = Window.partitionBy("pair_id", "side", "sheet", "content")
    found = elements.where(F.col("type").isin(*ANCHOR_TYPES) & (strip(F.col("content")) != "")).withColumn("n", F.count(F.lit(1)).over(only)).where("n = 1")
    side = lambda s: found.where(F.col("side") == s).select("pair_id", "sheet", "content", F.col("x").alias(f"{s.lower()}x"), F.col("y").alias(f"{s.lower()}y"))
    return side("A").join(side("B"), ["pair_id", "sheet", "content"])


def similarity(points: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """pair_id, n_anchors, scale, rotation, tx, ty with A = scale * R * B + t, in least squares.

    With centred sums p = sum(bx*ax + by*ay), q = sum(bx*ay - by*ax) and
    v = sum(bx*bx + by*by) the best rotation is atan2(q, p) and the scale
    hypot(p, q) / v; so two passes of aggregates do, without a decomposition.
    Fewer than two anchors, or anchors in one place, give the identity.
    """
    means = points.groupBy("pair_id").agg(*[F.avg(c).alias(f"m{c}") for c in ("ax", "ay", "bx", "by")], F.count(F.lit(1)).alias("n_anchors"))
    c = points.join(means, "pair_id")
    ax, ay, bx, by = (F.col(k) - F.col(f"m{k}") for k in ("ax", "ay", "bx", "by"))
    sums = c.groupBy("pair_id").agg(
        F.sum(bx * ax + by * ay).alias("p"), F.sum(bx * ay - by * ax).alias("q"), F.sum(bx * bx + by * by).alias("v"),
        *[F.first(k).alias(k) for k in ("max", "may", "mbx", "mby", "n_anchors")],
    )
    good = (F.col("n_anchors") >= s.least_anchors) & (F.col("v") > 1e-18)
    rotation, scale = F.atan2("q", "p"), F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q")) / F.col("v")
    solved = sums.withColumn("rotation", F.when(good, rotation).otherwise(0.0)).withColumn("scale", F.when(good, scale).otherwise(1.0))
    cos, sin = F.col("scale") * F.cos("rotation"), F.col("scale") * F.sin("rotation")
    return solved.select(
        "pair_id", "n_anchors", "scale", "rotation",
        F.when(good, F.col("max") - (cos * F.col("mbx") - sin * F.col("mby"))).otherwise(0.0).alias("tx"),
        F.when(good, F.col("may") - (sin * F.col("mbx") + cos * F.col("mby"))).otherwise(0.0).alias("ty"),
    )
