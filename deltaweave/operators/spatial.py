"""Joins of boxes that touch, by cells of a pyramid of grids.

A sheet is cut into 4**level cells at each level. A box belongs to the finest level
at which no side is longer than a cell, so that it touches four cells of that level
at most; on all coarser levels it is listed under the cells that it touches too.
Two boxes that touch share a cell at the coarser of their levels. They are joined
there by equality of (page, level, cell), one of them at its own level, and a pair
that shares several cells counts in the one that holds the corner of what they share.

So a full sheet and a dot cost the same few rows, a page of many boxes is dealt out
by cell, and no page is a group of its own. Places outside the sheet belong to the
cells around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import merged

#: The finest grid has 512 x 512 cells.
LEVELS = 9


def _cell(value: Column, level: Column) -> Column:
    wide = F.pow(F.lit(2.0), level)
    return F.greatest(F.lit(-1.0), F.least(wide, F.floor(value * wide))).cast("int")


def _listed(df: DataFrame, box: str, page: list[str]) -> DataFrame:
    """page, _box, _own, _level, _cx, _cy: every level and cell of each distinct box."""
    b = F.col("_box")
    side = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"])
    finest = F.when(side <= 2.0**-LEVELS, LEVELS).otherwise(F.greatest(F.lit(0.0), F.floor(-F.log2(side)))).cast("int")
    cells = lambda low, high: F.explode(F.sequence(_cell(low, F.col("_level")), _cell(high, F.col("_level"))))
    once = df.select(*page, F.col(box).alias("_box")).where((b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])).distinct()
    leveled = once.withColumn("_own", finest).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    return leveled.withColumn("_cx", cells(b["x0"], b["x1"])).withColumn("_cy", cells(b["y0"], b["y1"]))


def touching(left: DataFrame, right: DataFrame, page: list[str], box: str = "box", other: str = "box") -> DataFrame:
    """page, left_box, right_box: the distinct pairs of boxes of a page that share a point; borders belong to a box. Null boxes share none."""
    names = lambda side: [*page, F.col("_box").alias(f"{side}_box"), "_level", "_cx", "_cy"]
    l, r = _listed(left, box, page), _listed(right, other, page)  # noqa: E741
    key = [*page, "_level", "_cx", "_cy"]
    owned = merged(l.where("_own = _level").select(*names("left"))).join(r.select(*names("right")), key)
    met = owned.unionByName(merged(l.where("_own > _level").select(*names("left"))).join(r.where("_own = _level").select(*names("right")), key))
    a, b = F.col("left_box"), F.col("right_box")
    x, y = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    shared = (x <= F.least(a["x1"], b["x1"])) & (y <= F.least(a["y1"], b["y1"]))
    corner = (_cell(x, F.col("_level")) == F.col("_cx")) & (_cell(y, F.col("_level")) == F.col("_cy"))
    return met.where(shared & corner).select(*page, "left_box", "right_box")
