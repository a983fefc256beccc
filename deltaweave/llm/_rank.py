"""Gapless positions without gathering a partition's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_slots(df: DataFrame, part: str, bucket: Column, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each ``part`` from 0 by (bucket, order).

    Rows are ranked inside (part, bucket); a prefix sum over the buckets' counts
    gives each bucket's first position. ``df`` is read twice, so pass a stored
    table. The prefix table has one row per (part, bucket), which the caller
    bounds, and so may be broadcast.
    """
    rows = df.withColumn("_bucket", bucket)
    firsts = rows.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_first", F.coalesce(F.sum("_n").over(Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = Window.partitionBy(part, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(firsts.drop("_n")), [part, "_bucket"])
        .withColumn(out, (F.col("_first") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_first")
    )
