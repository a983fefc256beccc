"""How rows are dealt to tasks where their bytes do not tell the work or the memory they take.

Adaptive execution merges small partitions, and makes a broadcast of a table whose
compressed shuffle is small. Both go by bytes: a few MB of short rows may be minutes of
drawing, and sorted arrays may take a hundred times their shuffle in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df by these columns in as many partitions as shuffles have, which stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def merged(df: DataFrame) -> DataFrame:
    """df for a join that sorts both sides and never gathers one on the driver."""
    return df.hint("merge")
