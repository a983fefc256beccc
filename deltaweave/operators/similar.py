"""Joins of texts by Indel similarity, without comparing all pairs of a group.

Similarity is 2 * LCS / (length + length), in percent. To reach a floor t, a pair's
lengths must be close, and both must have many characters in common whatever their
order. So texts become sets of numbered characters (the second 'e' is another than
the first), in one order that puts high numbers first, since those are rare. Two
sets that share ``need`` of their members share one among the first
``size - need + 1`` of each: pairs meet by that prefix alone, in an equi-join. What
both have in common is counted next, and only then is the similarity itself computed,
once for each pair of different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import similarity_column
from .dealing import dealt, merged


def _marks(text: Column) -> Column:
    """The numbered characters of a text, highest numbers first; one mark of its own for an empty text."""
    # Sorted, equal characters stand together, and the place of the first tells the number of each.
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    numbered = F.transform(chars, lambda c, i: F.concat(F.lpad((i + 2 - F.array_position(chars, c)).cast("string"), 6, "0"), c))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.sort_array(numbered, asc=False))


def similar_texts(a: DataFrame, b: DataFrame, by: list[str], floor: float) -> DataFrame:
    """by, text_a, text_b, score of the different pairs of texts(by, text) of both sides with a similarity of at least floor percent."""
    t = floor / 100

    def side(df: DataFrame, n: str) -> DataFrame:
        once = df.select(*by, F.coalesce("text", F.lit("")).alias(f"text_{n}")).distinct()
        once = dealt(once, *by, f"text_{n}").withColumn(f"marks_{n}", _marks(F.col(f"text_{n}"))).withColumn(f"length_{n}", F.length(f"text_{n}"))
        # The shortest partner that can do it shares so many; a little less, for rounding.
        need = F.ceil(F.col(f"length_{n}") * (t / (2 - t)) - 1e-6)
        return once.withColumn("mark", F.explode(F.slice(f"marks_{n}", F.lit(1), F.greatest(F.lit(1), (F.size(f"marks_{n}") - need + 1).cast("int")))))

    x, y = F.col("length_a"), F.col("length_b")
    reach = 2 * F.least(x, y) >= (x + y) * t - 1e-6
    met = merged(side(a, "a")).join(side(b, "b"), [*by, "mark"]).where(reach).drop("mark", "length_a", "length_b").dropDuplicates([*by, "text_a", "text_b"])
    shared = 2 * F.size(F.array_intersect("marks_a", "marks_b")) >= (F.length("text_a") + F.length("text_b")) * t - 1e-6
    close = met.where(shared | ((F.col("text_a") == "") & (F.col("text_b") == "")))
    return scored(close.select(*by, "text_a", "text_b")).where(F.col("score") >= floor)


def scored(pairs: DataFrame) -> DataFrame:
    """pairs(text_a, text_b, ...) with their similarity in percent as score."""
    return pairs.withColumn("score", 100 * similarity_column()(F.col("text_a"), F.col("text_b")))
