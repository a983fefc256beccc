"""Benchmark decontamination by size-partitioned MinHash containment search.

An item with m distinct shingles is contained at threshold t when at least
need = ceil(t * m) of them occur in a document. Such a document lacks at most
m - need of them, so it holds at least one of any m - need + 1. The MinHash
sketch of an item is just that many of its smallest shingle hashes. Items are
partitioned by size, and each partition has a bound: the largest hash in its
sketches. The sketch of a document for a partition is all its shingle hashes up
to that bound, and a join on (partition, hash) finds every contained item and
few others. Whole documents are sketched, however long, with no hash family to
tune and no false negatives; candidates are then verified by exact shingles.

Only DataFrame functions are used. Arrays are expanded by explode_outer because
explode lets the optimizer copy the array's expression into a filter, and with it
the split of the whole text into each step of the lambda. Words are runs of letters and digits, with
A-Z lower-cased, so that punctuation and case do not hide a copy.

Defined cases: null and empty texts, and items of fewer words than a shingle,
have no shingles and match nothing; repeated items or documents give their pair
once; an empty table on either side gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

WIDTH, THRESHOLD = 5, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sketches and candidates up to so many rows (16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(array: str, width: int, make) -> Column:
    """make(i) for each start i of ``width`` entries of a column; the column must be a plain one, as it is read in every step."""
    last = F.size(array) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), make))


def with_shingle_hashes(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds ``hashes``, the distinct shingle hashes of column ``text`` (null if it has none)."""
    hashed = df.withColumn("_hashed", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    made = _runs("_hashed", width, lambda i: F.xxhash64(*[F.get(F.col("_hashed"), i + k) for k in range(width)]))
    return hashed.withColumn("hashes", F.array_distinct(made)).drop("_hashed")


def with_shingles(df: DataFrame, out: str, width: int = WIDTH) -> DataFrame:
    """Replaces column ``text`` by ``out``, its distinct shingles themselves (null if it has none)."""
    split = df.withColumn("_words", words(F.col("text")))
    made = _runs("_words", width, lambda i: F.array_join(F.slice(F.col("_words"), i + 1, width), " "))
    return split.withColumn(out, F.array_distinct(made)).drop("_words", "text")


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast only if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def document_sketches(hashed: DataFrame, bounds: DataFrame) -> DataFrame:
    """doc_id, size_class, hash: for each class of bounds(size_class, bound), the rows of hashed(doc_id, hash) up to its bound."""
    return hashed.join(F.broadcast(bounds), F.col("hash") <= F.col("bound")).select("doc_id", "size_class", "hash")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for every item contained in a document."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    need = F.ceil(F.round(F.col("n_item") * threshold, 9)).cast("int")
    wanted = (
        with_shingle_hashes(items.select("item_id", "text"), width)
        .withColumn("n_item", F.size("hashes"))
        .withColumn("need", need)
        .withColumn("sketch", F.slice(F.array_sort("hashes"), 1, F.col("n_item") - F.col("need") + 1))
        .withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
        .select("item_id", "text", "need", "size_class", F.explode_outer("sketch").alias("hash"))
        .where("hash IS NOT NULL")
    )
    wanted = scratch.keep(wanted, "sketches")
    sketches = wanted.select("item_id", "size_class", "hash").distinct()
    bounds = wanted.groupBy("size_class").agg(F.max("hash").alias("bound"))  # one row for each power of two
    top = bounds.agg(F.max("bound")).first()[0]
    hashed = with_shingle_hashes(docs.select("doc_id", "text"), width).select("doc_id", F.explode_outer("hashes").alias("hash"))
    if top is not None:
        hashed = hashed.where(F.col("hash") <= F.lit(top))
    candidates = document_sketches(hashed, bounds).join(_small(sketches), ["size_class", "hash"]).select("doc_id", "item_id").distinct()
    candidates = scratch.keep(candidates, "candidates")
    exact_items = scratch.keep(with_shingles(items.select("item_id", "text").distinct(), "item_shingles", width), "items")
    exact_docs = with_shingles(docs.select("doc_id", "text").join(_small(candidates.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_shingles", width)
    return (
        exact_docs.join(_small(candidates), "doc_id")
        .join(exact_items, "item_id")
        .withColumn("n_item", F.size("item_shingles"))
        .withColumn("n_shared", F.size(F.array_intersect("item_shingles", "doc_shingles")))
        .where((F.col("n_item") > 0) & (F.col("n_shared") >= need))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose text contains no item, whatever their doc_id; equal texts are searched once."""
    scratch = Scratch(docs.sparkSession, "contaminated")
    hashed = docs.withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))
    found = contained_items(hashed.select(F.col("_text").alias("doc_id"), "text"), items, width, threshold)
    found = scratch.keep(found.select(F.col("doc_id").alias("_text")).distinct(), "found")
    return hashed.join(_small(found), "_text", "left_anti").drop("_text")


ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM d WHERE len(w) >= 5
), ish AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM i WHERE len(w) >= 5
), m AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared
FROM ds JOIN ish USING (s) JOIN m USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 5 >= n_item * 4
"""
