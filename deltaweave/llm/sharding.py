"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form one indivisible group. Groups over 1/ITEMS of
all bytes are items of their own (there can be at most ITEMS of them); the
others are hashed into at most ITEMS bundles. Differencing then runs over those
at most 2 * ITEMS sizes: take the two partial partitions with the largest
spread, add the largest sum of one to the smallest of the other, put the result
back, until one is left. So what one task holds is bounded whatever the input,
and the spread left is far below the size of a bundle.

Defined cases: a null text counts as empty (size 1, CRC 0) and groups with empty
texts; repeated rows are separate rows of one group; ties are broken by item
key, so the result does not depend on partitioning; an empty table gives none;
extra columns are ignored; a group over its fair share gets a shard in which
little or nothing else lies.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._rank import with_slots
from ._store import Scratch

ITEMS = 1 << 14
SLOT_BUCKETS = 1024
#: Rows of a file that are numbered together, where slots follow the stored order.
ORDERED_ROWS = 1 << 16


def differencing(sizes: Iterable[int], shards: int) -> list[int]:
    """The shard of each size, shards numbered by falling sum."""
    heap = []
    for i, size in enumerate(sizes):
        sums = [(size, [i])] + [(0, [])] * (shards - 1)
        heap.append((-size if shards > 1 else 0, i, sums))
    if not heap:
        return []
    count = len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, second, b = heapq.heappop(heap)
        joined = []
        for (x, p), (y, q) in zip(a, reversed(b), strict=True):
            if p and q:
                if len(p) < len(q):
                    p, q = q, p
                p.extend(q)
            joined.append((x + y, p or q))
        joined.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], min(first, second), joined))
    label = [0] * count
    for shard, (_, members) in enumerate(heap[0][2]):
        for i in members:
            label[i] = shard
    return label


def stored_order(docs: DataFrame) -> tuple[Column, Column]:
    """The file of a row and its place there, of docs read from files written in order."""
    return docs["_metadata.file_name"], docs["_metadata.row_index"]


def shard_documents(docs: DataFrame, shards: int = 16, items: int = ITEMS, ordered: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs; ordered: slots of a shard follow the order in which docs are stored (``stored_order``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
            F.sha2(text, 256).alias("_group"),
            *[c.alias(n) for c, n in zip(stored_order(docs) if ordered else (), ("_file", "_at"), strict=False)],
        ),
        "rows",
    )
    groups = scratch.keep(rows.groupBy("_group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("_group"), F.lit(items)).cast("string")
    groups = groups.withColumn("_item", F.when(F.col("bytes") * items > total, F.col("_group")).otherwise(bundle))
    sized = groups.groupBy("_item").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "_item").collect()  # at most 2 * items rows
    labels = differencing([r["bytes"] for r in sized], shards)
    schema = T.StructType([T.StructField("_item", T.StringType()), T.StructField("shard", T.IntegerType())])
    chosen = spark.createDataFrame([(r["_item"], s) for r, s in zip(sized, labels, strict=True)], schema)
    placed = groups.join(F.broadcast(chosen), "_item").select("_group", "shard")
    out = scratch.keep(rows.join(placed, "_group").select("doc_id", "size", "text_crc32", "shard", *(("_file", "_at") if ordered else ())), "placed")
    scratch.drop("rows")
    scratch.drop("groups")
    if ordered:
        stretch = F.struct("_file", F.floor(F.col("_at") / ORDERED_ROWS).alias("_stretch"))
        return with_slots(out, "shard", stretch, ["_at"]).drop("_file", "_at")
    return with_slots(out, "shard", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)), ["doc_id", "text_crc32"])
