"""Exact top-k inner products by a Voronoi join.

Pivots cut the space into cells, and queries and data are both put into the cell
of their nearest pivot. From small summaries of the cells come bounds:

* of data, every cell gives up to SEEDS rows. The k-th best score of a query among
  these is a score that it reaches for certain; the least of a query cell is what
  any row must be able to reach there;
* of queries, every cell has its radius u around its pivot p. No query in it has a
  larger inner product with a row x than p.x + u |x|.

Query cells are merged with near ones to groups of about QUERIES queries; larger
cells are split. A data row is replicated only to the groups with a cell whose
bound it can reach, and is solved there. Rows of a group are dealt to chunks by
their counted number, so a task holds one block of queries and one chunk of rows.

Of equal vectors only the k + 1 smallest ids can be among k neighbours, so the
others are left out before the join, which makes nothing of a vector that fills a
third of the table. On the driver, and sent to tasks, are the pivots, seeds and
summaries: at most MOST_PIVOTS * (SEEDS + 1) vectors.

Components become floor(scale * x). Products are exact: in doubles while the
bound of the sum is below 2**53, else in 64-bit integers.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, as query or candidate; shorter vectors are filled up with zeros;
ties go to the smaller id; rows with the query's own id are never its
neighbours; rows equal in id and vector count once; rows of one id with other
vectors are rows of their own, and as queries each has its own ranks; fewer than
k candidates are all returned; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

CHUNK, QUERIES, MOST_PIVOTS, SEEDS = 8192, 4096, 1024, 16


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as whole numbers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = (np.abs(q).max(initial=0) + 1) * (np.abs(x).max(initial=0) + 1) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and score of each query's k best of x that score at least ``least``, own id excepted."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(q), 256):
        scores = products(q[i : i + 256], x)
        fit = (scores >= least[i : i + 256, None]) & (ids[None, :] != q_ids[i : i + 256, None])
        for row in np.flatnonzero(fit.any(axis=1)):
            at = np.flatnonzero(fit[row])
            top = at[np.argsort(-scores[row, at], kind="stable")[:k]]
            out.append((np.full(len(top), i + row), ids[top], scores[row, top]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def merged(centres: np.ndarray, sizes: np.ndarray, most: int) -> list[list[int]]:
    """Cells with queries in groups of near ones: each starts with a cell and takes the nearest left over up to ``most`` queries."""
    left, out = [int(i) for i in np.flatnonzero(sizes)], []
    while left:
        start = left[0]
        near = sorted(left, key=lambda i: (((centres[i] - centres[start]) ** 2).sum(), i))
        group, total = [start], int(sizes[start])
        for i in near:
            if i != start and total + sizes[i] <= most:
                group.append(i)
                total += int(sizes[i])
        out.append(group)
        taken = set(group)
        left = [i for i in left if i not in taken]
    return out


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, most_pivots: int = MOST_PIVOTS, chunk: int = CHUNK, most_queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score; data and queries have vec_id, embedding."""
    spark = data.sparkSession
    scratch = Scratch(spark, "neighbours")
    least_ids = Window.partitionBy("v").orderBy("vec_id")
    rows = whole_vectors(data, scale).distinct().withColumn("n", F.row_number().over(least_ids)).where(F.col("n") <= k + 1).drop("n")
    rows = scratch.keep(rows, "rows")
    asked = scratch.keep(whole_vectors(queries, scale).distinct().withColumn("num", F.monotonically_increasing_id()), "queries")
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries, q_width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width, q_width)
    if not count or not n_queries:
        scratch.drop()
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    n_pivots = max(1, min(most_pivots, int(math.sqrt(count) / 2)))
    # A vector has at most k + 1 rows here, so so many rows hold enough different ones; only the best are sent.
    picked = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(n_pivots * (k + 1)).toArrow()
    pivots = np.unique(_matrix(picked.column(0), width), axis=0)
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))[:n_pivots]]
    half = (pivots**2).sum(axis=1) / 2

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance from its pivot."""
        cell = np.argmax(x @ pivots.T - half, axis=1)
        return cell.astype(np.int32), np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _ = nearest(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["vec_id", "v", "cell"])

    # Summary of data: some rows of every cell, the longest, which have the largest products.
    placed = rows.mapInArrow(assign, "vec_id bigint, v array<double>, cell int")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    in_cell = Window.partitionBy("cell").orderBy(F.desc(norm), "vec_id", "v")
    picked = placed.withColumn("n", F.row_number().over(in_cell)).where(F.col("n") <= max(SEEDS, k + 1)).select("vec_id", "v").toArrow()
    seed_ids, seeds = picked.column(0).to_numpy(), _matrix(picked.column(1), width)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The score that each query reaches for certain."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            q = _matrix(batch.column(1), width)
            cell, far = nearest(q)
            least = np.full(len(q), -math.inf)
            for i in range(0, len(q), 256):
                scores = np.where(seed_ids[None, :] == ids[i : i + 256, None], -math.inf, products(q[i : i + 256], seeds).astype(float))
                if len(seeds) >= k:
                    least[i : i + 256] = np.partition(scores, -k, axis=1)[:, -k]
            least -= np.abs(least) * 1e-12  # beyond 2**53 a double may lie above the product
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(1), pa.array(cell), pa.array(far), pa.array(least)], ["num", "query_id", "q", "cell", "far", "least"])

    bounded = scratch.keep(asked.select("vec_id", "v", "num").mapInArrow(bound, "num bigint, query_id bigint, q array<double>, cell int, far double, least double"), "bounded")
    summary = bounded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("u"), F.min("least").alias("least")).toArrow()  # a row for each pivot
    at = summary["cell"].to_numpy()
    sizes, reach, floor = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.full(len(pivots), math.inf)
    sizes[at], reach[at], floor[at] = summary["n"].to_numpy(), summary["u"].to_numpy(), summary["least"].to_numpy()
    groups = merged(pivots, sizes, most_queries)
    group_of = np.zeros(len(pivots), np.int32)
    for g, cells in enumerate(groups):
        group_of[cells] = g
    blocks = np.array([max(1, -(-int(sizes[cells].sum()) // most_queries)) for cells in groups])

    def needed(x: np.ndarray) -> np.ndarray:
        """Which groups may need each row."""
        top = x @ pivots.T + np.sqrt((x**2).sum(axis=1))[:, None] * reach
        may = (sizes > 0) & (top * (1 + 1e-9 * np.sign(top)) + 1e-6 >= floor)
        return np.stack([may[:, cells].any(axis=1) for cells in groups], axis=1)

    def demand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups), np.int64)
        for batch in batches:
            total += needed(_matrix(batch.column(0), width)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(groups), dtype=np.int32)), pa.array(total)], ["group", "n"])

    wanted = np.zeros(len(groups), np.int64)
    for r in rows.select("v").mapInArrow(demand, "group int, n bigint").groupBy("group").agg(F.sum("n").alias("n")).collect():
        wanted[r["group"]] = r["n"]
    chunks = np.maximum(1, -(-wanted // chunk))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to the groups that may need it, there to one chunk and to every block of queries."""
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                row, group = np.nonzero(needed(_matrix(part.column(1), width)))
                deal = part.column(2).to_numpy(zero_copy_only=False)[row] % chunks[group]
                times = blocks[group]
                row, group, deal = np.repeat(row, times), np.repeat(group, times), np.repeat(deal, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(deal.astype(np.int32)), part.column(0).take(take), part.column(1).take(take)],
                    ["group", "block", "chunk", "vec_id", "v"],
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to its block, there to every chunk."""
        for batch in batches:
            group = group_of[batch.column(3).to_numpy(zero_copy_only=False)]
            block = batch.column(5).to_numpy(zero_copy_only=False) % blocks[group]
            times = chunks[group]
            row = np.repeat(np.arange(batch.num_rows), times)
            deal = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[row].astype(np.int32)), pa.array(block[row].astype(np.int32)), pa.array(deal.astype(np.int32)), *[batch.column(i).take(take) for i in (0, 1, 2, 4)]],
                ["group", "block", "chunk", "num", "query_id", "q", "least"],
            )

    def solve(found: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(found) or not len(sent):
            return pa.table([pa.array([], pa.int64())] * 4, ["num", "query_id", "vec_id", "score"])
        q_ids = sent["query_id"].to_numpy()
        at, ids, scores = best(q_ids, _matrix(sent["q"], width), sent["least"].to_numpy(), found["vec_id"].to_numpy(), _matrix(found["v"], width), k)
        return pa.table([sent["num"].take(pa.array(at)), sent["query_id"].take(pa.array(at)), pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.int64))], ["num", "query_id", "vec_id", "score"])

    key = ["group", "block", "chunk"]
    deal = F.xxhash64("vec_id", "v").bitwiseAND((1 << 62) - 1)
    dealt = rows.select("vec_id", "v", deal.alias("deal")).mapInArrow(replicate, "group int, block int, chunk int, vec_id bigint, v array<double>")
    number = F.xxhash64("num").bitwiseAND((1 << 62) - 1)
    sent = bounded.select("num", "query_id", "q", "cell", "least", number.alias("deal")).mapInArrow(spread, "group int, block int, chunk int, num bigint, query_id bigint, q array<double>, least double")
    solved = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, "num bigint, query_id bigint, vec_id bigint, score bigint")
    solved = scratch.keep(solved, "solved")
    for name in ("rows", "queries", "bounded"):
        scratch.drop(name)
    ranked = Window.partitionBy("num").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
