"""Hard negatives by exact inner products, found through an orthogonal rotation.

The second moments of all vectors are summed in Spark. Their eigenvectors make an
orthogonal matrix Q, ordered by eigenvalue, and every vector is turned by it, so
that its leading components hold most of a product. For an anchor a and a row x,
with y = aQ and z = xQ and R the norm of what follows the first m components,

    |a.x - sum of the first m y_j z_j|  <=  R_m(y) R_m(z) + slack |a| |x|,

where slack covers how far Q is from orthogonal (measured) and all rounding: of d
components, each sum of d terms is off by at most d * 2**-52 of the norms' product.
Partial sums grow over a few stages; a pair leaves as soon as its bound falls short
of what its anchor needs. What is left is scored by integer products, so neither
rotation nor rounding decides a result.

Anchors are taken in blocks of a fixed size and sent to all tasks, which scan their
rows against them: nothing is shuffled but each task's best for an anchor. What an
anchor needs rises while a task goes on (its k-th best so far). The first scan finds
the positives, for each label apart; the second the negatives in the band that the
positives' scores give.

Components become floor(scale * x). Products are exact: in doubles while their sum
is below 2**53, else in whole numbers of any size, held within 64 bits at the end.

Defined cases: rows with a null id or label, a null vector, or a null, NaN or
infinite component take no part; shorter vectors are filled up with zeros; ties go
to the smaller id; rows equal in id, label and vector count once; rows with an
anchor's own id are neither its positives nor its negatives; rows of one id with
other vectors are rows and anchors of their own; an anchor without positives, and a
positive without rows in its band (as with a score below zero), give nothing; an
empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch
from .neighbours import _matrix

#: Numbers in a block of anchors (16 MB), rows scanned at a time, and anchors they meet at a time.
BLOCK_VALUES, ROWS, ANCHORS = 1 << 21, 4096, 256
#: Parts of the components after which pairs are judged.
STAGES = (0.125, 0.25, 0.5)
#: Above this share of pairs left, whole products are cheaper than picked ones.
DENSE = 0.125
LARGEST = (1 << 63) - 1


def whole_rows(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v: the rows that take part, as whole numbers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return rows.where(there & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).distinct()


def rotation(rows: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """Eigenvectors of the second moments of all rows, greatest first, and the slack for products of unit vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    found = rows.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((width, width))
    i, j = found["i"].to_numpy(), found["j"].to_numpy()
    total[i, j] = total[j, i] = found["s"].to_numpy()
    q = np.linalg.eigh(total / max(1.0, np.abs(total).max()))[1][:, ::-1]
    return np.ascontiguousarray(q), float(np.linalg.norm(q.T @ q - np.eye(width)) + 8 * width * width * np.finfo(float).eps)


class Turned:
    """Vectors with their rotated components and the norms of what follows each stage."""

    def __init__(self, v: np.ndarray, q: np.ndarray, cuts: list[int]):
        self.v, self.y = v, v @ q
        square = self.y**2
        self.norm = np.sqrt((v**2).sum(axis=1))
        self.rest = [np.sqrt(square[:, c:].sum(axis=1)) for c in cuts]

    def __getitem__(self, at) -> Turned:
        out = object.__new__(Turned)
        out.v, out.y, out.norm, out.rest = self.v[at], self.y[at], self.norm[at], [r[at] for r in self.rest]
        return out


def _exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of rows of a with the same rows of x."""
    if (np.abs(a).max(initial=0) + 1) * (np.abs(x).max(initial=0) + 1) * max(1, a.shape[1]) < 2**53:
        return np.einsum("ij,ij->i", a, x).astype(np.int64)
    found = [sum(int(p) * int(q) for p, q in zip(s, t, strict=True)) for s, t in zip(a, x, strict=True)]
    return np.array([min(max(f, -LARGEST), LARGEST) for f in found], np.int64)


def survivors(a: Turned, x: Turned, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, cuts: list[int], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a and x and integer products of the allowed pairs whose product lies between their anchor's low and high."""
    partial, alive, begin, pairs = np.zeros(allowed.shape), allowed, 0, None
    for stage, end in enumerate(cuts):
        if pairs is None:
            partial += a.y[:, begin:end] @ x.y[:, begin:end].T
            reach = np.outer(a.rest[stage], x.rest[stage]) + slack * np.outer(a.norm, x.norm)
            alive = alive & (partial + reach >= low[:, None]) & (partial - reach <= high[:, None])
            if np.count_nonzero(alive) <= DENSE * alive.size:
                pairs = np.nonzero(alive)
                sums = partial[pairs]
        else:
            i, j = pairs
            sums = sums + np.einsum("ij,ij->i", a.y[i, begin:end], x.y[j, begin:end])
            reach = a.rest[stage][i] * x.rest[stage][j] + slack * a.norm[i] * x.norm[j]
            left = (sums + reach >= low[i]) & (sums - reach <= high[i])
            pairs, sums = (i[left], j[left]), sums[left]
        begin = end
    small = (np.abs(a.v).max(initial=0) + 1) * (np.abs(x.v).max(initial=0) + 1) * max(1, a.v.shape[1]) < 2**53
    if pairs is None and small:
        i, j = np.nonzero(alive)
        scores = (a.v @ x.v.T)[i, j].astype(np.int64)
    else:
        i, j = np.nonzero(alive) if pairs is None else pairs
        step = 1 << 16
        scores = np.concatenate([np.zeros(0, np.int64), *(_exact(a.v[i[k : k + step]], x.v[j[k : k + step]]) for k in range(0, len(i), step))])
    fit = (scores >= low[i]) & (scores <= high[i])
    return i[fit], j[fit], scores[fit]


def first_k(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each key's k highest scores, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    start = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return order[rank < k]


class Best:
    """The k best (score, id) of each of n keys so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.key, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(key):
            key, score, ids = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.ids, ids)))
            at = first_k(key, score, ids, self.k)
            self.key, self.score, self.ids = key[at], score[at], ids[at]

    def needed(self) -> np.ndarray:
        """What a further score must reach: the k-th best, or anything while there are fewer."""
        out = np.full(self.n, -math.inf)
        last = np.flatnonzero(np.bincount(self.key, minlength=self.n) == self.k)
        if len(last):
            out[last] = self.score[np.searchsorted(self.key, last, side="right") - 1]
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(i, ROWS))
            rows += held[-1].num_rows
            if rows >= ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _positives(num: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, q: np.ndarray, cuts: list[int], slack: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Turned(v, q, cuts)
        own = {label: np.flatnonzero(labels == label) for label in np.unique(labels).tolist()}
        blocks = {(label, i): at[i : i + ANCHORS] for label, at in own.items() for i in range(0, len(at), ANCHORS)}
        best = {b: Best(len(at), k) for b, at in blocks.items()}
        for table in _chunks(batches):
            x_ids, x_labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
            rows = Turned(_matrix(table["v"], q.shape[0]), q, cuts)
            for label in np.unique(x_labels).tolist():
                at = np.flatnonzero(x_labels == label)
                x = rows[at]
                for i in range(0, len(own.get(label, ())), ANCHORS):
                    block, b = blocks[label, i], best[label, i]
                    low = b.needed()
                    p, r, score = survivors(anchors[block], x, ids[block][:, None] != x_ids[at][None, :], low, np.full(len(low), math.inf), cuts, slack)
                    b.add(p, score, x_ids[at][r])
        for name, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(num[blocks[name]][b.key]), pa.array(b.ids), pa.array(b.score)], ["num", "vec_id", "score"])

    return run


def _negatives(num: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, cuts: list[int], slack: float, k: int):
    """low, high: of each anchor (rows) and positive, the scores allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Turned(v, q, cuts)
        width = low.shape[1]
        blocks = [np.arange(i, min(i + ANCHORS, len(num))) for i in range(0, len(num), ANCHORS)]
        best = [Best(len(at) * width, k) for at in blocks]
        for table in _chunks(batches):
            x_ids, x_labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
            rows = Turned(_matrix(table["v"], q.shape[0]), q, cuts)
            for block, b in zip(blocks, best, strict=True):
                least = np.maximum(low[block], b.needed().reshape(len(block), width))
                allowed = (ids[block][:, None] != x_ids[None, :]) & (labels[block][:, None] != x_labels[None, :])
                p, r, score = survivors(anchors[block], rows, allowed, least.min(axis=1), high[block].max(axis=1), cuts, slack)
                fit = (score[:, None] >= least[p]) & (score[:, None] <= high[block][p])
                at, place = np.nonzero(fit)
                b.add(p[at] * width + place, score[at], x_ids[r[at]])
        for block, b in zip(blocks, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(num[block][b.key // width]), pa.array((b.key % width).astype(np.int32)), pa.array(b.ids), pa.array(b.score)], ["num", "place", "negative_id", "negative_score"])

    return run


def hard_negatives(data: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, block_values: int = BLOCK_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    data: vec_id, embedding, label (whole numbers); anchor: which of its rows are anchors,
    by those columns. A negative's score is from least to most hundredths of the positive's.
    """
    spark = data.sparkSession
    scratch = Scratch(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    marked = data.where(F.coalesce(anchor, F.lit(False)))
    rows = scratch.keep(whole_rows(data, scale), "rows")
    chosen = scratch.keep(whole_rows(marked, scale).withColumn("num", F.monotonically_increasing_id()), "anchors")
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    n = chosen.count()
    if not width or not n:
        scratch.drop()
        return spark.createDataFrame([], schema)
    q, slack = rotation(rows, width)
    cuts = sorted({max(1, round(width * s)) for s in STAGES})
    count = max(1, -(-n * width // block_values))
    block = F.pmod(F.xxhash64("num"), F.lit(count))
    found = []
    for i in range(count):
        part = chosen.where(block == i).select("num", "vec_id", "label", "v").toArrow()  # about block_values numbers
        num, ids, labels = (part[c].to_numpy() for c in ("num", "vec_id", "label"))
        v = _matrix(part["v"], width)
        best = rows.mapInArrow(_positives(num, ids, labels, v, q, cuts, slack, positives), "num bigint, vec_id bigint, score bigint")
        ranked = Window.partitionBy("num").orderBy(F.desc("score"), "vec_id")
        kept = best.withColumn("place", F.row_number().over(ranked) - 1).where(F.col("place") < positives).toArrow()  # positives for each anchor of the block
        row = np.argsort(num)[np.searchsorted(np.sort(num), kept["num"].to_numpy())]
        place, score = kept["place"].to_numpy(), kept["score"].to_numpy()
        low, high = np.full((len(num), positives), math.inf), np.full((len(num), positives), -math.inf)
        low[row, place] = [-(-least * s // 100) for s in score.tolist()]
        high[row, place] = [most * s // 100 for s in score.tolist()]
        empty = low > high
        low[empty], high[empty] = math.inf, -math.inf
        of = spark.createDataFrame(
            pa.table([pa.array(num[row]), pa.array(place.astype(np.int32)), pa.array(ids[row]), kept["vec_id"].combine_chunks(), pa.array(score)], ["num", "place", "anchor_id", "positive_id", "positive_score"])
        )
        inside = rows.mapInArrow(_negatives(num, ids, labels, v, low, high, q, cuts, slack, negatives), "num bigint, place int, negative_id bigint, negative_score bigint")
        ranked = Window.partitionBy("num", "place").orderBy(F.desc("negative_score"), "negative_id")
        top = inside.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
        scratch.keep(top.join(of, ["num", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"), f"found/block={i}")
        found.append(scratch.path(f"found/block={i}"))
    for name in ("rows", "anchors"):
        scratch.drop(name)
    return spark.read.schema(schema).parquet(*found)
