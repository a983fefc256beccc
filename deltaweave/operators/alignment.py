"""Matching the elements of two revisions at least total cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.tags import match_group
from . import sparse

#: Pairs of a bucket from which on it is solved without the matrix of all costs.
SPARSE_FROM = 1 << 16
BUCKET = ["pair_id", "sheet", "bucket"]


def sheet_match(sheets_a: DataFrame, sheets_b: DataFrame) -> DataFrame:
    """pair_id, sheet, in_a, in_b."""
    return (
        sheets_a.select("pair_id", "sheet", F.lit(True).alias("in_a"))
        .join(sheets_b.select("pair_id", "sheet", F.lit(True).alias("in_b")), ["pair_id", "sheet"], "full_outer")
        .select("pair_id", "sheet", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
    )


def with_bucket(elements: DataFrame) -> DataFrame:
    """Elements only match within a bucket: their group of types, and for geometry the kind of shape."""
    return elements.withColumn("bucket", F.when(F.col("type") == "geometry", F.concat(F.lit("geometry:"), F.coalesce("geom_kind", F.lit("?")))).otherwise(match_group(F.col("type"))))


def solve_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least total cost, by shortest augmenting paths with potentials."""
    if cost.size == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if cost.shape[0] > cost.shape[1]:
        cols, rows = solve_assignment(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        least, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, last = row, -1
        tree_rows, tree_cols, total = [row], [], 0.0
        while True:
            slack = total + cost[i] - u[i] - v
            better = ~done & (slack < least)
            least[better], via[better] = slack[better], last
            open_ = np.where(done, np.inf, least)
            j = int(np.argmin(open_))
            total = open_[j]
            done[j] = True
            if owner[j] < 0:
                break
            tree_cols.append(j)
            last, i = j, owner[j]
            tree_rows.append(i)
        u[tree_rows[0]] += total
        for r, c in zip(tree_rows[1:], tree_cols, strict=True):
            u[r] += total - least[c]
            v[c] -= total - least[c]
        while True:
            back = via[j]
            owner[j] = row if back < 0 else owner[back]
            if back < 0:
                break
            j = back
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


def lcs(a: str, b: str) -> int:
    """Longest common subsequence by one big integer, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    s, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = s & where.get(ch, 0)
        s = ((s + hit) | (s - hit)) & full
    return len(a) - s.bit_count()


def similarity(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))


def similarity_column():
    """similarity as a function of two columns; every distinct pair of a batch is compared once."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in seen:
                seen[pair] = similarity(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype=float)

    return of


MATCH = "pair_id long, sheet int, bucket string, ord_a int, ord_b int, cost double, margin double, near_miss double"


def match_elements(a: DataFrame, b: DataFrame, transforms: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row for each match and each element left over (MATCH).

    a and b have BUCKET, ord, content, x, y (box centres). The assignment covers a
    whole bucket; only then are matches over ``max_cost`` undone. A match's margin
    is how much dearer the best other partner of either side would have been. An
    element left over has its least cost in the bucket, null if there was no partner.

    Pools are sorted by (y, x, ord), so equal optima are broken the same way each
    time. A task holds one sheet; its memory grows with the elements of a bucket, not
    with their pairs (see ``sparse``). The work is split over (pair, sheet).
    """
    moved = b.join(transforms, "pair_id", "left").withColumn("_c", F.coalesce("scale", F.lit(1.0)) * F.cos(F.coalesce("rotation", F.lit(0.0)))).withColumn(
        "_s", F.coalesce("scale", F.lit(1.0)) * F.sin(F.coalesce("rotation", F.lit(0.0)))
    )
    moved = moved.select(*BUCKET, "ord", "content", (F.col("_c") * F.col("x") - F.col("_s") * F.col("y") + F.coalesce("tx", F.lit(0.0))).alias("x"), (F.col("_s") * F.col("x") + F.col("_c") * F.col("y") + F.coalesce("ty", F.lit(0.0))).alias("y"))

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """All buckets of one sheet."""
        sides = [{}, {}]
        for side, table in zip(sides, (left, right), strict=True):
            bucket, order = table["bucket"].to_pylist(), np.lexsort([table[c].to_numpy() for c in ("ord", "x", "y")])
            columns = table["ord"].to_numpy(), table["content"].to_pylist(), table["x"].to_numpy(), table["y"].to_numpy()
            for i in order.tolist():
                side.setdefault(bucket[i], []).append((int(columns[0][i]), columns[1][i] or "", columns[2][i], columns[3][i]))
        out = []
        for bucket in sorted({*sides[0], *sides[1]}):
            a, b = (side.get(bucket, []) for side in sides)
            out += [(key[0].as_py(), key[1].as_py(), bucket, *row) for row in _solve_bucket(a, b, s)]
        columns = zip(*out, strict=True) if out else [[]] * 8
        return pa.table([pa.array(c, t) for c, t in zip(columns, _MATCH_TYPES, strict=True)], [x.split()[0] for x in MATCH.split(", ")])

    keep = [*BUCKET, "ord", "content", "x", "y"]
    # Both sides may come from one table; new names keep their columns apart.
    left = a.select(*[F.col(c).alias(c) for c in keep]).alias("a")
    right = moved.select(*[F.col(c).alias(c) for c in keep]).alias("b")
    sheet = BUCKET[:2]
    return left.groupBy(*[F.col(f"a.{c}") for c in sheet]).cogroup(right.groupBy(*[F.col(f"b.{c}") for c in sheet])).applyInArrow(solve, MATCH)


_MATCH_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]


def _solve_bucket(a: list, b: list, s: Settings) -> list[tuple]:
    """ord_a, ord_b, cost, margin, near_miss for two lists of (ord, content, x, y); from SPARSE_FROM pairs on without a matrix of all costs."""
    if not a or not b:
        return [(x[0], None, None, None, None) for x in a] + [(None, x[0], None, None, None) for x in b]
    costs = sparse.Costs(a, b, similarity, (s.text_weight, s.space_weight))
    if len(a) * len(b) < SPARSE_FROM:
        every = np.arange(len(b))
        cost = np.array([costs.of(i, every) for i in range(len(a))])
        order = [np.argsort(c, axis=1, kind="stable")[:, :2] for c in (cost, cost.T)]
        best = [(at, np.take_along_axis(c, at, axis=1)) for at, c in zip(order, (cost, cost.T), strict=True)]
        rows, cols = solve_assignment(cost)
    else:
        best = [sparse.cheapest(costs, 2), sparse.cheapest(costs.flipped(), 2)]
        rows, cols = sparse.assignment(costs, *best)
    chosen = np.array([costs.of(i, np.array([j]))[0] for i, j in zip(rows.tolist(), cols.tolist(), strict=True)])
    good = chosen <= s.max_cost
    out = []
    for i, j, c in zip(rows[good].tolist(), cols[good].tolist(), chosen[good].tolist(), strict=True):
        # The cheapest pair of either but this one.
        other = [float(least[at][k]) for (columns, least), at, mate in ((best[0], i, j), (best[1], j, i)) for k in range(columns.shape[1]) if columns[at][k] != mate]
        out.append((a[i][0], b[j][0], c, min(other) - c if other else None, None))
    out += [(a[i][0], None, None, None, float(best[0][1][i, 0])) for i in sorted(set(range(len(a))) - set(rows[good].tolist()))]
    return out + [(None, b[j][0], None, None, float(best[1][1][j, 0])) for j in sorted(set(range(len(b))) - set(cols[good].tolist()))]


def candidate_costs(a: DataFrame, b: DataFrame, similarity_of, s: Settings = DEFAULT) -> DataFrame:
    """Every pair within a bucket with its cost; ``similarity_of(content_a, content_b)`` makes the text part."""
    left = a.select(*BUCKET, F.col("ord").alias("ord_a"), F.col("content").alias("content_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    right = b.select(*BUCKET, F.col("ord").alias("ord_b"), F.col("content").alias("content_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    far = F.sqrt((F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")))
    return left.join(right, BUCKET).withColumn("cost", s.text_weight * (1 - similarity_of(F.col("content_a"), F.col("content_b"))) + s.space_weight * far)


def margins(costs: DataFrame, chosen: DataFrame) -> DataFrame:
    """BUCKET, ord_a, ord_b, cost, margin of chosen(BUCKET, ord_a, ord_b): the two least costs of each row and column tell."""
    picked = costs.join(chosen.withColumn("_picked", F.lit(True)), [*BUCKET, "ord_a", "ord_b"], "left").withColumn("_other", F.when(F.col("_picked").isNull(), F.col("cost")))
    row, column = Window.partitionBy(*BUCKET, "ord_a"), Window.partitionBy(*BUCKET, "ord_b")
    other = F.least(F.min("_other").over(row), F.min("_other").over(column))
    return picked.withColumn("margin", other - F.col("cost")).where("_picked").select(*BUCKET, "ord_a", "ord_b", "cost", "margin")


def near_misses(costs: DataFrame, chosen: DataFrame) -> DataFrame:
    """BUCKET, side, ord, near_miss for elements that had candidates but no match."""
    def side(name: str, column: str) -> DataFrame:
        least = costs.groupBy(*BUCKET, column).agg(F.min("cost").alias("near_miss"))
        return least.join(chosen, [*BUCKET, column], "left_anti").select(*BUCKET, F.lit(name).alias("side"), F.col(column).alias("ord"), "near_miss")

    return side("A", "ord_a").unionByName(side("B", "ord_b"))
