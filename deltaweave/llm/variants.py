"""Spelling variants: words at distance one, by a trie self-join with active nodes.

Words are counted over all documents. Each is then put under keys, such that two
words at distance one share at least one: with L the shorter of the two lengths
and h = L // 2, they agree in their first h code points or in their last L - h. A
word of length L therefore has a head and a tail key for L and for L - 1. Keys
deal the vocabulary to partitions, and so the trie below every key's head (or
above its tail) stands whole in one task.

In a task the words of a key, without what the key fixes, make a trie. Every node
v has as active nodes all nodes u whose strings are at distance one from its own
(v itself is at distance zero). They come from those of the parent alone:

* siblings differ in their last code point; a node's parent lacks it;
* children of v and u by the same code point are as far apart as v and u.

Levels are numpy arrays: nodes sorted by (parent, code point), and pairs of active
nodes at one depth and at neighbouring depths. Since being active is symmetric, a
pair stands once. Pairs with words at both nodes are the result.

A key with more than GROUP code points of words is split: the edit lies in the
first or second half of what the key leaves open, so a longer head or a longer
tail is shared too. Where at most one code point is left open, no more words than
the alphabet's square can share the key.

Defined cases: a null text has no words; a null doc_id counts as the text '';
repeated rows count each; equal counts go to the smaller word in code-point order;
an empty table gives no words; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: One run in so many loses a code point, by its checksum, before it is counted.
TYPO_EVERY = 199
GROUP = 1 << 20
#: Cells of a task's matrix of words.
CELLS = 1 << 21

KEY = ["base", "a", "b", "head", "tail"]
KEYED = "base int, a int, b int, head string, tail string, word string, n bigint"


def counted(docs: DataFrame, typo_every: int | None = TYPO_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n over whole texts; with typo_every, runs that this divides the checksum of lose a code point."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(id_text.alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    runs = runs.select("id", F.translate("run", upper, lower).alias("word"))
    if typo_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _key(base: Column, a: Column, b: Column) -> Column:
    head, tail = F.substring("word", F.lit(1), a), F.when(b > 0, F.substring("word", F.length("word") - b + 1, b)).otherwise("")
    return F.struct(base.alias("base"), a.alias("a"), b.alias("b"), head.alias("head"), tail.alias("tail"))


def keyed(words: DataFrame) -> DataFrame:
    """Each word under its head and tail keys for its own length and the next smaller one."""
    zero, found = F.lit(0), []
    for less in (0, 1):
        base = F.length("word") - less
        half = F.floor(base / 2).cast("int")
        found += [_key(base, half, zero), _key(base, zero, base - half)]
    return words.select(F.explode(F.array(*found)).alias("k"), "word", "n").select("k.*", "word", "n")


def split(rows: DataFrame) -> DataFrame:
    """Words of keys with more than one code point left open, under a longer head and under a longer tail."""
    base, a, b = F.col("base"), F.col("a"), F.col("b")
    middle = a + F.floor((base - a - b) / 2).cast("int")
    return rows.select(F.explode(F.array(_key(base, middle, b), _key(base, a, base - middle))).alias("k"), "word", "n").select("k.*", "word", "n")


class Level:
    """Nodes of a trie at one depth, sorted by (parent, code point)."""

    def __init__(self, parent: np.ndarray, symbol: np.ndarray, word: np.ndarray):
        self.parent, self.symbol, self.word = parent, symbol, word
        self.keys = parent * 256 + symbol

    def __len__(self) -> int:
        return len(self.parent)


def levels(group: np.ndarray, codes: np.ndarray, length: np.ndarray) -> list[Level]:
    """The trie of the rows of codes (padded with 0; sorted by group, then row), one root for each group."""
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] != group[:-1]
    node = np.cumsum(fresh) - 1  # of each row, at the depth reached
    none = np.full(int(fresh.sum()), -1)
    none[node[length == 0]] = np.flatnonzero(length == 0)
    out = [Level(np.arange(len(none)), np.zeros(len(none), np.int64), none)]
    for depth in range(1, codes.shape[1] + 1):
        symbol = codes[:, depth - 1].astype(np.int64)
        fresh[1:] |= symbol[1:] != symbol[:-1]
        rows = np.flatnonzero(length >= depth)
        if not len(rows):
            break
        first = fresh[rows]
        first[0] = True
        heads = rows[first]
        own = np.cumsum(first) - 1
        word = np.full(len(heads), -1)
        ends = length[rows] == depth
        word[own[ends]] = rows[ends]
        out.append(Level(node[heads], symbol[heads], word))
        node = np.full(len(group), -1)
        node[rows] = own
    return out


def _siblings(level: Level) -> tuple[np.ndarray, np.ndarray]:
    left, right, step = [], [], 1
    while True:
        i = np.flatnonzero(level.parent[step:] == level.parent[:-step]) if step < len(level) else np.zeros(0, np.int64)
        if not len(i):
            break
        left.append(i)
        right.append(i + step)
        step += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def _step(v: np.ndarray, u: np.ndarray, of_v: Level, of_u: Level) -> tuple[np.ndarray, np.ndarray]:
    """Children of v and u by the same code point; of_v and of_u are the levels of the children."""
    first, last = np.searchsorted(of_v.parent, v), np.searchsorted(of_v.parent, v, side="right")
    times = last - first
    child = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    wanted = np.repeat(u, times) * 256 + of_v.symbol[child]
    at = np.minimum(np.searchsorted(of_u.keys, wanted), len(of_u) - 1)
    met = of_u.keys[at] == wanted if len(of_u) else np.zeros(0, bool)
    return child[met], at[met]


def near_rows(group: np.ndarray, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group at distance exactly one, each once; rows as for ``levels`` and distinct."""
    none = np.zeros(0, np.int64)
    trie = levels(group, codes, length)
    same, below = (none, none), (none, none)  # active pairs (v, u): u at v's depth, and u one less deep
    found: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
    for above, here in zip(trie, trie[1:], strict=False):
        met = _step(*same, here, here)
        beside = _siblings(here)
        same = np.concatenate([met[0], beside[0]]), np.concatenate([met[1], beside[1]])
        shorter = _step(*below, here, above)
        v, u = np.concatenate([shorter[0], np.arange(len(here))]), np.concatenate([shorter[1], here.parent])
        once = np.unique(v * np.int64(len(above)) + u)
        below = once // len(above), once % len(above)
        for (v, u), other in ((same, here), (below, above)):
            x, y = here.word[v], other.word[u]
            both = (x >= 0) & (y >= 0)
            found.append((x[both], y[both]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words near each other, both ways, of rows sorted by key, whose keys are whole in this partition."""
    held, cells = [], 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        word = [w.encode("latin-1") for w in table["word"].to_pylist()]
        n = table["n"].to_numpy()
        base, a, b = (table[c].to_numpy().astype(np.int64) for c in ("base", "a", "b"))
        size = np.array([len(w) for w in word])
        middle = [w[i : s - j] for w, i, s, j in zip(word, a.tolist(), size.tolist(), b.tolist(), strict=True)]
        length = size - a - b
        codes = np.zeros((len(word), max(1, int(length.max()))), np.uint8)
        codes[np.arange(codes.shape[1]) < length[:, None]] = np.frombuffer(b"".join(middle), np.uint8)
        group = np.cumsum(_fresh(table)) - 1
        order = np.lexsort((*codes.T[::-1], group))
        x, y = near_rows(group[order], codes[order], length[order])
        x, y = order[x], order[y]
        use = np.minimum(size[x], size[y]) == base[x]  # longer pairs belong to the next base
        x, y = np.concatenate([x[use], y[use]]), np.concatenate([y[use], x[use]])
        words = table["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([words.take(pa.array(x)), words.take(pa.array(y)), pa.array(n[y])], ["word", "near", "near_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cells += batch.num_rows * (int(max((batch["base"].to_numpy() - batch["a"].to_numpy() - batch["b"].to_numpy()).max(), 0)) + 1)
        if cells > CELLS:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_fresh(table))[-1])  # the last key may go on
            if last:
                yield flush(table.slice(0, last))
                table = table.slice(last)
            held, cells = table.to_batches(), 0
    if held:
        yield flush(pa.Table.from_batches(held))


def _fresh(table: pa.Table) -> np.ndarray:
    """Where a row's key differs from that of the row before."""
    out = np.zeros(table.num_rows, bool)
    out[0] = True
    for c in KEY:
        column = table[c].combine_chunks()
        out[1:] |= ~pa.compute.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def near_pairs(words: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """word, near, near_n: all ordered pairs of distinct words (word, n; code points up to U+00FF) at distance one."""
    rows, parts, round_ = scratch.keep(keyed(words), "keys0"), [], 0
    while True:
        sizes = rows.groupBy(*KEY).agg(F.sum(F.length("word")).alias("size"))
        large = scratch.keep(sizes.where((F.col("size") > group) & (F.col("base") - F.col("a") - F.col("b") > 1)).drop("size"), f"large{round_}")
        parts.append(rows.join(large, KEY, "left_anti"))
        if large.isEmpty():
            break
        round_ += 1
        rows = scratch.keep(split(rows.join(large, KEY, "left_semi")), f"keys{round_}")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.select("base", "a", "b", "head", "tail", "word", "n").repartition(partitions, *KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(_pairs, "word string, near string, near_n bigint").distinct()


def variants(words: DataFrame, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (word, n)."""
    spark = words.sparkSession
    scratch = Scratch(spark, "variants")
    words = scratch.keep(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(words, scratch, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(told, F.col("best.near")).alias("form"), F.when(told, -F.col("best.less")).alias("form_n"),
    )
    found = scratch.keep(found, "found")
    most = found.agg(F.max("form_n")).first()[0]
    # Counts grow by the factor with each form, which bounds how many follow each other; each round doubles the steps taken.
    steps = 1 + int(math.log(most, max(factor, 1.5))) if most else 0
    ways = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for i in range(max(0, steps.bit_length())):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = scratch.keep(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"ways{i}")
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
