"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words, with A-Z lower-cased, and one end. The root holds the
unigram distribution over all V training tokens and one symbol for any unknown
word, whose mass is the share of tokens seen once (Good-Turing). A context of up
to DEPTH words (an end stands before the first word) is considered once it was
seen LEAST_STATE times; its listed nexts are those seen LEAST_ENTRY times after
it. It becomes a state if its next-symbol distribution, weighed by what it saw,
diverges from that of its longest kept proper suffix by more than DIVERGENCE
nats a token. A state's distribution is

    P(x | s) = (c(s, x) - DISCOUNT) / n(s)  [if x is listed]  +  rest(s) * P(x | parent(s))

where parent(s) is the longest kept proper suffix and rest(s) makes the sum one.
Each token is scored by the longest kept suffix of what precedes it in its text.

All thresholds are counts, so what is kept of a text does not shrink as the
corpus grows, and the tree is a table that grows with the corpus. It is learned
with joins and never gathered. What tasks get of it:

* filters of at most 16 MB that let through every key of a table (and a few more,
  which the joins that follow leave out; all keys, where a table has over 2**26): a sequence is counted only if that
  without its last token may be a context and that without its first was listed,
  since it cannot be seen more often than either;
* the HEAD_WORDS words and HEAD_TERMS terms seen most, which are looked up in
  place. All others are looked up where their keys are: a block of texts sends each
  bucket of keys one packed row of what it seeks there, and gets back the sums of
  its texts. Where the cut lies does not change a result.

Scores need no token-level join, because log P(x | s) is a sum: log P(x | root),
and for every kept suffix t of the context log rest(t) and, if x is listed there,

    gain(t, x) = log P(x | t) - log(rest(t) * P(x | parent(t))).

So a tree is a table of terms, each a key (a state's or a next's) with a number to
add, and a text's score adds up what its keys find.

Tokens and word sequences are identified by 64-bit hashes: among n distinct ones
n * n / 2**65 collisions are expected, which is one at six billion.

Defined cases: null and empty texts are one end; a null doc_id counts as the text
''; repeated rows are scored each and count each in training; with no training
rows every word is unknown and has probability one; an empty table gives none;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import Bits, HashTable, cut_batch, hash_text, mix, small_batches, tokens

DEPTH = 3
LEAST_STATE, LEAST_ENTRY = 20, 2
DISCOUNT, DIVERGENCE = 0.5, 0.02
#: What is looked up in place: memory only, never a result. It is no more than a part of all, so that look-ups of the others are a like share of a small corpus.
HEAD_WORDS, HEAD_TERMS, HEAD_SHARE = 1 << 18, 1 << 20, 8
#: The end holds a space, which no word does.
END = hash_text(b" end")
#: Sets the keys of states apart from those of sequences.
STATE_KEY = 0x3C6EF372FE94F82B
BLOCK_TOKENS = 1 << 21
#: Texts are scored so many bytes at a time, since every token may leave several keys to look up.
SCORED_BYTES = 1 << 20
#: Pairs of words are counted in so many passes, by the second word, so that their shuffle takes less disk at a time.
PARTS = 2
#: Texts are scored in so many passes, for the same reason; in more where there are too many terms for a filter.
PASSES, UNFILTERED_PASSES = 3, 12
#: What is not looked up in place is dealt to buckets of keys, each for so many tokens of training; there are a few at least.
BUCKET_TOKENS, LEAST_BUCKETS = 1 << 19, 64
#: Keys are sought a block of texts at a time, which numbers its texts with 16 bits.
BLOCK_SOUGHT, MOST_TEXTS = 1 << 20, 1 << 16


def held_out(doc_id: Column, remainder: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == remainder


def sequences(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end before and after each text's words, and where each text starts (n + 1 entries)."""
    words, first = tokens(column, lower=True)
    n = len(first) - 1
    starts = first + 2 * np.arange(n + 1)
    out = np.full(len(words) + 2 * n, END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[starts[:-1]] = False
    is_word[starts[1:] - 1] = False
    out[is_word] = words
    return out, starts


def grams(hashes: np.ndarray, most: int) -> list[np.ndarray]:
    """For k = 1..most, a key of the k tokens that end at each place (of no use where the text has fewer)."""
    out = [hashes]
    for _ in range(1, most):
        longer = hashes.copy()
        longer[1:] = joined(out[-1][:-1], hashes[1:])
        out.append(longer)
    return out


def joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a sequence and one token more."""
    return mix(prefix * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(0x632BE59BD9B4E019))


def places(n: int, starts: np.ndarray) -> np.ndarray:
    """How many tokens of its text, the leading end among them, come before each place."""
    return np.arange(n) - np.repeat(starts[:-1], np.diff(starts))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, make, close) -> Iterator[pa.RecordBatch]:
    """Gather make(texts), a tuple of arrays, up to BLOCK_TOKENS entries and hand them to close as one."""
    held, size = [], 0
    for batch in small_batches(batches, column):
        held.append(make(batch.column(column)))
        size += len(held[-1][0])
        if size > BLOCK_TOKENS:
            yield from cut_batch(close(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held, size = [], 0
    if held:
        yield from cut_batch(close(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, c of the tokens, for each block."""

    def make(texts):
        hashes, starts = sequences(texts)
        return (hashes[places(len(hashes), starts) > 0],)

    def close(keys):
        found, c = np.unique(keys, return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(found), pa.array(c)], ["key", "c"])

    yield from _blocks(batches, 0, make, close)


def _next_counts(d: int, contexts, listed, part: int, parts: int):
    """prefix, word, c of contexts of d tokens and what follows them, for each block and one part of the next words; both filters must be passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(texts):
            hashes, starts = sequences(texts)
            keys = grams(hashes, d)[-1]
            use = np.flatnonzero(places(len(hashes), starts) >= d)
            use = use[hashes[use] % np.uint64(parts) == part]
            use = use[listed.value.has(keys[use])]
            use = use[contexts.value.has(keys[use - 1])]
            return keys[use - 1], hashes[use]

        def close(prefix, word):
            key = joined(prefix, word)
            order = np.argsort(key)
            new = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else order
            at, c = order[new], np.diff(np.append(new, len(key)))
            return pa.RecordBatch.from_arrays([_signed(prefix[at]), _signed(word[at]), pa.array(c)], ["prefix", "word", "c"])

        yield from _blocks(batches, 0, make, close)

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Makes the keys of prefix + word and, for the sequence without its first token, of suffix + word (null: word alone)."""
    for batch in batches:
        prefix, word, suffix = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        shorter = np.where(batch.column(2).is_null().to_numpy(zero_copy_only=False), word, joined(suffix, word))
        yield pa.RecordBatch.from_arrays([_signed(joined(prefix, word)), batch.column(0), _signed(shorter), batch.column(3), batch.column(4)], ["key", "prefix", "suffix", "c", "n"])


@dataclass
class Tree:
    """total N, kinds V, unknown mass; words(key, c); terms(key, c, value): what to add, in log10, where a key is found."""

    total: int
    kinds: int
    unknown: float
    words: DataFrame
    terms: DataFrame


def learn(texts: DataFrame, scratch: Scratch, depth: int = DEPTH) -> Tree:
    """The tree of texts(text)."""
    context = texts.sparkSession.sparkContext
    texts = texts.select("text")

    words = scratch.keep(texts.mapInArrow(_word_counts, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")), "words")
    total, kinds, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    unknown = 1.0 if total == 0 else min(0.5, (once + 0.5) / (total + 1))
    root = F.log((1 - unknown) / max(1, total) * F.col("c"))
    shorter = words.where(F.col("c") >= LEAST_ENTRY).select(F.col("key").alias("suffix"), root.alias("below"))
    listed, terms = words.withColumn("suffix", F.lit(None).cast("long")), []
    for d in range(1, depth + 1):
        frequent = listed.where(F.col("c") >= LEAST_STATE).select(F.col("key").alias("prefix"), "suffix", F.col("c").alias("n"))
        with Shared(context, Bits.of(listed.where(F.col("c") >= LEAST_STATE))) as contexts, Shared(context, Bits.of(listed.where(F.col("c") >= LEAST_ENTRY))) as some:
            def counted(part: int, parts: int) -> DataFrame:
                nexts = texts.mapInArrow(_next_counts(d, contexts, some, part, parts), "prefix bigint, word bigint, c bigint")  # noqa: B023
                # Blocks leave few equal rows, so they are summed where they meet alone.
                nexts = nexts.repartition("prefix", "word").groupBy("prefix", "word").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_ENTRY)
                return nexts.join(frequent.hint("shuffle_hash"), "prefix").select("prefix", "word", "suffix", "c", "n").mapInArrow(_keyed, "key bigint, prefix bigint, suffix bigint, c bigint, n bigint")  # noqa: B023

            parts = [scratch.keep(counted(i, n), f"listed{d}/part={i}") for n in [PARTS if d == 1 else 1] for i in range(n)]
        listed = parts[0]
        for more in parts[1:]:
            listed = listed.unionByName(more)
        level = scratch.keep(_states(_level(listed, shorter)), f"level{d}")
        terms.append(level.where("value IS NOT NULL").select("key", "c", "value"))
        terms.append(level.where("state IS NOT NULL").select(F.col("state.prefix").bitwiseXOR(F.lit(STATE_KEY)).alias("key"), F.col("state.n").alias("c"), "state.value"))
        shorter = level.select(F.col("key").alias("suffix"), "below")
    made = terms[0] if terms else words.select("key", "c", F.lit(0.0).alias("value")).limit(0)
    for t in terms[1:]:
        made = made.unionByName(t)
    made = scratch.keep(made, "terms")
    for d in range(1, depth + 1):
        for name in ("listed", "level"):
            scratch.drop(f"{name}{d}")
    return Tree(total, kinds, unknown, words, made)


def _level(listed: DataFrame, shorter: DataFrame) -> DataFrame:
    """key, prefix, c, n, share, below of the nexts listed for contexts of one length.

    below is log P(x | longest kept proper suffix). The same next of the context
    without its first word was seen at least as often, so its row in ``shorter`` exists.
    """
    return listed.join(shorter, "suffix").select("key", "prefix", "c", "n", ((F.col("c") - DISCOUNT) / F.col("n")).alias("share"), "below")


def _states(level: DataFrame) -> DataFrame:
    """key, c, value, below, state of the nexts of each context.

    value is what a next adds to below, in log10, or null where its context diverges
    too little to be a state; below is log P(x | longest kept suffix), the context now
    among them; state(prefix, n, value) stands in one row of each state. All of a
    context's nexts meet once, in one sorted pass.
    """
    context, ten = Window.partitionBy("prefix"), float(np.log(10))
    over = lambda c: c.over(context)
    seen = level.withColumn("seen", over(F.sum("c"))).withColumn("k", over(F.count(F.lit(1)))).withColumn("least", over(F.min("key")))
    rested = seen.withColumn("rest", (F.col("n") - F.col("seen") + DISCOUNT * F.col("k")) / F.col("n")).withColumn("own", F.log(F.col("share") + F.col("rest") * F.exp("below")))
    gained = rested.withColumn("gain", over(F.sum(F.col("c") * (F.col("own") - F.col("below")))))
    keep = F.col("gain") + (F.col("n") - F.col("seen")) * F.log("rest") > DIVERGENCE * F.col("n")
    return gained.withColumn("keep", keep).select(
        "key", "c", F.when(F.col("keep"), (F.col("own") - F.log("rest") - F.col("below")) / ten).alias("value"), F.when(F.col("keep"), F.col("own")).otherwise(F.col("below")).alias("below"),
        F.when(F.col("keep") & (F.col("key") == F.col("least")), F.struct("prefix", "n", F.log10("rest").alias("value"))).alias("state"),
    )


class Shared:
    """A broadcast value that is gone from driver, executors and workers at the end of the block."""

    def __init__(self, context: SparkContext, value):
        self.shared = context.broadcast(value)

    def __enter__(self):
        return self.shared

    def __exit__(self, *_):
        self.shared.destroy()


def head(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows seen most, by steps of a quarter of a power of two and at most ``most`` of them; and the others."""
    step = F.floor(F.log2("c") * 4)
    left, least = most, 1 << 20
    for r in sorted(table.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):  # at most 256 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["s"]
    return table.where(step >= least), table.where(step < least)


@dataclass
class Head:
    """What is looked up in place, and the filters of all terms and of those that are not."""

    total: int
    kinds: int
    unknown: float
    words: np.ndarray
    counts: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    any: Bits
    others: Bits
    depth: int
    _tables: list = field(default_factory=list)

    def __getstate__(self):
        return self.__dict__ | {"_tables": []}

    def tables(self) -> list[HashTable]:
        if not self._tables:
            self._tables = [HashTable(self.words), HashTable(self.keys)]
        return self._tables


def _head(tree: Tree, depth: int, words: int = HEAD_WORDS, terms: int = HEAD_TERMS) -> tuple[Head, DataFrame, DataFrame]:
    """What is looked up in place; the other words and the other terms."""
    arrays = lambda df: [c.to_numpy() for c in df.toArrow().columns]
    top_words, other_words = head(tree.words, min(words, tree.kinds // HEAD_SHARE))
    w, c = arrays(top_words)
    top, others = head(tree.terms, min(terms, tree.terms.count() // HEAD_SHARE))
    k, v = arrays(top.select("key", "value"))
    made = Head(tree.total, tree.kinds, tree.unknown, w.astype(np.int64).view(np.uint64), c.astype(np.int64), k.astype(np.int64).view(np.uint64), v.astype(float), Bits.of(tree.terms), Bits.of(others), depth)
    return made, other_words, others


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """A row for each bucket: its number and, of each column, its entries as bytes."""
    small = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket  # is sorted by its digits
    order = np.argsort(small, kind="stable")
    ordered = bucket[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
    found, bounds = ordered[first], np.append(first, len(order))
    packed = lambda c: pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((bounds * c.itemsize).astype(np.int32)), pa.py_buffer(c[order])])
    return [pa.array(found, pa.int32()), *map(packed, columns)]


LOOKED = "bucket int, keys binary, numbers binary"


def _bucketed(buckets: int, first: int):
    """key, number as packed rows, for each block; buckets are numbered from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            keys, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays(_packed(_bucket(keys, buckets) + first, keys, numbers), ["bucket", "keys", "numbers"])

        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > BLOCK_SOUGHT:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    return run


#: Rows of texts, which have no keys, and rows of what the texts of a block seek in a bucket.
SOUGHT = "bucket int, block bigint, texts binary, keys binary, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double"
#: Rows of texts as they were, and for each row of keys the texts and the numbers found: a count for a word, a sum for the terms of a text.
FOUND = "block bigint, texts binary, numbers binary, words boolean, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double"
TEXT = ["doc_id", "held_out", "n_tokens", "known", "base", "score"]


def _sums(of: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(of, values, count).astype(float)  # of no values it would be whole numbers


def _score(shared, buckets: int):
    """What can be added in place for each text, taking words out of place for unknown; and what its tokens seek elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: Head = shared.value
        words, terms = h.tables()
        space = h.total + 0.5 * (h.kinds + 1)
        task = TaskContext.get().partitionId()
        held, seek, texts, size, block = [], [], 0, 0, task << 32

        def close():
            of, keys, bucket = (np.concatenate(x) for x in zip(*seek, strict=True))
            asked = _packed(bucket, of, keys)
            names = ["bucket", "block", "texts", "keys"]
            # Keys name texts by their places in the block; the texts go to all buckets in turn.
            own = pa.Table.from_batches(held).combine_chunks()
            n, m = own.num_rows, len(asked[0])
            place = pa.array(np.arange(n, dtype=np.uint16).view("V2").tolist(), pa.binary())
            own = pa.table([pa.array((np.arange(n) + 31 * task + block) % (2 * buckets), pa.int32()), pa.array(np.full(n, block)), place, pa.nulls(n, pa.binary()), *own.columns], names + TEXT)
            asked = pa.table([asked[0], pa.array(np.full(m, block)), *asked[1:], *(pa.nulls(m, t) for t in own.schema.types[4:])], names + TEXT)
            return pa.concat_tables([own, asked]).to_batches()

        for batch in (b for whole in small_batches(batches, 1, SCORED_BYTES) for b in cut_batch(whole, MOST_TEXTS // 2)):
            hashes, starts = sequences(batch.column(1))
            n, count = len(hashes), batch.num_rows
            if texts and (size > BLOCK_SOUGHT or texts + count > MOST_TEXTS):
                yield from close()
                held, seek, texts, size, block = [], [], 0, 0, block + 1
            before = places(n, starts)
            text = np.repeat(np.arange(count), np.diff(starts))
            token = np.flatnonzero(before > 0)
            at = words.find(hashes[token])
            listed, rare = token[at >= 0], token[at < 0]
            c = h.counts[at[at >= 0]]
            known, unknown = np.bincount(text[listed], minlength=count), np.bincount(text[rare], minlength=count)
            base = _sums(text[listed], np.log10((c + 0.5) / space), count) + unknown * np.log10(0.5 / space)
            score = _sums(text[listed], np.log10((1 - h.unknown) / max(1, h.total) * c), count) + unknown * np.log10(h.unknown)
            keys = grams(hashes, h.depth + 1)

            def ask(of: np.ndarray, sought: np.ndarray, first: int) -> None:
                nonlocal size
                seek.append(((of + texts).astype(np.uint16), sought, _bucket(sought, buckets) + first))  # noqa: B023
                size += len(sought)

            def look(of: np.ndarray, sought: np.ndarray) -> np.ndarray:
                """Adds the values found for the texts ``of`` and asks for those that may be elsewhere; which keys were either."""
                nonlocal score
                some = np.flatnonzero(h.any.has(sought))
                of, sought = of[some], sought[some]
                at = terms.find(sought)
                hit = at >= 0
                score += _sums(of[hit], h.values[at[hit]], count)  # noqa: B023
                of, sought = of[~hit], sought[~hit]
                rest = h.others.has(sought)
                ask(of[rest], sought[rest], 0)  # noqa: B023
                return some

            ask(text[rare], hashes[rare], buckets)
            for d in range(1, h.depth + 1):
                use = np.flatnonzero(before >= d)
                use = use[look(text[use], keys[d - 1][use - 1] ^ np.uint64(STATE_KEY))]
                look(text[use], keys[d][use])
            held.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(starts) - 1), pa.array(known), pa.array(base), pa.array(score)], TEXT))
            texts += count
        if texts:
            yield from close()

    return run


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _find(buckets: int):
    """The numbers of the keys that the texts of a bucket's blocks seek."""

    def run(bucket: tuple, asked: pa.Table, looked: pa.Table) -> pa.Table:
        table, numbers = HashTable(_numbers(looked["keys"], np.uint64)), _numbers(looked["numbers"], float)
        is_word, rows = bucket[0].as_py() >= buckets, []
        for block, of, keys in zip(*(asked.filter(pc.is_valid(asked["keys"]))[x].to_pylist() for x in ("block", "texts", "keys")), strict=True):
            at, of = table.find(np.frombuffer(keys, np.uint64)), np.frombuffer(of, np.uint16)
            of, found = of[at >= 0], numbers[at[at >= 0]]
            if not is_word and len(of):
                sums = np.bincount(of, found)
                of = np.flatnonzero(np.bincount(of)).astype(np.uint16)
                found = sums[of]
            if len(of):
                rows.append((block, of.tobytes(), found.tobytes()))
        own = asked.filter(pc.is_null(asked["keys"]))
        n, m, names = own.num_rows, len(rows), ["block", "texts", "numbers", "words", *TEXT]
        own = pa.table([own["block"], own["texts"], pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_()), *(own[x] for x in TEXT)], names)
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
        found = pa.table([*columns, pa.array([is_word] * m, pa.bool_()), *(pa.nulls(m, own.schema.field(x).type) for x in TEXT)], names)
        return pa.concat_tables([own, found])

    return run


def _sum_up(mass: float, unknown: float):
    """The texts of a block with what was found for them."""

    def run(found: pa.Table) -> pa.Table:
        own = found.filter(pc.is_null(found["numbers"]))
        own = own.take(pa.array(np.argsort(_numbers(own["texts"], np.uint16))))
        known, base, score = (own[x].to_numpy().copy() for x in ("known", "base", "score"))
        n = len(known)
        for is_word in (True, False):
            rows = found.filter(pc.equal(found["words"], is_word))  # null of texts
            of, numbers = _numbers(rows["texts"], np.uint16), _numbers(rows["numbers"], float)
            if is_word:
                known += np.bincount(of, minlength=n)
                base += _sums(of, np.log10((numbers + 0.5) / 0.5), n)
                numbers = np.log10(mass * numbers / unknown)
            score += _sums(of, numbers, n)
        return pa.table([own["doc_id"], own["held_out"], own["n_tokens"], pa.array(known), pa.array(base), pa.array(score)], TEXT)

    return run


def score_documents(docs: DataFrame, remainder: int = 1, depth: int = DEPTH, words: int = HEAD_WORDS, terms: int = HEAD_TERMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    It learns from the rows whose remainder is another. The result reads tables in
    the shared folder, which are left there for it.
    """
    scratch = Scratch(docs.sparkSession, "suffix-tree")
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), remainder).alias("held_out"))
    tree = learn(rows.where("NOT held_out"), scratch, depth)
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = max(LEAST_BUCKETS, tree.total // BUCKET_TOKENS)
    top, other_words, others = _head(tree, depth, words, terms)
    looked = other_words.select("key", F.col("c").cast("double")).mapInArrow(_bucketed(buckets, buckets), LOOKED)
    looked = scratch.keep(looked.unionByName(others.select("key", "value").mapInArrow(_bucketed(buckets, 0), LOOKED)), "looked")
    scratch.drop("terms")
    scratch.drop("words")
    passes = PASSES if top.others.bits is not None else UNFILTERED_PASSES
    with Shared(docs.sparkSession.sparkContext, top) as shared:

        def scored(part: int) -> DataFrame:
            some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == part)
            sought = some.mapInArrow(_score(shared, buckets), SOUGHT.format(kind=kind))
            found = sought.groupBy("bucket").cogroup(looked.groupBy("bucket")).applyInArrow(_find(buckets), FOUND.format(kind=kind))
            summed = _sum_up((1 - tree.unknown) / max(1, tree.total), tree.unknown)
            return found.groupBy("block").applyInArrow(summed, f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double")

        parts = [scratch.keep(scored(i), f"scored{i}") for i in range(passes)]
    scratch.drop("looked")
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
