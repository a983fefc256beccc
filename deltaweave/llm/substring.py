"""Removal of repeated passages through a log-structured fingerprint index.

A window is WINDOW consecutive words. Of the KGRAM-word hashes inside a window
the smallest is its minimizer; equal windows have equal minimizers at the same
place, so only minimizers (about one word in twelve) need to be indexed.

The index is a set of immutable runs sorted by hash, kept as bucketed tables so
that merging needs no shuffle. Each batch of documents is written as a new run
and merge-joined with the runs before it; entries met on either side become
candidates. Once more than MAX_RUNS runs stand they are compacted into one. A
manifest beside the runs names them, so a later program can open the index and
add its batch: ``FingerprintIndex.open(spark, root).add(batch)``, then
``verified_ranges`` over history and batch.
Candidates are verified: the windows around them are hashed whole, to 128 bits
from two independent word hashes, and counted over all documents. Documents are
told apart by 128 bits of their id and text.

Inside a task equal hashes are counted first. What occurs twice there is settled
at once, and one row stands for it in the index; what is shuffled for one hash is
at most one row for each block of input, however common a passage is.

Defined cases: null and empty texts have no words and are returned with none;
texts shorter than a window lose nothing; a document without spaces is one word;
repeated rows are separate occurrences, so they remove each other's windows; an
empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import CLEANUP, Scratch, settings
from ._text import cut_batch, small_batches, string_buffers, tokens, window_hashes, word_bounds, word_hashes

WINDOW, KGRAM = 35, 12
BATCHES, MAX_RUNS = 3, 2
#: Entries gathered before a block is counted.
BLOCK_ENTRIES = 1 << 19
#: A bucket of the index holds about so many entries of a run, where that asks for more buckets than shuffle partitions.
BUCKET_ENTRIES = 1 << 22

ENTRY = "h bigint, n int, row bigint, pos int"
WINDOWS = "h1 bigint, h2 bigint, n int, row bigint, twin bigint, pos int, len int"


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of each run of ``width`` entries, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(words: np.ndarray, first: np.ndarray, window: int, kgram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in words) and hashes of the k-grams that are least in some window of one text."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hashes(words, kgram)
    width = window - kgram + 1
    least = _sliding(grams, width, np.minimum)  # for each window
    ends = np.repeat(first[1:], np.diff(first))
    inside = np.arange(len(least)) + window <= ends[: len(least)]
    low = np.where(inside, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)  # over the windows that hold each k-gram
    at = np.flatnonzero((most == grams) & (grams > 0))
    return at, grams[at]


def _settle(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry of a block, how often its hash occurs there; and one index for each repeated hash."""
    _, index, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts > 1)
    return counts[inverse], index[twice], counts[twice]


def _entries(window: int, kgram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            h, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            times, some, counts = _settle(h)
            # One row for each hash: alone with its place, or repeated as a marker; places of the repeated follow with n = 0.
            alone, known = times == 1, times > 1
            k = len(some)
            yield from cut_batch(pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h[alone], h[some], h[known]]).view(np.int64)),
                    pa.array(np.concatenate([times[alone], np.minimum(counts, 2), np.zeros(known.sum(), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([row[alone], np.zeros(k, np.int64), row[known]])),
                    pa.array(np.concatenate([pos[alone], np.full(k, -1), pos[known]]).astype(np.int32)),
                ],
                ["h", "n", "row", "pos"],
            ))

        for batch in small_batches(batches, 1):
            words, first = tokens(batch.column(1))
            at, h = minimizers(words, first, window, kgram)
            text = np.searchsorted(first, at, side="right") - 1
            held.append((h, batch.column(0).to_numpy(zero_copy_only=False)[text], at - first[text]))
            size += len(h)
            if size > BLOCK_ENTRIES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


class FingerprintIndex:
    """Sorted runs of window hashes below ``root``; ``add`` returns the places newly known to be repeated.

    Runs have one marker for what is repeated in a block. A lasting index also keeps
    the places behind the markers, unsorted, which are read only for markers that a
    later batch meets; one used for a single verification of all batches needs none.
    """

    def __init__(self, spark: SparkSession, root: str, window: int = WINDOW, kgram: int = KGRAM, max_runs: int = MAX_RUNS, lasting: bool = True):
        self.spark, self.root, self.window, self.kgram, self.max_runs, self.lasting = spark, root, window, kgram, max_runs, lasting
        self.places: list[str] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str, **settings) -> FingerprintIndex:
        """The index that stands below ``root``, as its last whole manifest names it, or a new one."""
        index = cls(spark, root, **settings)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return index
        whole = [int(f.getPath().getName()) for f in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        if whole:
            index.version = max(whole)
            saved = json.loads(spark.read.text(f"{root}/manifest/{index.version}").first()[0])
            index.runs, index.places, index.buckets, index.window, index.kgram = (saved[k] for k in ("runs", "places", "buckets", "window", "kgram"))
            for name in index.runs:
                if not spark.catalog.tableExists(name):
                    spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {index.buckets} BUCKETS LOCATION '{root}/{name}'")
        return index

    def _save(self) -> None:
        """A new manifest; it counts once Spark has marked it as whole, and the runs it names stand by then."""
        if not self.lasting:
            return
        self.version += 1
        saved = json.dumps({"runs": self.runs, "places": self.places, "buckets": self.buckets, "window": self.window, "kgram": self.kgram})
        self.spark.createDataFrame([(saved,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{self.version}")

    def _write(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows = df.repartition(self.buckets, "h").sortWithinPartitions("h")
        with settings(self.spark, {CLEANUP: "true"}):
            rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def add(self, rows: DataFrame, scratch: Scratch, out: str = "candidates") -> DataFrame:
        """Index rows(row, text) as a new run; row, places of the candidate k-grams found by that, stored in scratch."""
        found = scratch.keep(rows.select("row", "text").mapInArrow(_entries(self.window, self.kgram), ENTRY), f"{out}-entries")
        if not self.runs:  # all runs have the buckets of the first, so that they merge without a shuffle
            self.buckets = max(self.buckets, -(-found.count() // BUCKET_ENTRIES))
        known = found.where("n = 0").select("row", "pos")
        new = self._write(found.where("n > 0"))
        fresh = self.spark.table(new)
        counted = fresh.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h")
        parts = [known, fresh.where("pos >= 0").join(counted.hint("merge"), "h", "left_semi").select("row", "pos")]
        for old_name in self.runs:
            old = self.spark.table(old_name)
            parts.append(fresh.where("pos >= 0").join(old.select("h").hint("merge"), "h", "left_semi").select("row", "pos"))
            parts.append(old.where("pos >= 0").join(fresh.select("h").hint("merge"), "h", "left_semi").select("row", "pos"))
            if self.places:
                met = scratch.keep(old.where("pos < 0").select("h").join(fresh.select("h").hint("merge"), "h", "left_semi").distinct(), f"{out}-met-{old_name}")
                parts += [self.spark.read.schema(ENTRY).parquet(f"{self.root}/{name}").join(met, "h", "left_semi").select("row", "pos") for name in self.places]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        candidates = scratch.keep(union.groupBy("row").agg(F.collect_set("pos").alias("places")), out)
        if self.lasting:
            self.places.append(f"places_{uuid.uuid4().hex}")
            found.where("n = 0").write.parquet(f"{self.root}/{self.places[-1]}")
        scratch.drop(f"{out}-entries")
        self.runs.append(new)
        self._save()
        if len(self.runs) > self.max_runs:
            self.compact()
        return candidates

    def compact(self) -> None:
        merged = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            merged = merged.unionByName(self.spark.table(name))
        old, self.runs = self.runs, [self._write(merged)]
        self._save()
        for name in old:
            self._drop(name)

    def remove(self) -> None:
        """Drop the runs and places."""
        for name in [*self.runs, *self.places]:
            self._drop(name)
        self.runs, self.places = [], []


def _candidate_windows(window: int, kgram: int):
    """Whole hashes of the windows that hold a candidate k-gram; those met twice in a block as settled ranges."""
    reach = window - kgram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            h1, h2, row, twin, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            group = np.cumsum(new) - 1
            counts = np.bincount(group) if len(group) else np.zeros(0, np.int64)
            times = np.empty(len(order), np.int64)
            times[order] = counts[group]
            some = order[np.flatnonzero(new)[counts > 1]]
            alone, known = times == 1, np.flatnonzero(times > 1)
            # Runs of settled windows become ranges.
            begin = np.ones(len(known), bool)
            begin[1:] = (row[known][1:] != row[known][:-1]) | (twin[known][1:] != twin[known][:-1]) | (pos[known][1:] != pos[known][:-1] + 1)
            s = np.flatnonzero(begin)
            lens = np.diff(np.append(s, len(known)))
            k, r = len(some), len(s)
            zero = np.zeros(r, np.uint64)
            yield from cut_batch(pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h1[alone], h1[some], zero]).view(np.int64)),
                    pa.array(np.concatenate([h2[alone], h2[some], zero]).view(np.int64)),
                    pa.array(np.concatenate([np.ones(alone.sum()), np.full(k, 2), np.zeros(r)]).astype(np.int32)),
                    pa.array(np.concatenate([row[alone], np.zeros(k, np.int64), row[known][s]])),
                    pa.array(np.concatenate([twin[alone], np.zeros(k, np.int64), twin[known][s]])),
                    pa.array(np.concatenate([pos[alone], np.full(k, -1), pos[known][s]]).astype(np.int32)),
                    pa.array(np.concatenate([np.ones(alone.sum() + k, np.int64), lens]).astype(np.int32)),
                ],
                ["h1", "h2", "n", "row", "twin", "pos", "len"],
            ))

        for batch in small_batches(batches, 1):
            data, offsets = string_buffers(batch.column(1))
            starts, ends, first = word_bounds(data, offsets)
            w1, w2 = (word_hashes(data, starts, ends, seed) for seed in (0, 1))
            places = batch.column(2)
            places = places.combine_chunks() if isinstance(places, pa.ChunkedArray) else places
            spans = np.diff(places.offsets.to_numpy())
            at = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), spans)
            at = at + first[text]
            change = np.zeros(len(w1) + 1, np.int64)
            low = np.maximum(at - reach, first[text])
            high = np.minimum(at, first[text + 1] - window) + 1
            use = high > low
            np.add.at(change, low[use], 1)
            np.add.at(change, high[use], -1)
            chosen = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            if len(chosen):
                h1, h2 = window_hashes(w1, window)[chosen], window_hashes(w2, window, 0x9FB21C651E98DF25)[chosen]
                text = np.searchsorted(first, chosen, side="right") - 1
                held.append((h1, h2, *(batch.column(c).to_numpy(zero_copy_only=False)[text] for c in (0, 3)), chosen - first[text]))
                size += len(chosen)
            if size > BLOCK_ENTRIES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            texts = batch.column(1).to_pylist()
            ranges = batch.column(2).to_pylist()
            kept, total, gone, spans = [], [], [], []
            for text, found in zip(texts, ranges, strict=True):
                words = text.encode().split() if text else []
                merged: list[list[int]] = []
                for r in sorted((r["pos"], r["pos"] + r["len"] - 1 + window) for r in found or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                out, at = [], 0
                for s, e in merged:
                    out += words[at:s]
                    at = e
                out += words[at:]
                kept.append(b" ".join(out).decode())
                total.append(len(words))
                gone.append(len(words) - len(out))
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "text", "n_words", "n_removed", "spans"],
            )

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, and row, twin: 128 bits that tell rows apart unless equal in both."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text", F.lit("twin"), "doc_id").alias("twin"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, kgram: int = KGRAM, batches: int = BATCHES) -> DataFrame:
    """row, twin, ranges of numbered docs: for each row with any, runs of ``len`` consecutive repeated windows from word ``pos`` on."""
    scratch = Scratch(docs.sparkSession, "substring")
    index = FingerprintIndex(docs.sparkSession, scratch.path("index"), window, kgram, lasting=False)
    found = None
    try:
        for i in range(batches):
            part = docs.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == i) if batches > 1 else docs
            new = index.add(part, scratch, f"candidates{i}")
            found = new if found is None else found.unionByName(new)
    finally:
        index.remove()
    return verified_ranges(docs, found, scratch, window, kgram, [f"candidates{i}" for i in range(batches)])


def verified_ranges(docs: DataFrame, candidates: DataFrame, scratch: Scratch, window: int = WINDOW, kgram: int = KGRAM, drop: list[str] | None = None) -> DataFrame:
    """row, twin, ranges: windows of docs (numbered; all that candidates name) around candidates(row, places) that occur twice; drop: tables then needed no more."""
    places = scratch.keep(candidates.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")), "places")
    for name in drop or ():
        scratch.drop(name)
    # Repeated rows share their row number and so their places; each still counts as an occurrence.
    windows = docs.join(places, "row").select("row", "text", "places", "twin").mapInArrow(_candidate_windows(window, kgram), WINDOWS)
    windows = scratch.keep(windows, "windows")
    scratch.drop("places")
    # A hash has at most one row for each block here, so no group is large.
    times = F.sum("n").over(Window.partitionBy("h1", "h2"))
    place = ["row", "twin", "pos"]
    unsettled = windows.where("n > 0").select("h1", "h2", "n", *place).withColumn("times", times).where("times > 1 AND pos >= 0").select(*place, F.lit(1).alias("len"))
    every = unsettled.unionByName(windows.where("n = 0").select(*place, "len"))
    ranges = scratch.keep(every.groupBy("row", "twin").agg(F.collect_list(F.struct("pos", "len")).alias("ranges")), "ranges")
    scratch.drop("windows")
    return ranges


def remove_repeats(docs: DataFrame, window: int = WINDOW, kgram: int = KGRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, text (kept words joined by spaces), n_words, n_removed, spans (word ranges cut) for every row."""
    rows = numbered(docs)
    return cut_ranges(rows, repeated_ranges(rows, window, kgram, batches), window)


def cut_ranges(rows: DataFrame, ranges: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_words, n_removed, spans of numbered rows without the words in ranges."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.join(ranges, ["row", "twin"], "left")
        .select("doc_id", "text", "ranges")
        .mapInArrow(_cut(window), f"doc_id {kind}, text string, n_words bigint, n_removed bigint, spans array<array<int>>")
    )
