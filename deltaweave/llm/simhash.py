"""SimHash near-duplicates by anchor-point covering.

The 64 bits are three parts. Of two fingerprints that differ in at most t bits, two
of the parts together differ in at most 2t/3, so each pair of parts is a layout of
its own. The anchors of a layout are the pairs of words of the binary Golay code of
length 23, one laid over each part. The code is perfect with covering radius 3, so
every fingerprint lies within 6 of an anchor, and two that differ in at most d bits
of the layout are both within 6 + d of the anchor nearest to either. Each distinct
fingerprint is therefore replicated, in every layout, to all anchors within 6 + 2t/3
(about 46 of 3 * 2**24 in all for t = 2, 234 for t = 4) and compared, over all 64
bits, with the others at the anchor. No link can be missed, and no pair of rows is
made for equal fingerprints.

An anchor with over HOT fingerprints is not compared in one task. Its fingerprints
are dealt to all values within t/2 bits of them: those at one value are at most so
many as there are such values, all are linked with one another, and any two linked
ones meet at one.

Of the links found at one time only a spanning forest of least distance is kept,
which leaves the components unchanged. Components are found on the fingerprints
alone.

Defined cases: a null or empty text, or one without words, has fingerprint zero;
fewer words than a shingle give one shingle of all of them; repeated rows are
rows of one fingerprint; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import _LOWER, cut_batch, mix, small_batches, string_buffers, tokens, window_hashes, word_bounds
from .components import connected_components

SHINGLE, THRESHOLD = 3, 2
RADIUS = 3  # of the Golay code
HALF = 23
#: First bit and size of each part.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Most fingerprints at an anchor that are compared in one task.
HOT = 1 << 15
#: What the pipeline takes for near: bits between word-set fingerprints, and similarity of the sets of SIMILAR_WIDTH-word shingles.
NEAR_BITS, SIMILAR_WIDTH, SIMILAR = 4, 5, 0.8
#: Independent word-set fingerprints; links of any count.
FAMILIES = 3


def fingerprint(words: list[bytes], width: int = SHINGLE) -> int:
    """The SimHash of a word sequence by XXH64 with seed 42."""
    if not words:
        return 0
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    return _fingerprint(text, starts, starts + size, width)


def _fingerprint(text: bytes, starts: np.ndarray, ends: np.ndarray, width: int) -> int:
    n = max(1, len(starts) - width + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], 42) for s, e in zip(first, last, strict=True)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            data, offsets = string_buffers(batch.column(1))
            starts, ends, first = word_bounds(data, offsets)
            out = np.zeros(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                if a < b:
                    s, e = starts[a:b], ends[a:b]
                    raw = _LOWER[data[s[0] : e[-1]]]
                    if len(s) > 1:
                        gap = s[1:] - e[:-1]
                        at = e[:-1] - s[0]
                        raw[at] = 32
                        if (gap > 1).any():  # several spaces become one
                            keep = np.ones(len(raw), bool)
                            wide = np.flatnonzero(gap > 1)
                            for k in wide.tolist():
                                keep[at[k] + 1 : at[k] + gap[k]] = False
                            shift = np.concatenate([[0], np.cumsum(gap - 1)])
                            raw, s, e = raw[keep], s - shift, e - shift
                    out[i] = _fingerprint(raw.tobytes(), s - s[0], e - s[0], width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


_golay: list = []


def golay_errors(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes, the patterns of weight <= most that have it.

    Returns (patterns sorted by syndrome then weight, their weights, 2049 bounds):
    x is at distance w from a codeword c just when x ^ c is such a pattern of
    weight w for the syndrome of x.
    """
    if not _golay:
        _golay.append({})
    if most not in _golay[0]:
        every = np.arange(1 << HALF, dtype=np.uint32)
        weight = np.bitwise_count(every)
        every = every[weight <= most]
        syndrome, weight = golay_syndrome(every), np.bitwise_count(every)
        order = np.lexsort((every, weight, syndrome))
        _golay[0][most] = every[order], weight[order].astype(np.int64), np.searchsorted(syndrome[order], np.arange(2049))
    return _golay[0][most]


def golay_syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by x^11+x^10+x^6+x^5+x^4+x^2+1, which generates the code."""
    rest = words.astype(np.uint32).copy()
    for i in range(HALF - 1, 10, -1):
        rest ^= np.where((rest >> np.uint32(i)) & np.uint32(1), np.uint32(0b110001110101 << (i - 11)), np.uint32(0))
    return rest.astype(np.int64)


def anchors_of(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, anchor) for every anchor, of all layouts, within covering radius plus the layout's share of the threshold."""
    reach = 2 * RADIUS + threshold * 2 // len(PARTS)
    patterns, weights, bounds = golay_errors(reach)
    at, found = [], []
    for layout, pair in enumerate(combinations(PARTS, 2)):
        low, high = (((fps >> np.uint64(begin)) & np.uint64((1 << size) - 1)).astype(np.uint32) for begin, size in pair)
        for i in range(len(fps)):
            a, b = golay_syndrome_of(low[i]), golay_syndrome_of(high[i])
            pa_, wa = patterns[bounds[a] : bounds[a + 1]], weights[bounds[a] : bounds[a + 1]]
            pb, wb = patterns[bounds[b] : bounds[b + 1]], weights[bounds[b] : bounds[b + 1]]
            room = np.searchsorted(wb, reach - wa, side="right")  # both are sorted by weight
            use = room > 0
            rooms = room[use]
            left = np.repeat(low[i] ^ pa_[use], rooms).astype(np.int64)
            begin = np.repeat(np.cumsum(rooms) - rooms, rooms)
            right = (high[i] ^ pb[np.arange(len(left)) - begin]).astype(np.int64)
            at.append(np.full(len(left), i))
            found.append(layout << 2 * HALF | left << HALF | right)
    return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_tables: list[np.ndarray] = []


def golay_syndrome_of(word) -> int:
    if not _tables:
        _tables.append(golay_syndrome(np.arange(1 << 12, dtype=np.uint32)))
        _tables.append(golay_syndrome(np.arange(1 << 11, dtype=np.uint32) << np.uint32(12)))
    return int(_tables[0][int(word) & 0xFFF] ^ _tables[1][int(word) >> 12])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join the same nodes, without cycles."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def near_links(distinct: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, hot: int = HOT, name: str = "found") -> DataFrame:
    """a, b: links that connect just those of distinct(fp) joined by steps of <= threshold bits."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 500):
                at, anchor = anchors_of(fps[i : i + 500].view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[i : i + 500][at])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links; and with b null the fingerprints of anchors that have too many."""
        kept_anchor, kept_fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), -1
        for batch in batches:
            anchor = np.concatenate([kept_anchor, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([kept_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            last = anchor[-1] if len(anchor) else -1
            kept_anchor, kept_fp, anchor, fp = anchor[cut:], fp[cut:], anchor[:cut], fp[:cut]
            rest = anchor == over
            yield from _deferred(fp[rest])
            yield from _links(anchor[~rest], fp[~rest], threshold, hot)
            if last == over or len(kept_fp) > hot:
                yield from _deferred(kept_fp)
                kept_anchor, kept_fp, over = kept_anchor[:0], kept_fp[:0], last
        yield from _links(kept_anchor, kept_fp, threshold, hot)

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows make many
    spread = distinct.select("fp").repartition(tasks, "fp").mapInArrow(replicate, "anchor bigint, fp bigint")
    found = spread.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "a bigint, b bigint").distinct()
    found = scratch.keep(found, name)
    return found.where("b IS NOT NULL").unionByName(ball_links(found.where("b IS NULL").select(F.col("a").alias("fp")), threshold))


def ball_links(fps: DataFrame, threshold: int) -> DataFrame:
    """a, b: the same kind of links among distinct fps, through the values within half the threshold of each."""
    radius = -(-threshold // 2)
    masks = [0]
    for n in range(1, radius + 1):
        for bits in combinations(range(64), n):
            mask = sum(1 << b for b in bits)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    met = fps.select("fp", F.explode(F.transform(F.from_json(F.lit(str(masks)), "array<bigint>"), lambda m: m.bitwiseXOR(F.col("fp")))).alias("value"))
    stars = met.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # no more than there are masks
    pairs = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)


def _deferred(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(fps):
        yield from cut_batch(pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.nulls(len(fps), pa.int64())], ["a", "b"]))


def _links(anchor: np.ndarray, fp: np.ndarray, threshold: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Compare the fingerprints at each anchor: all pairs one apart, then two apart, and so on."""
    if len(fp) > hot:
        _, of, sizes = np.unique(anchor, return_inverse=True, return_counts=True)
        large = sizes[of] > hot
        yield from _deferred(fp[large])
        anchor, fp = anchor[~large], fp[~large]
    bits = fp.view(np.uint64)
    at, lag, a, b, waiting = np.arange(len(fp)), 1, [], [], 0
    while True:
        at = at[at + lag < len(fp)]
        at = at[anchor[at] == anchor[at + lag]]
        if not len(at):
            break
        near = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= threshold]
        a.append(fp[near])
        b.append(fp[near + lag])
        waiting += len(near)
        if waiting > 1 << 18:
            x, y = _nearest_forest(a, b)
            a, b, waiting = [np.array(x, np.int64)], [np.array(y, np.int64)], 0
        lag += 1
    if a:
        x, y = _nearest_forest(a, b)
        if x:
            yield from cut_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"]))


def _nearest_forest(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[int], list[int]]:
    x, y = np.concatenate(a), np.concatenate(b)
    order = np.argsort(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)), kind="stable")
    return forest(x[order], y[order])


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of its component) for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, width), "fps")
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct, scratch, threshold), scratch)
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = scratch.keep(of, "roots")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def set_fingerprints(docs: DataFrame) -> DataFrame:
    """row, fp0, fp1, ..: SimHashes of the set of words of each text; fewer of their bits change with an edit than of shingles'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            hashes, first = tokens(batch.column(1), lower=True)
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            new = np.ones(len(text), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            hashes, text = hashes[new], text[new]
            count = np.bincount(text, minlength=batch.num_rows)
            has = np.flatnonzero(count)
            made = []
            for _ in range(FAMILIES):
                out = np.zeros(batch.num_rows, np.uint64)
                if len(has):
                    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    sums = np.add.reduceat(bits, (np.cumsum(count) - count)[has], axis=0, dtype=np.int64)
                    out[has] = np.packbits(sums * 2 > count[has, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
                made.append(pa.array(out.view(np.int64)))
                hashes = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["row", *(f"fp{i}" for i in range(FAMILIES))])

    return docs.select("row", "text").mapInArrow(run, "row string, " + ", ".join(f"fp{i} bigint" for i in range(FAMILIES)))


def similar(pairs: DataFrame, width: int = SIMILAR_WIDTH, least: float = SIMILAR) -> DataFrame:
    """a, b of those pairs(a, b, text_a, text_b) whose sets of word shingles have at least that Jaccard similarity."""

    def shingles(column) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes, each with its text."""
        words, first = tokens(column, lower=True)
        n = np.diff(first)
        grams = window_hashes(words, width)
        text = np.repeat(np.arange(len(n)), n)[: len(grams)]
        inside = np.arange(len(grams)) + width <= first[1:][text]
        grams, text = grams[inside], text[inside]
        short = np.flatnonzero(n < width)  # all words together are one shingle
        whole = np.array([hash(tuple(words[first[i] : first[i + 1]].tolist())) & (2**64 - 1) for i in short], np.uint64)
        grams, text = np.concatenate([grams, whole]), np.concatenate([text, short])
        order = np.lexsort((grams, text))
        grams, text = grams[order], text[order]
        new = np.ones(len(text), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
        return grams[new], text[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in small_batches(batches, 2):
            for batch in small_batches([wide], 3):
                (ga, ta), (gb, tb) = shingles(batch.column(2)), shingles(batch.column(3))
                both, text = np.concatenate([ga, gb]), np.concatenate([ta, tb])
                order = np.lexsort((both, text))
                shared = (both[order][1:] == both[order][:-1]) & (text[order][1:] == text[order][:-1])
                n = batch.num_rows
                common = np.bincount(text[order][1:][shared], minlength=n)
                union = np.bincount(ta, minlength=n) + np.bincount(tb, minlength=n) - common
                keep = pa.array(common >= least * union - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string")


def drop_near_duplicates(docs: DataFrame, threshold: int = NEAR_BITS, width: int = SIMILAR_WIDTH, least: float = SIMILAR) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, null after all others, and then the smallest text hash.

    Texts are near if fingerprints of their word sets, of any family, are linked at
    ``threshold`` bits and their sets of ``width``-word shingles have a Jaccard similarity of at
    least ``least``. Links are checked exactly: those of a spanning forest of least
    distance for every anchor, and from every text to one of its fingerprint. Groups
    are the components of what holds.

    Rows equal in doc_id and text count as one. A doc_id that would stay for several
    groups, with a text in each, stays once, with the smallest text hash; null ids
    stay for every one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    hashed = docs.withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))
    fps = scratch.keep(set_fingerprints(hashed.select(F.col("_text").alias("row"), "text")).distinct(), "fps")
    found = None
    for i in range(FAMILIES):
        own = fps.select("row", F.col(f"fp{i}").alias("fp"))
        classes = scratch.keep(own.groupBy("fp").agg(F.min("row").alias("first")), f"classes{i}")
        links = near_links(classes, scratch, threshold, name=f"found{i}")
        first = lambda c, classes=classes: classes.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
        pairs = links.join(first("a"), "a").join(first("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
        pairs = pairs.unionByName(own.join(classes, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")))
        found = pairs if found is None else found.unionByName(pairs)
    pairs = scratch.keep(found.distinct(), "pairs")
    # The texts to compare, each once.
    needed = pairs.select(F.col("a").alias("_text")).unionByName(pairs.select(F.col("b").alias("_text"))).distinct()
    texts = scratch.keep(hashed.select("_text", "text").join(needed, "_text", "left_semi").groupBy("_text").agg(F.first("text").alias("text")), "texts")
    side = lambda c: texts.select(F.col("_text").alias(c), F.col("text").alias(f"text_{c}"))
    roots = connected_components(similar(pairs.join(side("a"), "a").join(side("b"), "b"), width, least), scratch)
    roots = roots.withColumnRenamed("node", "_text")
    key = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("_text").alias("hash"))
    group = hashed.select("doc_id", "_text").join(roots, "_text", "left").groupBy(F.coalesce("root", "_text").alias("_group")).agg(F.min(key).alias("key"))
    keep = group.select(F.col("key.id").alias("_id"), F.col("key.hash").alias("_hash"))
    keep = keep.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_hash").alias("_hash")).unionByName(keep.where("_id IS NULL"))
    keep = scratch.keep(keep, "keep")
    for name in ("fps", "pairs", "texts", *(f"{x}{i}" for x in ("classes", "found") for i in range(FAMILIES))):
        scratch.drop(name)
    same = hashed["doc_id"].eqNullSafe(keep["_id"]) & (hashed["_text"] == keep["_hash"])
    return hashed.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_text"]).drop("_text")
