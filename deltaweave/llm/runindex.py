"""Removal of repeated byte strings through run-length indexes (Burrows-Wheeler).

A window is WINDOW consecutive bytes of one document. Every window but the earliest
of equal ones is marked, in the order of documents (by id) and places, and the bytes
that marked windows cover are removed.

Equal windows must meet. Of the CORE-byte strings in a window the one with the least
hash, the leftmost if equal, is its core; equal windows have equal cores at the same
place. Consecutive windows with the same core make a piece, so a core with its pieces
holds every window of that core in all documents. Cores that stand at one place only
are left out after counting; the others deal their pieces to partitions.

In a task whole cores, sorted by document and place, are one text of some 2**20 bytes
with an end after every piece. Its index is the Burrows-Wheeler transform, cut into
runs, with samples at the heads of runs: the suffix there, the one before it in sorted
order, and how many bytes both share. That is enough: streaming the text, the match of
any place with its predecessor is that of the last sampled place less the way from it,
since inside a run the match of one place is that of the next one and a byte more
(matching statistics). The more the pieces repeat each other, the fewer the runs are.
Places whose match is at least WINDOW long are linked to their predecessors; followed
to their ends, links lead all equal windows to one place, and the first of them stays.

Hot cores: equal pieces of a block of input count once, the later ones are settled.
A core that still has more than PIECES pieces is split: equal pieces of all blocks
are reduced to the first, then every piece is divided into the windows that hold more
bytes before the core and those that hold more after it, under a longer core each,
until no core has too many; a core of WINDOW bytes has one piece. So no key is more
than PIECES pieces in a task, and no window is lost.

Exact copies of a whole text are told by two 64-bit hashes (of different seeds) and
only the first of them is looked at; the others are wholly removed.

Defined cases: null and empty texts have no bytes; texts shorter than a window lose
nothing; a null id comes before all others; documents of one id but other texts come
in the order of their hashes; rows equal in id and text are one document, and each
gets its result; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import cut_batch, mix, small_batches, string_buffers
from .substring import _sliding

WINDOW, CORE = 100, 32
#: Pieces of a core that may go to one task.
PIECES = 1 << 13
#: Bytes of pieces that are indexed together, and in which equal pieces are reduced before the shuffle.
INDEX_BYTES, BLOCK_BYTES = 1 << 20, 1 << 22
#: Places of one text that are read at a time.
BATCH_PLACES = 1 << 14
#: Windows whose cores are sought at a time, also in one long text.
SLAB = 1 << 19
#: Symbols that fit one 64-bit number, of nine bits each: a byte plus one, or an end.
PACKED = 7

ORDER = ["doc_id", "t1", "t2", "start"]


def cores(data: np.ndarray, offsets: np.ndarray, window: int, core: int, slab: int = SLAB) -> tuple[np.ndarray, ...]:
    """Of the texts' pieces: hash of the core, text, first window (from the text's start), windows, and place of the core in the piece."""
    none = np.zeros(0, np.int64)
    found = [(none.astype(np.uint64), none, none, none, none)]
    for begin in range(0, len(data) - window + 1, slab):
        found.append(_slab(data[begin : begin + slab + window - 1], begin, offsets, window, core))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _slab(data: np.ndarray, begin: int, offsets: np.ndarray, window: int, core: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    lanes = np.ndarray(n, np.uint64, padded, strides=(1,))
    grams = n - core + 1
    h = np.zeros(grams, np.uint64)
    for at in range(0, core, 8):
        lane = lanes[at : at + grams]
        if core - at < 8:
            lane = lane & np.uint64((1 << 8 * (core - at)) - 1)
        h = (h ^ lane) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h = mix(h)
    # Half of the hash above the place: the least is the leftmost of those with the least hash.
    least = _sliding((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64), window - core + 1, np.minimum)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    places = np.arange(begin, begin + len(at))
    text = np.searchsorted(offsets, places, side="right") - 1
    inside = places + window <= offsets[text + 1]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(fresh & inside)
    stops = np.append(np.flatnonzero(fresh | ~inside), len(at))
    size = stops[np.searchsorted(stops, heads, side="right")] - heads
    return h[at[heads]], text[heads], places[heads] - offsets[text[heads]], size, at[heads] - heads


def _entries(window: int, core: int):
    """h, t1, start, windows, off of every piece; a text met again in the block is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, 1 << 20):
            t1 = batch.column(1).to_numpy(zero_copy_only=False)
            once = np.sort(np.unique(t1, return_index=True)[1])
            if len(once) < len(t1):
                batch, t1 = batch.take(pa.array(once)), t1[once]
            h, text, start, size, off = cores(*string_buffers(batch.column(0)), window, core)
            yield from cut_batch(pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(t1[text]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int16)), pa.array(off.astype(np.int16))],
                ["h", "t1", "start", "windows", "off"],
            ))

    return run


def _pieces(window: int, core: int):
    """The bytes of the named pieces. Of equal ones in a block the first in order stays; the others are settled, without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, ids, t1, t2, start, windows, off, seg = (list(x) for x in zip(*held, strict=True))
            table = pa.table({"doc_id": pa.array(ids, kind), "t1": t1, "t2": t2, "start": pa.array(start, pa.int32())})
            met: dict[tuple[int, bytes], int] = {}
            use = []
            for i in pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ORDER], null_placement="at_start").to_pylist():
                first = met.setdefault((off[i], seg[i]), i)
                if first == i or (t1[first], t2[first], start[first]) != (t1[i], t2[i], start[i]):  # else a row met before
                    use.append((i, first == i))
            made = pa.record_batch({
                "h": pa.array(h, pa.int64()), **{c: table[c].combine_chunks() for c in ORDER}, "windows": pa.array(windows, pa.int16()),
                "off": pa.array(off, pa.int16()), "core": pa.array([core] * len(h), pa.int16()),
            }).take(pa.array([i for i, _ in use]))
            yield from cut_batch(made.append_column("seg", pa.array([seg[i] if kept else None for i, kept in use], pa.binary())), 1 << 14)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ends = batch["places"].offsets.to_pylist()
            place = batch["places"].values
            for i in range(batch.num_rows):  # a text; its pieces are slices
                text = batch["text"][i].as_py().encode()
                doc = tuple(batch[c][i].as_py() for c in ("doc_id", "t1", "t2"))
                for j in range(ends[i], ends[i + 1], BATCH_PLACES):
                    some = place.slice(j, min(BATCH_PLACES, ends[i + 1] - j))
                    for h, s, w, off in zip(*(some.field(c).to_pylist() for c in ("h", "start", "windows", "off")), strict=True):
                        seg = text[s : s + w + window - 1]
                        if len(seg) == w + window - 1:  # else the place is that of another text of equal t1
                            held.append((h, *doc, s, w, off, seg))
                            size += len(seg)
                    if size > BLOCK_BYTES:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return run


# --- the index


def suffixes(packed: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Places in sorted order of what follows them up to the end of their piece; equal ones in the order of places.

    packed: the next PACKED symbols as a number (0 from the end on); rest: symbols up to the end.
    """
    n = len(packed)
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n, np.int64)

    def number(at: np.ndarray, slots: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Give the places at sorted slots the slot of their class's first; which slots are not alone."""
        heads = np.flatnonzero(fresh)
        size = np.diff(np.append(heads, len(at)))
        rank[at] = np.repeat(slots[heads], size)
        return np.repeat(size > 1, size)

    sorted_key = packed[order]
    open_ = np.flatnonzero(number(order, np.arange(n), np.append(True, sorted_key[1:] != sorted_key[:-1])))
    depth, longest = PACKED, int(rest.max(initial=0)) + 1
    while len(open_) and depth < longest:
        at = order[open_]
        ahead = np.where(rest[at] > depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + ahead
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[open_] = at
        open_ = open_[number(at, open_, np.append(True, key[1:] != key[:-1]))]
        depth *= 2
    return order


def matches(text: np.ndarray, rest: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each place its predecessor in sorted order and how many symbols both share, from samples at the heads of runs; and their number."""
    n = len(text)
    before = text[order - 1]  # the transform; text[-1] is an end
    head = np.append(True, (before[1:] != before[:-1]) | (before[1:] == 0))
    place, other = order[head], order[np.flatnonzero(head) - 1]
    shared = np.zeros(len(place), np.int64)
    most = np.minimum(rest[place], rest[other])
    if len(place) and place[0] == order[0]:
        most[0] = 0  # nothing comes before the first
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = np.maximum(text, 1) - 1
    lanes = np.ndarray(n + 1, np.uint64, wide, strides=(1,))
    left = np.flatnonzero(most > 0)
    while len(left):
        x = lanes[place[left] + shared[left]] ^ lanes[other[left] + shared[left]]
        low = (x & (~x + np.uint64(1))).astype(np.float64)  # the lowest bit that differs
        equal = np.where(x == 0, 8, (np.log2(np.maximum(low, 1.0)) // 8).astype(np.int64))
        shared[left] = np.minimum(shared[left] + equal, most[left])
        left = left[(equal == 8) & (shared[left] < most[left])]
    sampled = np.zeros(n, np.int64)
    link, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    link[place], size[place], sampled[place] = other, shared, place
    last = np.maximum.accumulate(sampled)
    way = np.arange(n) - last
    return link[last] + way, size[last] - way, len(place)


def repeats(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece and start of the windows that also stand earlier (in an earlier piece, or earlier in it)."""
    size = np.array([len(p) for p in pieces])
    ends = np.cumsum(size + 1)
    n = int(ends[-1])
    text = np.zeros(n, np.int16)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16) + 1
    piece = np.repeat(np.arange(len(pieces)), size + 1)
    rest = ends[piece] - 1 - np.arange(n)
    packed = np.zeros(n, np.int64)
    wide = np.concatenate([text, np.zeros(PACKED, np.int16)])
    for i in range(PACKED):
        packed = (packed << 9) | np.where(rest > i, wide[i : i + n], 0)
    link, shared, _ = matches(text, rest, suffixes(packed, rest))
    windows = np.flatnonzero(rest >= window)
    to = np.arange(n)
    tied = windows[shared[windows] >= window]
    to[tied] = link[tied]
    while len(tied):  # each round doubles the way
        further = to[to[tied]]
        moved = further != to[tied]
        to[tied] = further
        if not moved.any():
            break
    first = np.full(n, n)
    first[to[windows[::-1]]] = windows[::-1]  # the smallest is written last
    marked = windows[windows > first[to[windows]]]
    return piece[marked], marked - (ends - size - 1)[piece[marked]]


def _marks(window: int):
    """t1, t2, start, windows: marked runs of windows of pieces sorted by (h, seg, order), whose cores are whole in this partition."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        seg, h = table["seg"].to_pylist(), table["h"].to_numpy()
        n = len(seg)
        again = np.fromiter((i > 0 and h[i] == h[i - 1] and seg[i] == seg[i - 1] for i in range(n)), bool, n)
        t1, t2, start, windows = (table[c].to_numpy() for c in ("t1", "t2", "start", "windows"))
        # Equal pieces: all but the first, as sorted, and what stands for the same place.
        first = np.maximum.accumulate(np.where(again, 0, np.arange(n)))
        later = again & ((t1 != t1[first]) | (t2 != t2[first]) | (start != start[first]))
        out = [(t1[later], t2[later], start[later], windows[later])]
        kept = table.filter(pa.array(~again))
        order = pc.sort_indices(kept, sort_keys=[(c, "ascending") for c in ("h", *ORDER)], null_placement="at_start")
        kept = kept.take(order)
        h = kept["h"].to_numpy()
        many = np.zeros(len(h), bool)
        many[1:] |= h[1:] == h[:-1]
        many[:-1] |= h[1:] == h[:-1]
        kept = kept.filter(pa.array(many))
        if len(kept):
            piece, at = repeats(kept["seg"].to_pylist(), window)
            begin = np.append(True, (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)) if len(piece) else np.zeros(0, bool)
            s = np.flatnonzero(begin)
            t1, t2, start = (kept[c].to_numpy()[piece[s]] for c in ("t1", "t2", "start"))
            out.append((t1, t2, start + at[s], np.diff(np.append(s, len(piece)))))
        a, b, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
        yield from cut_batch(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32))], ["t1", "t2", "start", "windows"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch["seg"].nbytes
            if size > INDEX_BYTES:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                last = int(np.flatnonzero(np.append(True, h[1:] != h[:-1]))[-1])  # the last core may go on
                if last:
                    yield from solve(table.slice(0, last))
                    table = table.slice(last)
                held, size = table.combine_chunks().to_batches(), 0
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def halves(pieces: DataFrame, window: int) -> DataFrame:
    """Each piece as the windows that hold more bytes before its core, and those that hold more after it, under longer cores."""
    core, off, last = F.col("core"), F.col("off"), F.length("seg") - window
    more = F.ceil((window - core) / 2).cast("int")

    def part(first: Column, stop: Column, at: Column, size: Column) -> Column:
        seg = F.substring("seg", first + 1, stop - first + window)
        key = F.xxhash64(size, F.substring("seg", at + 1, size))
        there = [key.alias("h"), (F.col("start") + first).cast("int").alias("start"), (stop - first + 1).cast("smallint").alias("windows"), (at - first).cast("smallint").alias("off"), size.cast("smallint").alias("core"), seg.alias("seg")]
        return F.when(stop >= first, F.struct(*there))

    before = part(F.lit(0), F.least(off - more, last), off - more, core + more)
    after = part(F.greatest(F.lit(0), off - more + 1), last, off, F.lit(window) - more + 1)
    both = pieces.select("doc_id", "t1", "t2", F.explode(F.array_compact(F.array(before, after))).alias("p"))
    return both.select("p.h", "doc_id", "t1", "t2", "p.start", "p.windows", "p.off", "p.core", "p.seg")


def _first(columns: list[str]) -> Column:
    return F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), *columns))


def marked_windows(pieces: DataFrame, scratch: Scratch, window: int = WINDOW, most: int = PIECES) -> DataFrame:
    """t1, t2, start, windows: the marked windows of stored pieces, in runs."""
    marks = [pieces.where("seg IS NULL").select("t1", "t2", "start", F.col("windows").cast("int"))]
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hot_of(rows: DataFrame, round_: int) -> DataFrame:
        """Cores with too many pieces, at most one for so many of them: a few files."""
        found = rows.groupBy("h").count().where(F.col("count") > most).select("h")
        return scratch.keep(found.repartition(-(-parts // 64)), f"hot{round_}")

    rows = pieces.where("seg IS NOT NULL")
    hot = hot_of(rows, 0)
    indexed = [rows.join(hot, "h", "left_anti").select(*rows.columns)]
    rows, round_ = rows.join(hot, "h", "left_semi").select(*rows.columns), 0
    while not hot.isEmpty():
        round_ += 1
        firsts = rows.groupBy("h", "seg").agg(_first(ORDER).alias("first"))
        same = ["t1", "t2", "start"]
        told = rows.join(firsts, ["h", "seg"]).withColumn("one", F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & F.expr(" AND ".join(f"first.{c} = {c}" for c in same)))
        told = scratch.keep(told.drop("first"), f"told{round_}")
        marks.append(told.where("NOT one").select("t1", "t2", "start", F.col("windows").cast("int")))
        rows = told.where("one").select(*rows.columns).dropDuplicates(["h", "seg"])
        hot = hot_of(rows, round_)
        indexed.append(rows.join(hot, "h", "left_anti").select(*rows.columns))
        rows = halves(rows.join(hot, "h", "left_semi"), window)
    every = indexed[0]
    for more in indexed[1:]:
        every = every.unionByName(more)
    dealt = every.select("h", *ORDER, "windows", "seg").repartition(parts, "h").sortWithinPartitions("h", "seg", *ORDER)
    out = dealt.mapInArrow(_marks(window), "t1 bigint, t2 bigint, start int, windows int")
    for m in marks:
        out = out.unionByName(m)
    return out


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            kept, total, spans = [], [], []
            for text, copy, found in zip(batch["text"].to_pylist(), batch["copy"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
                raw = text.encode()
                ranges = [(r["start"], r["start"] + r["windows"] - 1 + window) for r in found or ()]
                if copy:
                    ranges = [(0, len(raw))] if len(raw) >= window else []
                merged: list[list[int]] = []
                for s, e in sorted(ranges):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                out, at = [], 0
                for s, e in merged:
                    out.append(raw[at:s])
                    at = e
                kept.append(b"".join([*out, raw[at:]]))
                total.append(len(raw))
                spans.append(merged)
            gone = [t - len(k) for t, k in zip(total, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "kept", "n_bytes", "n_removed", "spans"],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, core: int = CORE, most: int = PIECES) -> DataFrame:
    """doc_id, kept (bytes, which may end inside a character), n_bytes, n_removed, spans (byte ranges removed) for every row."""
    scratch = Scratch(docs.sparkSession, "runindex")
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("twin"), text).alias("t2"))
    firsts = scratch.keep(rows.groupBy("t1", "t2").agg(_first(["doc_id"]).alias("first")).select("t1", "t2", F.col("first.doc_id").alias("first")), "firsts")

    entries = scratch.keep(rows.where(F.octet_length("text") >= window).select("text", "t1").mapInArrow(_entries(window, core), "h bigint, t1 bigint, start int, windows smallint, off smallint"), "entries")
    place = F.xxhash64("t1", "start")
    # Stored, so that a hot core's rows can be split in the join.
    repeated = scratch.keep(entries.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("h"), "repeated")
    places = entries.join(repeated, "h", "left_semi").groupBy("t1").agg(F.collect_set(F.struct("h", "start", "windows", "off")).alias("places"))
    places = scratch.keep(places.join(firsts, "t1").select("t1", "t2", F.col("first").alias("doc_id"), "places"), "places")
    scratch.drop("entries")
    # A text with pieces, once: of rows equal in id and text only the bytes count, and equal pieces of one place are one.
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("t1", "t2", "doc_id")]
    found = rows.alias("r").join(places.alias("p"), same[0] & same[1] & same[2]).select("r.doc_id", "r.t1", "r.t2", "r.text", "p.places")
    made = f"h bigint, doc_id {kind}, t1 bigint, t2 bigint, start int, windows smallint, off smallint, core smallint, seg binary"
    pieces = scratch.keep(found.mapInArrow(_pieces(window, core), made), "pieces")
    scratch.drop("places")
    marks = marked_windows(pieces, scratch, window, most)
    ranges = marks.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "windows")).alias("ranges"))
    told = scratch.keep(firsts.join(ranges, ["t1", "t2"], "left"), "told")
    scratch.drop("pieces")
    copy = ~F.col("first").eqNullSafe(F.col("doc_id"))
    return rows.join(told, ["t1", "t2"]).select("doc_id", "text", copy.alias("copy"), "ranges").mapInArrow(
        _cut(window), f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, spans array<array<int>>"
    )
