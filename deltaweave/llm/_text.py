"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the
class ``[^\\x20\\x09-\\x0D]+`` because UTF-8 never uses those bytes inside a
longer sequence. Nothing here loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are hashed so many at a time, which bounds the memory of a task.
PIECE_WORDS = 1 << 17
LONG_WORD = 512
#: Keeps the first k bytes of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
            for b in (base, pow(base, -1, 1 << 64))
        )
        _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (n + 1 entries)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time are mixed into the state; words over LONG_WORD bytes by XXH64.

    The state goes through a bijective non-linear finaliser after every eight bytes,
    so no choice of word gives equal hashes under each seed, as it would under
    polynomials modulo a power of two.
    """
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), PIECE_WORDS):
        s, e = starts[i : i + PIECE_WORDS], ends[i : i + PIECE_WORDS]
        if not len(s):
            break
        lo, hi = int(s[0]), int(e[-1])
        piece = np.zeros(hi - lo + 8, np.uint8)
        piece[: hi - lo] = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        lanes = np.ndarray(hi - lo + 1, np.uint64, piece, strides=(1,))  # eight bytes from every offset on
        out[i : i + PIECE_WORDS] = _hash_lanes(lanes, piece, s - lo, e - s, seed)
    return out


def _hash_lanes(lanes: np.ndarray, piece: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    first = np.uint64(int(mix(np.array([seed * 2 + 1], np.uint64))[0]))
    h = mix(size.astype(np.uint64) + first)
    left = np.flatnonzero(size > 0)
    at, rest = start[left], size[left]
    whole = rest > LONG_WORD
    if whole.any():
        for k in left[whole].tolist():
            h[k] = xxhash.xxh64_intdigest(piece[start[k] : start[k] + size[k]].tobytes(), seed)
        left, at, rest = left[~whole], at[~whole], rest[~whole]
    while len(left):
        lane = lanes[at] & _MASK[np.minimum(rest, 8)]
        h[left] = mix((h[left] ^ lane) * np.uint64(0xD6E8FEB86659FD93))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return h


def window_hashes(words: np.ndarray, width: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive entries (len - width + 1 of them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def tokens(column, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a whole string column, and each text's first word (n + 1 entries)."""
    data, offsets = string_buffers(column)
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends, seed, lower), first


def hash_text(word: bytes, lower: bool = False) -> int:
    """What ``word_hashes`` gives for one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]), lower=lower)[0])


def small_batches(batches, column: int, limit: int = 4 << 20):
    """The same rows in batches whose texts have about ``limit`` bytes (a longer text has one of its own)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = string_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def cut_batch(batch: pa.RecordBatch, rows: int = 1 << 16):
    """The same rows in batches of at most ``rows``, so that no large buffer is needed to take them over."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


class Bits:
    """A filter over uint64 keys, one bit for each value of their leading bits: false positives only.

    It has about 16 slots a key and at most 2**MOST; keys that would fill half of
    those are not filtered at all, since most other keys would pass as well.
    """

    LEAST, MOST = 20, 27

    def __init__(self, size: int, chunks: dict[int, bytes]):
        self.size, self.bits = size, None
        if size:
            self.bits = np.zeros(1 << (size - 3), np.uint8)
            for bucket, raw in chunks.items():  # buckets are numbered from 1
                self.bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(raw, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        slot = (keys >> np.uint64(64 - self.size)).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, keys) -> "Bits":
        """Of the column ``key`` (bigint) of a DataFrame. What reaches the driver is 16 MB at most, whatever the number of keys."""
        count = keys.count()
        if count > 1 << (cls.MOST - 1):
            return cls(0, {})
        size = min(cls.MOST, max(cls.LEAST, (16 * count).bit_length()))
        slot = F.shiftrightunsigned("key", 64 - size) + 1
        rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("raw"))
        return cls(size, {r["bucket"]: bytes(r["raw"]) for r in rows.collect()})


class HashTable:
    """Positions of distinct non-zero uint64 keys, by open addressing; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * max(1, len(keys))))))
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            mine = free & (self.keys[slot] == keys[left])
            self.at[slot[mine]] = left[mine]
            left, step = left[~mine], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        first = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (first.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        slot = self._slot(keys, 0)
        out = np.where(self.keys[slot] == keys, self.at[slot], -1).astype(np.int64)
        left = np.flatnonzero((out < 0) & (self.keys[slot] != 0))
        for step in range(1, self.steps):
            if not len(left):
                break
            slot = self._slot(keys[left], step)
            have = self.keys[slot]
            hit = have == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            left = left[~hit & (have != 0)]
        return out
