"""Operators 1, 2, 6 and 10 against brute force on tables with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from deltaweave.llm import sharding, simhash, substring, suffix_tree
from deltaweave.llm._store import Scratch
from deltaweave.llm._text import Bits

from .cases import documents, texts, words


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- suffix tree


def test_suffix_tree_counts_and_base(spark):
    rows = texts()
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows_of(suffix_tree.score_documents(documents(spark))))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [(i, words(t, True) + [b" end"]) for i, t, _ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter(
        (i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens
    )
    assert got == want


class BruteTree:
    """The same tree with dictionaries of word tuples."""

    def __init__(self, texts, depth, least_state, least_entry):
        self.depth, self.unigrams, self.nexts = depth, Counter(), {}
        for ws in texts:
            padded = [b" end", *ws]
            for i in range(1, len(padded)):
                self.unigrams[padded[i]] += 1
                for d in range(1, min(i, depth) + 1):
                    self.nexts.setdefault(tuple(padded[i - d : i]), Counter())[padded[i]] += 1
        self.total = sum(self.unigrams.values())
        once = sum(c == 1 for c in self.unigrams.values())
        self.unknown = min(0.5, (once + 0.5) / (self.total + 1)) if self.total else 1.0
        self.states: dict[tuple, tuple[dict, float]] = {}
        for d in range(1, depth + 1):
            kept = {}
            for s, seen in self.nexts.items():
                n = sum(seen.values())
                if len(s) != d or n < least_state:
                    continue
                share = {x: (c - suffix_tree.DISCOUNT) / n for x, c in seen.items() if c >= least_entry}
                rest = 1 - sum(share.values())
                below = {x: self.p(x, s[1:]) for x in share}
                gain = sum(seen[x] * math.log((share[x] + rest * below[x]) / below[x]) for x in share)
                gain += (n - sum(seen[x] for x in share)) * math.log(rest)
                if gain > suffix_tree.DIVERGENCE * n:
                    kept[s] = (share, rest)
            self.states |= kept

    def p(self, x, context):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (1 - self.unknown) * self.unigrams[x] / self.total if self.unigrams[x] else self.unknown
        share, rest = self.states[context]
        return share.get(x, 0.0) + rest * self.p(x, context[1:])

    def score(self, ws):
        padded = [b" end", *ws]
        return sum(math.log10(self.p(padded[i], tuple(padded[max(0, i - self.depth) : i]))) for i in range(1, len(padded)))


@pytest.mark.parametrize(("words_in_place", "terms_in_place"), [(1 << 18, 1 << 19), (6, 9), (0, 0)])
def test_suffix_tree_against_a_tree_of_dictionaries(spark, monkeypatch, words_in_place, terms_in_place):
    monkeypatch.setattr(suffix_tree, "LEAST_STATE", 5)
    monkeypatch.setattr(suffix_tree, "LEAST_ENTRY", 2)
    rows = texts()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tree = BruteTree([[*words(t, True), b" end"] for i, t, _ in rows if not held(i)], 3, 5, 2)
    assert {len(s) for s in tree.states} == {1, 2, 3}
    want = sorted((str(i), round(tree.score([*words(t, True), b" end"]), 6)) for i, t, _ in rows)
    got = suffix_tree.score_documents(documents(spark), words=words_in_place, terms=terms_in_place)
    got = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in rows_of(got))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(x - y) for (_, x), (_, y) in zip(got, want, strict=True)) < 1e-5
    for s in list(tree.states)[:50]:  # a distribution
        assert abs(sum(tree.p(x, s) for x in tree.unigrams) + tree.p(None, s) - 1) < 1e-9


def test_suffix_tree_at_the_registered_thresholds(spark):
    """All documents of the smallest size, with terms in place and with nearly all of them joined."""
    assert (suffix_tree.LEAST_STATE, suffix_tree.LEAST_ENTRY) == (20, 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], [*words(r["text"], True), b" end"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tree = BruteTree([ws for i, ws in rows if not held(i)], 3, 20, 2)
    assert {len(s) for s in tree.states} == {1, 2, 3}
    want = {i: tree.score(ws) for i, ws in rows}
    for terms in (1 << 21, 1 << 6):
        got = {r["doc_id"]: r["score"] for r in rows_of(suffix_tree.score_documents(docs, terms=terms))}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-5


def test_filters_follow_the_number_of_keys(spark):
    keys = [int(k) for k in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)]
    bits = Bits.of(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    others = np.random.default_rng(2).integers(0, 2**64 - 1, 20_000, np.uint64)
    assert bits.size == Bits.LEAST and bits.has(np.array(keys).view(np.uint64)).all() and bits.has(others).mean() < 0.1
    assert Bits(0, {}).has(others).all()  # beyond what a filter can tell apart


def test_suffix_tree_learns(spark):
    text = " ".join(["a b c d"] * 60)
    docs = documents(spark, [(i, text if i % 2 else text.replace("c", "e"), "s") for i in range(60)])
    for r in rows_of(suffix_tree.score_documents(docs)):
        assert r["score"] > r["base_score"]


def test_suffix_tree_grows_with_the_corpus(spark):
    """What one part of a corpus has taught stays when other texts join it."""
    phrase = "alpha beta gamma delta"
    few = [(i, phrase, "s") for i in range(200)]
    more = [(1000 + i, " ".join(f"x{i}y{j}" for j in range(60)), "s") for i in range(1000)]
    found = []
    for rows in (few, few + more):
        tree = suffix_tree.learn(documents(spark, rows), Scratch(spark, "test"))
        found.append({r["key"] for r in rows_of(tree.terms.where("c = 200"))} - {int(np.uint64(suffix_tree.END ^ suffix_tree.STATE_KEY).view(np.int64))})
    assert len(found[0]) > 4 and found[0] <= found[1]


@pytest.mark.parametrize("rows", [[], [(3, None, None)], [(2, "all held", "s")]])
def test_suffix_tree_small(spark, rows):
    got = rows_of(suffix_tree.score_documents(documents(spark, rows)))
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) for r in got)


# --- SimHash


def brute_fingerprint(text, width=3):
    w = words(text, True)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, threshold):
    root = dict.fromkeys(fps)
    for x in fps:
        root[x] = x
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= threshold:
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {x: find(x) for x in fps}


def test_simhash_whole_table(spark):
    rows = texts()
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in rows_of(simhash.near_duplicates(documents(spark))))
    fps = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    root = brute_components({f for _, f in fps}, 2)
    least: dict[int, int] = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert got == Counter((i, f, least.get(root[f])) for i, f in fps)


@pytest.mark.parametrize(("threshold", "hot"), [(2, 1 << 15), (4, 1 << 15), (2, 3), (4, 2), (3, 4)])
def test_simhash_anchor_links(spark, threshold, hot):
    """Links give the components of all pairs, also where every anchor with a few fingerprints counts as hot."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = [int(x) for x in base]
    for x in base[:20]:
        y = int(x)
        for _ in range(6):  # chains of steps around the threshold
            for b in rng.choice(63, rng.integers(1, threshold + 2), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps += [-1, -2, -(2**63), 2**63 - 1]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint").repartition(3)
    links = [(r["a"], r["b"]) for r in rows_of(simhash.near_links(df, Scratch(spark, "test"), threshold, hot))]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(0 < apart(a, b) <= threshold for a, b in links)
    assert components(fps, links) == components(fps, [(a, b) for a in fps for b in fps if apart(a, b) <= threshold])


def components(nodes, links):
    root = {x: x for x in nodes}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_golay_code_covers():
    patterns, weights, bounds = simhash.golay_errors(5)
    assert len(bounds) == 2049 and all(weights[bounds[s]] <= 3 for s in range(2048))


def test_simhash_keeps_one_of_each(spark):
    kept = [r["doc_id"] for r in rows_of(simhash.drop_near_duplicates(documents(spark)))]
    assert len(kept) == len(set(kept)) and 3 in kept and not {111, 112, 113} & set(kept)
    assert simhash.drop_near_duplicates(documents(spark, [])).columns == documents(spark, []).columns


# --- sharding


def test_sharding(spark):
    rows = texts()
    got = rows_of(sharding.shard_documents(documents(spark), 4))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_text: dict[int, set[int]] = {}
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(v) == 1 for v in by_text.values())


def test_sharding_balance_and_giant(spark):
    rows = [(i, "t%d" % i * (1 + i % 50), "s") for i in range(2000)] + [(10_000 + i, "giant" * 400, "s") for i in range(100)]
    got = rows_of(sharding.shard_documents(documents(spark, rows), 8, items=256))
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    rest = sorted(sums.values())[:-1]
    assert max(sums.values()) >= 100 * 2001 and max(rest) - min(rest) <= 0.01 * max(rest)


def test_differencing_textbook():
    label = sharding.differencing([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, x in zip([8, 7, 6, 5, 4], label, strict=True) if x == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]
    assert sharding.differencing([], 3) == [] and sharding.differencing([5, 5, 5], 3) in ([0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0])


def test_sharding_empty(spark):
    assert rows_of(sharding.shard_documents(documents(spark, []), 4)) == []


# --- repeated passages


def brute_removed(rows, width):
    every = [words(t) for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + width]) for w in every for i in range(len(w) - width + 1))
    out = Counter()
    for (i, _, _), w in zip(rows, every, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("width", "kgram", "batches"), [(35, 12, 3), (35, 12, 1), (8, 3, 4)])
def test_substring(spark, width, kgram, batches):
    rows = texts()
    got = rows_of(substring.remove_repeats(documents(spark), width, kgram, batches))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got) == brute_removed(rows, width)
    for r in got:
        assert sum(e - s for s, e in r["spans"]) == r["n_removed"]


def test_substring_tells_alike_hashing_words_apart(spark):
    """Words that collide under polynomials modulo a power of two, whatever their base."""
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
    common = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{common} {a}", "s"), (2, f"{common} {b}", "s")]
    assert [r["n_removed"] for r in rows_of(substring.remove_repeats(documents(spark, rows)))] == [0, 0]


def test_substring_index_outlives_a_call(spark):
    """Three batches, each added by an index opened anew; together they find what one run over all finds."""
    rows = texts()
    docs = substring.numbered(documents(spark, rows))
    scratch = Scratch(spark, "test")
    docs = scratch.keep(docs, "docs")
    gone: dict[tuple, set] = {}
    for i in range(3):
        index = substring.FingerprintIndex.open(spark, scratch.path("index"), max_runs=1)
        assert len(index.runs) == min(i, 1) and index.version == [0, 1, 3][i]
        new = index.add(docs.where(f"pmod(row, 3) = {i}"), scratch, f"candidates{i}")
        found = substring.verified_ranges(docs.where(f"pmod(row, 3) <= {i}"), new, Scratch(spark, "test"))
        for r in rows_of(found):
            for pos, size in r["ranges"]:
                gone.setdefault((r["row"], r["twin"]), set()).update(range(pos, pos + size - 1 + substring.WINDOW))
    got = Counter((r["doc_id"], len(gone.get((r["row"], r["twin"]), ()))) for r in rows_of(docs))
    want = Counter()
    for (i, _, n, _), c in brute_removed(rows, 35).items():
        want[i, n] += c
    assert got == want
    index.remove()


def test_substring_empty(spark):
    assert rows_of(substring.remove_repeats(documents(spark, []))) == []


def test_minimizers_agree():
    rng = np.random.default_rng(2)
    w = rng.integers(1, 2**63, 300).astype(np.uint64)
    both = np.concatenate([w[:120], rng.integers(1, 2**63, 40).astype(np.uint64), w[30:90]])
    at, h = substring.minimizers(both, np.array([0, 160, 220]), 35, 12)
    first = {int(x) for p, x in zip(at, h, strict=True) if p < 160}
    inside = [int(x) for p, x in zip(at, h, strict=True) if p >= 160]
    assert inside and set(inside) <= first


def test_near_copies_go_and_others_stay(spark):
    """Edits of a few words are caught, whether exact copies or not; texts of equal words in another order stay."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    plain = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, near = [], set()
    for i in range(60):
        w = plain(r.randint(150, 400))
        rows.append((i, " ".join(w), "s"))
        for k in range(i % 4):
            edited = list(w)
            for _ in range(len(w) // 80):
                edited[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((1000 + 10 * i + k, " ".join(edited), "s"))
            near.add(1000 + 10 * i + k)
    mixed = rows[0][1].split()
    r.shuffle(mixed)
    rows.append((5000, " ".join(mixed), "s"))
    kept = {x["doc_id"] for x in rows_of(simhash.drop_near_duplicates(documents(spark, rows)))}
    assert {*range(60), 5000} <= kept and len(kept & near) <= len(near) // 10


def test_similar_against_sets(spark):
    rows = [t for _, t, _ in texts()]
    pairs = [(str(i), str(j), a, b) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t, True) for t in rows)]
    want = {(str(i), str(j)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)}
    df = spark.createDataFrame(pairs, "a string, b string, text_a string, text_b string")
    assert {(r["a"], r["b"]) for r in rows_of(simhash.similar(df))} == want


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    alone, other, third, fourth = (" ".join(f"{w}{i}" for i in range(80)) for w in "abcd")
    rows = [(None, alone, "s0"), (None, other, "s0"), (None, other, "s1")]  # two components of null ids only
    rows += [(1, third, "s0"), (None, third, "s0"), (7, third, "s0"), (7, fourth, "s0")]  # id 7 has a copy and a text of its own
    kept = Counter((r["doc_id"], r["text"]) for r in rows_of(simhash.drop_near_duplicates(documents(spark, rows))))
    assert kept == Counter([(None, alone), (None, other), (1, third), (7, fourth)])
