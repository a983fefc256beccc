"""The five stages against brute force on a small corpus where every decision is known."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from deltaweave.llm import quality

from .cases import words
from .test_native_operators import shingles

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghij", k=4)) for _ in range(900)]
    plain = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = []
    for i in range(400):
        w = plain(60)
        rows.append((i, " ".join(f"{x}***" if i % 3 == 0 and j % 2 else x for j, x in enumerate(w))))
    item = " ".join(plain(30))
    rows += [(1000 + k, " ".join(plain(50)) + " " + item + " " + " ".join(plain(50))) for k in range(3)]
    rows += [(2000 + k, rows[1][1]) for k in range(5)] + [(None, rows[2][1]), (None, " ".join(plain(70)))]  # copies; null ids, one with a text of its own
    for k in range(6):  # near copies: one word of 200 differs
        w = plain(200)
        rows.append((3000 + 2 * k, " ".join(w)))
        w[100] = "changed"
        rows.append((3001 + 2 * k, " ".join(w)))
    rows += [(1, rows[1][1])]  # a repeated row
    return [(i, t, "en", f"s{(i or 0) % 4}", len(t)) for i, t in rows], item


def loop_score(net: quality.Network, text: str) -> float:
    """The network on one text, window by window."""
    raw = bytes(quality.WIDTH) + text.encode()
    segments = max(1, -(-(len(text.encode()) + quality.WIDTH) // quality.SPAN))
    raw += bytes(segments * quality.SPAN + quality.WIDTH - len(raw))
    best = []
    for s in range(segments):
        acts = []
        for w in range(quality.SEGMENT):
            at = s * quality.SPAN + w * quality.STRIDE
            acts.append(np.concatenate([net.p["emb"][b] for b in raw[at : at + quality.WIDTH]]) @ net.p["conv"] + net.p["bias"])
        best.append(np.maximum(np.max(acts, axis=0), 0))
    chunks = [np.maximum(best[i], best[i + 1]) if i + 1 < segments else best[i] for i in range(segments)]
    both = [np.concatenate([c, np.maximum(c @ net.p["deep"] + net.p["deep_bias"], 0)]) for c in chunks]
    z = float(np.concatenate([np.max(both, axis=0), np.mean(both, axis=0)]) @ net.p["out"] + net.p["out_bias"][0])
    return 1 / (1 + np.exp(-z))


def test_network_against_a_loop():
    rng = np.random.default_rng(5)
    net = quality.Network()
    net.p["out"][:] = rng.normal(0, 0.5, len(net.p["out"]))
    for n in (0, 1, 7, 8, 119, 120, 121, 128, 400):
        text = "".join(rng.choice(list("abc dé,")) for _ in range(n))
        raw = np.frombuffer(text.encode(), np.uint8)
        assert abs(net.score(raw, np.array([0, len(raw)]))[0] - loop_score(net, text)) < 1e-4


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipeline"))
    rows, item = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    marks = [(i, int("***" not in t), 0) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def similar(a: str, b: str) -> bool:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a, True), words(b, True)))
    return len(x & y) >= 0.8 * len(x | y)


def brute(spark, sf_dir):
    """Rows left after the first four stages."""
    rows, item = corpus()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if loop_score(net, r[1]) >= quality.THRESHOLD]
    assert not any("***" in r[1] for r in rows)
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    kept: list = []
    for r in rows:  # of each group the first; groups here have no chains
        if not any(similar(r[1], k[1]) for k in kept):
            kept.append(r)
    wanted = shingles(item)
    return [r for r in kept if len(wanted & shingles(r[1])) < 0.8 * len(wanted)]


def test_stages_against_brute_force(spark, sf_dir):
    want = brute(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
    assert Counter(tuple(r) for r in docs.collect()) == Counter(want)
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in final) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, *_ in want)
    slots: dict[int, list[int]] = {}
    for r in final:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(corpus_pipeline.SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sums = Counter()
    for r in final:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= max(len(t) for _, t, *_ in want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
