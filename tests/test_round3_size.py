"""Findings of round 3 about size: what is shuffled, and the same results."""

from __future__ import annotations

import random

from deltaweave.operators import identity


def shuffled(spark, df) -> int:
    """Bytes that running df writes to shuffles."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()

    def total() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def documents(spark, folder, texts) -> str:
    """Folder with these texts as documents, numbered from 1."""
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_similar_sets_against_all_pairs(spark):
    r = random.Random(12)
    for least in (0.3, 0.5, 0.8, 1.0):
        sets = {i: {r.choice("abcdefghij") if r.random() < 0.3 else f"{r.randrange(60)}" for _ in range(r.randrange(1, 14))} for i in range(150)}
        sets |= {200: {"alone"}, 201: {"only", "here"}, 202: sets[3], 203: sets[3]}
        df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item string")
        want = {(a, b, len(s & t)) for a, s in sets.items() for b, t in sets.items() if a < b and len(s & t) / len(s | t) >= least}
        got = identity.similar_sets(df, "id", "item", least).collect()
        assert {(x["a"], x["b"], x["shared"]) for x in got} == want and len(got) == len(want)


def test_revision_pairs_shuffle_no_texts(spark, tmp_path):
    from deltaweave.queries import revision_pairs

    r = random.Random(5)
    line = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    texts = ["\n".join(line() for _ in range(8)) for _ in range(200)]
    texts.append(texts[0])
    found = revision_pairs(spark, documents(spark, tmp_path, texts))
    assert [tuple(x) for x in found.collect()] == [(1, 201, 8, 1.0)]
    assert shuffled(spark, found) < sum(map(len, texts)) / 2


def test_runs_of_bands_in_one_stream(spark):
    from deltaweave.operators import runs

    r = random.Random(13)
    words = [(p, "A", 1, i, f"w{i}", str(r.randrange(30, 99)), r.randrange(40) * 7.0, float(r.choice([3, 4, 5, 20, 22, 60])), float(r.randrange(2, 9)), float(r.choice([4, 10]))) for p in range(40) for i in range(r.randrange(1, 400))]
    words += [(99, "A", 1, i, f"v{i}", "50", float(i), 8.0, 1.0, 10.0) for i in range(25000)]  # a band of several batches
    df = spark.createDataFrame(words, "pair_id long, side string, sheet int, ord int, text string, conf string, left double, top double, width double, height double")
    want = set()
    pages = {}
    for w in sorted(words, key=lambda w: (w[0], w[7], w[6], w[3])):
        bands = pages.setdefault(w[0], [])
        if not bands or abs(w[7] - bands[-1][0][7]) > 0.5 * bands[-1][0][9]:
            bands.append([])
        bands[-1].append(w)
    for p, bands in pages.items():
        for n, band in enumerate(bands, 1):
            line, found = sorted(band, key=lambda w: (w[6], w[3])), []
            for w in line:
                gap = w[6] - (found[-1][-1][6] + found[-1][-1][8]) if found else -1
                if not (found and 0 <= gap <= 3 * found[-1][-1][9]):
                    found.append([])
                found[-1].append(w)
            want |= {(p, n, k, " ".join(w[4] for w in ws), min(w[6] for w in ws), min(w[7] for w in ws), max(w[6] + w[8] for w in ws), max(w[7] + w[9] for w in ws), len(ws)) for k, ws in enumerate(found, 1)}
    made = runs.band_runs(runs.clean_words(df))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(x["pair_id"], x["band"], x["run"], x["text"], x["left"], x["top"], x["right"], x["bottom"], len(x["text"].split())) for x in made.collect()}
    assert got == want


def test_bm25_shuffles_no_scores_but_the_best(spark, tmp_path):
    from deltaweave.queries import bm25_topk

    r = random.Random(16)
    folder = documents(spark, tmp_path, [" ".join(r.choices(["valve", "pump", "pipe", "tank", "hose"], k=3)) for _ in range(2000)])
    spark.createDataFrame([(i, "valve pump pipe tank hose") for i in range(1, 101)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = bm25_topk(spark, folder)
    best = {}
    for x in found.collect():
        best.setdefault(x["question_id"], []).append((x["rank"], x["doc_id"], x["score"]))
    assert len(best) == 100 and len({tuple(sorted(b)) for b in best.values()}) == 1 and len(best[1]) == 8
    assert shuffled(spark, found) < 300_000


def test_search_deals_questions_and_chunks_by_pair(spark):
    from deltaweave.queries import chunk_search

    plan = chunk_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
