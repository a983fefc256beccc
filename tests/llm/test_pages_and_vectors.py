"""Operators 3, 4, 5 and 7."""

from __future__ import annotations

import gzip
import hashlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.llm import archives, extraction, neighbours, quality
from deltaweave.llm._store import Scratch

from .cases import documents, texts

PAGES = "page_id bigint, url string, html string, text string, digest string, n int"


def page_rows():
    long_ = "<p>" + "wort " * 400 + "</p>"
    body = "<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First\n  part&nbsp;here.</p><p>Second <b>bold</b> part.</p></article><footer>&copy; all rights reserved</footer></body></html>"
    rows = [(1, "http://a/1", body), (2, "http://a/2", body.replace("First", "Other")), (3, "http://a/3", None), (4, None, ""), (5, "", "<script>x</script>"), (6, "http://a b/6", long_), (7, "http://a/7", long_), (8, "http://a/8", long_)]
    rows += [(8, "http://a/8", long_), (None, "http://a/9", long_), (9, "u", "plain text"), (10, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nfiledesc://x 0 1\n" + "é" * 600), (11, "u", "<p>unclosed <b>x<p>y <!-- no end")]
    return [(*r, "x", "y", 3) for r in rows]


def pages(spark, rows=None):
    return spark.createDataFrame(page_rows() if rows is None else rows, PAGES)


# --- extraction


def test_open_head_ends_at_body():
    for start in ("<body>", ""):
        page = f"<!DOCTYPE html><html><head><title>t</title><meta charset=utf-8>{start}<div class=a><p>one</div><header>two</header>"
        assert [b[0] for b in extraction.blocks(page)] == ["one", "two"]
    assert [b[1].path() for b in extraction.blocks("<html><head><title>t</title><body><p>x")] == [("html", "body", "p")]
    assert [b[0] for b in extraction.blocks("<html><head><title>t</title></head><body><p>x")] == ["x"]
    assert [b[0] for b in extraction.blocks("<html><head><noscript><p>no</p></noscript><body><p>x")] == ["x"]


def test_whole_path_is_read():
    deep = "<div>" * 30 + "<p>x"
    (a,), (b,) = extraction.blocks("<nav class=menu>" + deep), extraction.blocks(deep)
    assert len(a[1].path()) == 32 and (extraction.path_vector(a[1]) != extraction.path_vector(b[1])).any()
    slow = np.zeros(extraction.PATH, int)
    for name in a[1].path():
        tag, _, names = name.partition(" ")
        for word in (tag, *(f".{x}" for x in names.split())):
            slow[extraction._slot(word, extraction.PATH)] += 1
    slow[extraction._slot("last p", extraction.PATH)] += 1
    assert (extraction.path_vector(a[1]) == np.minimum(slow, 2)).all()


@pytest.mark.parametrize("page", ["<div>word " * 40_000, "<b>x" * 30_000 + "<h1>y" * 30_000, "<p>" + "<div><b>" * 20_000 + "</i>" * 50_000 + "z<h2>" * 20_000])
def test_malformed_pages_take_little(page):
    """Memory and time grow with the page, however deep it nests."""
    import time
    import tracemalloc

    tracemalloc.start()
    t = time.time()
    found = extraction.blocks(page)
    kept = extraction.Labeller().keep([found])
    assert len(kept[0]) == len(found) and time.time() - t < 60
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def loop_logits(net, x):
    """One page's logits, step by step."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    n, size = len(x), extraction.HIDDEN
    out = [float(net.p["bias"][0]) + float(x[t] @ net.p["direct"]) for t in range(n)]
    for k, d in enumerate("fb"):
        h, c = [0.0] * size, [0.0] * size
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a = x[t] @ net.p[f"{d}x"] + net.p[f"{d}b"] + np.array(h) @ net.p[f"{d}h"]
            c = [sig(a[size + j]) * c[j] + sig(a[j]) * math.tanh(a[3 * size + j]) for j in range(size)]
            h = [sig(a[2 * size + j]) * math.tanh(c[j]) for j in range(size)]
            out[t] += sum(h[j] * float(net.p["out"][k * size + j]) for j in range(size))
    return out


def test_labeller_against_a_loop(monkeypatch):
    net = extraction.trained()
    pages = [b for b, _ in extraction.made_pages(6, seed=700_000)]
    want = [loop_logits(net, extraction.features([p])) for p in pages]
    for most in (4096, 5):  # whole, and in parts
        monkeypatch.setattr(extraction, "LONG_PAGE", most)
        for p, z in zip(pages, want, strict=True):
            assert np.allclose(net.long_logits(p), z, atol=1e-3)
        assert all((k == (np.array(z) > 0)).all() for k, z in zip(net.keep(pages), want, strict=True))


def test_blocks():
    found = [b[0] for b in extraction.blocks(page_rows()[0][2])]
    assert found == ["Home", "News", "Title & more", "First part here.", "Second bold part.", "© all rights reserved"]
    assert extraction.blocks("") == [] and [b[0] for b in extraction.blocks("a < b <i>c</i><br>d<p>e")] == ["a < b c d", "e"]
    assert [b[0] for b in extraction.blocks("<p>unclosed <b>x<p>y <!-- no end")] == ["unclosed x", "y"]
    assert [b[1].path() for b in extraction.blocks("<div class='A b'><p>x</p></div>")] == [("div a b", "p")]
    assert len(extraction.blocks("<p>" * 3000 + "x")) == 1


def test_labeller_on_unseen_pages():
    made = extraction.made_pages(150, seed=500_000)
    kept = extraction.trained().keep([b for b, _ in made])
    right = np.concatenate([k == y for k, (_, y) in zip(kept, made, strict=True)])
    assert right.mean() > 0.985


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = extraction.Labeller()
    for k in net.p:
        net.p[k] = rng.normal(0, 0.2, net.p[k].shape)
    x, sizes, y = rng.normal(0, 1, (7, extraction.INPUT)), np.array([4, 3]), np.array([1, 0, 1, 1, 0, 0, 1.0])
    g = net.gradients(x, sizes, y)

    def loss():
        z = net.logits(x, sizes)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    for k, at in (("fx", (3, 5)), ("bh", (2, 30)), ("fb", (40,)), ("out", (7,)), ("direct", (9,)), ("bias", (0,))):
        keep, step = net.p[k][at], 1e-3
        net.p[k][at] = keep + step
        up = loss()
        net.p[k][at] = keep - step
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3


def test_extract(spark):
    got = {(r["page_id"], r["url"]): r for r in extraction.extract(pages(spark)).collect()}
    assert got[1, "http://a/1"]["text"] == "Title & more\n\nFirst part here.\n\nSecond bold part."
    assert got[3, "http://a/3"]["text"] == "" and got[4, None]["text"] == "" and got[5, ""]["text"] == ""
    assert extraction.extract(pages(spark)).count() == len(page_rows()) and extraction.extract(pages(spark, [])).collect() == []


# --- quality


def test_quality_learns(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        w = rng.choice(vocabulary, 60)
        rows.append((i, " ".join(f"{x}***" if bad and j % 2 else x for j, x in enumerate(w)), "s"))
        labels.append((i, int(not bad), 0, 0.5))
    labels += [(None, 1, 0, 0.5), (7_000, 1, 0, 0.5), (5, None, 0, 0.5), labels[1]]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score double")
    net = quality.train(docs, marks)
    held = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, net).where(quality.held_out(F.col("doc_id"))).collect()}
    assert all((s >= 0.3) == (i % 3 != 0) for i, s in held.items()) and len(held) > 50
    assert quality.keep_good(docs, net).columns == docs.columns
    odd = quality.score_quality(documents(spark), net).collect()
    assert len(odd) == len(texts()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_quality(documents(spark, []), net).collect() == []


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(documents(spark), quality.train(documents(spark), none)).collect()} == {0.5}


def test_quality_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    raw = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 127, 128, 129, 5000, 64, 0)]
    net = quality.Network()
    net.p["out"][:] = rng.normal(0, 1, len(net.p["out"]))
    pack = lambda t: (np.frombuffer(b"".join(t), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in t])]))
    together, alone = net.score(*pack(raw)), np.concatenate([net.score(*pack([t])) for t in raw])
    assert np.allclose(together, alone, atol=1e-5)


def test_quality_gradients():
    rng = np.random.default_rng(2)
    net = quality.Network()
    net.p["out"][:] = rng.normal(0, 0.5, len(net.p["out"]))
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    data, offsets, y = rng.integers(1, 256, 700, dtype=np.uint8), np.array([0, 400, 700]), np.array([1.0, 0.0])
    g = net.gradients(data, offsets, y)

    def loss():
        p = np.clip(net.score(data, offsets), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, at in (("out", (3,)), ("deep", (2, 3)), ("deep_bias", (1,)), ("bias", (4,)), ("out_bias", (0,))):
        keep, step = net.p[k][at], np.float32(1e-2)
        net.p[k][at] = keep + step
        up = loss()
        net.p[k][at] = keep - step
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * step) - g[k][at]) < 0.02 + 0.1 * abs(g[k][at])


# --- archives


def test_archives(spark):
    scratch = Scratch(spark, "test")
    archives.write_arc(pages(spark).repartition(2), scratch.path("arc"), records=4)
    archives.convert(spark, scratch.path("arc"), scratch.path("warc"), records=4)
    got = [r.asDict() for r in archives.read_warc(spark, scratch.path("warc")).collect()]
    rows = [(i, h or "") for i, _, h, *_ in page_rows()]
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((i or 0, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, h in rows)
    kind = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(6, "revisit", 8), (7, "revisit", 8), (None, "revisit", 8), (8, "response", None), (1, "response", None), (3, "response", None)} <= kind
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {h for _, h in rows}
    ids = {r["page_id"]: r["record_id"] for r in got}
    assert all(r["refers_to_id"] == ids[8] for r in got if r["record_type"] == "revisit")


def test_archives_of_other_charsets_and_schemes(spark, tmp_path, monkeypatch):
    """Latin-1 headers and payloads, a DNS record and a URL of raw bytes come out byte for byte; large records have archives of their own."""
    body = f"1 0 x\n{archives.ARC_FIELDS[1]}\n".encode()
    page = "Überschrift café ".encode("latin-1") * 100
    http = b"HTTP/1.0 200 OK\r\nX-Note: caf\xe9\r\nContent-Length: 999\r\n\r\n"
    dns = b"20240102030405\nexample.org. 300 IN A 1.2.3.4\n"
    raw = b"filedesc://f.arc 0.0.0.0 20240101000000 text/plain %d\n%s\n" % (len(body), body)
    records = [(b"http://x/caf\xe9", b"text/html", http + page), (b"dns:example.org", b"text/dns", dns), (b"http://y/", b"no-type", page)]
    for url, mime, content in records:
        raw += b"%s 1.2.3.4 20240102030405 %s %d\n%s\n" % (url, mime, len(content), content)
    (tmp_path / "a.arc").write_bytes(raw)
    monkeypatch.setattr(archives, "SMALL_BYTES", 1000)
    archives.convert(spark, str(tmp_path), str(tmp_path / "warc"))
    got = {r["url"]: r for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert {u: (r["record_type"], bytes(r["payload"])) for u, r in got.items()} == {"http://x/caf%E9": ("response", page), "dns:example.org": ("resource", dns), "http://y/": ("resource", page)}
    assert all(r["payload_bytes"] == len(r["payload"]) and r["date"] == "2024-01-02T03:04:05Z" for r in got.values())
    files = {p.parent.name: gzip.decompress(p.read_bytes()) for p in tmp_path.glob("warc/*/*.gz")}
    assert b"Content-Type: text/dns" in files["small"] and http + page in files["large"] and b"Content-Type: application/octet-stream" in files["large"]


def test_archives_empty(spark):
    scratch = Scratch(spark, "test")
    archives.write_arc(pages(spark, []), scratch.path("arc"))
    archives.convert(spark, scratch.path("arc"), scratch.path("warc"))
    assert archives.read_warc(spark, scratch.path("warc")).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    more = "" if version == 1 else " 200 - - 0 f.arc"
    body = f"{version} 0 x\n{archives.ARC_FIELDS[version]}\n"
    raw = f"filedesc://f.arc 0.0.0.0 20240101000000 text/plain{more} {len(body)}\n{body}\nhttp://x/ 1.2.3.4 20240102030405 text/html{more} 5\na\nb\nc\n".encode()
    for data in (raw, gzip.compress(raw)):
        found = list(archives.read_arc(archives.opened(data)))
        assert [(r.url, r.date, r.content) for r in found] == [("http://x/", "20240102030405", b"a\nb\nc")]
    with pytest.raises(ValueError, match="declares"):
        list(archives.read_arc(io.BytesIO(raw[:-4])))


# --- nearest vectors


def brute_top(rows, k=5, scale=256):
    good = {i: np.array([math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = max(len(v) for v in good.values())
    good = {i: np.pad(v, (0, width - len(v))) for i, v in good.items()}
    out = set()
    for q in good:
        if q % 50 == 0:
            best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id bigint, embedding array<float>, label int, cell int, score double")


def ask(spark, rows, **settings):
    v = vectors(spark, rows)
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.top_k(v, v.where("vec_id % 50 = 0"), **settings).collect()}


@pytest.mark.parametrize("settings", [{}, {"chunk": 64, "most_queries": 3}, {"chunk": 10, "most_queries": 1, "most_pivots": 5}])
def test_neighbours(spark, settings):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 0.2, 16)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one vector fills a third
    rows += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2050, [0.0] * 16), (2100, [1.0, 2.0])]
    assert ask(spark, rows, **settings) == brute_top(rows)


def test_neighbours_replicates_only_what_a_bound_asks_for():
    """Groups of queries far from one another: hardly a row is needed by both."""
    cells = np.array([[100.0, 0.0], [101.0, 0.0], [-100.0, 0.0], [0.0, 100.0]])
    groups = neighbours.merged(cells, np.array([3, 4, 5, 0]), 7)
    assert groups == [[0, 1], [2]]
    assert neighbours.merged(cells, np.array([9, 1, 1, 1]), 4) == [[0], [1, 3, 2]] or neighbours.merged(cells, np.array([9, 1, 1, 1]), 4) == [[0], [1, 2, 3]]


def test_neighbours_repeated_rows(spark):
    """A row stored many times is one row; it does not push others of its vector out."""
    same = [1.0, 0.5]
    rows = [(50, same)] * 8 + [(i, same) for i in range(60, 66)] + [(90, [0.25, 0.25])] * 3
    assert ask(spark, rows) == brute_top(rows) and len(ask(spark, rows)) == 5


def test_neighbours_of_an_id_with_two_vectors(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert ask(spark, rows) == {(50, 1, 1, 65536), (50, 2, 2, 0), (50, 1, 2, 65536), (50, 2, 1, 0)}


def test_neighbours_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (50, [0.5, -3.0])]
    assert ask(spark, rows) == brute_top(rows)
    assert ask(spark, []) == set() and ask(spark, [(50, [1.0])]) == set()


def test_neighbours_large_numbers():
    q, x = np.array([[2.0**31, 3.0]]), np.array([[2.0**30, 1.0]])
    assert neighbours.products(q, x)[0, 0] == 2**61 + 3
