"""Adapters and the data source over files."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pytest

from deltaweave.sources import adapters, documents


def lines(*spans):
    return "".join(json.dumps(s) + "\n" for s in spans).encode()


SPAN = {"text": "PIT 1", "x0": 1, "y0": 2, "x1": 3, "y1": 4}


@pytest.fixture
def folder(tmp_path):
    for name, content in {
        "7/a.jsonl": lines(SPAN, {"text": None, "x0": 1}, {**SPAN, "sheet": 2, "size": 8}), "7/b.txt": b"1\t2\t3\t4\tpump\twith tab\nnot a span\n5\t6\t7\t8\t\n", "8/a.json": b"",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def plain(df):
    return sorted((r["adapter"], r["pair_id"], r["side"], r["sheet"], r["ord"], r["text"], r["x0"], r["origin_y"], r["size"]) for r in df.collect())


WANT = [("json_lines", 7, "A", 1, 0, "PIT 1", 1.0, 4.0, 10.0), ("json_lines", 7, "A", 2, 1, "PIT 1", 1.0, 4.0, 8.0), ("tabbed", 7, "B", 1, 0, "pump\twith tab", 1.0, 4.0, 10.0), ("tabbed", 7, "B", 1, 1, "", 5.0, 8.0, 10.0)]


def test_both_readers(spark, folder):
    pair = r"/(\d+)/[ab]\."
    assert plain(adapters.read_spans(documents.files(spark, str(folder)), pair=pair)) == WANT
    adapters.register(spark)
    for path in (str(folder), f"file://{folder}"):
        found = spark.read.format("revision_spans").option("pair", pair).load(path)
        assert plain(found) == WANT and found.rdd.getNumPartitions() == 3  # a file each
    assert len(plain(spark.read.format("revision_spans").option("pair", pair).load(f"{folder}/7/b.txt"))) == 2
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("revision_spans").load(f"{folder}/none").collect()


def test_a_file_that_none_claims(spark, folder):
    (folder / "9").mkdir()
    (folder / "9" / "a.pdf").write_bytes(b"%PDF-1.4")
    files = documents.files(spark, str(folder))
    assert {r["path"].rsplit("/", 2)[1]: r["adapter"] for r in adapters.claimed(files).where("path LIKE '%a.%'").collect()} == {"7": "json_lines", "9": None}  # Spark passes over empty files
    adapters.register(spark)
    for found in (adapters.read_spans(files), spark.read.format("revision_spans").load(str(folder))):
        with pytest.raises(Exception, match="no adapter claims .*a.pdf"):
            found.collect()


@dataclass(frozen=True)
class Greedy:
    name: str = "greedy"

    def claims(self, path, head):
        return True

    def spans(self, content):
        yield {**SPAN, "text": str(len(content))}


def test_the_first_of_two_claims(spark, folder):
    """Two adapters claim the same file: the order decides, in both readers."""
    files = documents.files(spark, str(folder)).where("path LIKE '%a.jsonl'")
    for order, want in (((Greedy(), *adapters.ADAPTERS), {"greedy"}), ((*adapters.ADAPTERS, Greedy()), {"json_lines"})):
        assert {r["adapter"] for r in adapters.read_spans(files, order).collect()} == want
        adapters.register(spark, order, "ordered_spans")
        found = spark.read.format("ordered_spans").load(f"{folder}/7/a.jsonl").collect()
        assert {r["adapter"] for r in found} == want
    (folder / "1.dwg").write_bytes(b"AC1027")
    with pytest.raises(Exception, match="no reader for dwg"):
        adapters.read_spans(documents.files(spark, str(folder)).where("path LIKE '%dwg'")).collect()


def test_written_spans_come_back(spark, tmp_path):
    names = [c.split()[0] for c in documents.SPANS.split(", ")]
    rows = [(pair, side, 1 + i % 2, i, f'w"{i}é', 1.0 * i, 2.0, 3.0, 4.0, 0.5, 3.5, 9.0) for pair in (1, 22) for side in "AB" for i in range(5)]
    made = spark.createDataFrame(rows, documents.SPANS)
    adapters.write_spans(made, str(tmp_path / "spans"))
    files = documents.files(spark, str(tmp_path / "spans")).where("path LIKE '%.txt'")
    back = adapters.read_spans(files, pair=r"pair_id=(\d+)", side=r"/side=([ab])/")
    assert sorted(tuple(r) for r in back.select(*names).collect()) == sorted(rows)
