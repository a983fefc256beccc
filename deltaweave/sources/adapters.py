"""Adapters: who claims a file, and how its spans are read.

An adapter has a name, ``claims(path, head)`` on the path and the first bytes, and
``spans(content)``. They are asked in order, and the first that claims a file reads
it; a file that none claims is an error that names it. Adapters travel to executors,
so they must be picklable.

``read_spans`` reads what Spark's own reader lists, wherever that is. The data source
``revision_spans`` offers the same by ``spark.read.format``: it opens files itself,
each one partition, and so needs a path that every executor can open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.dealing import dealt
from .documents import SPANS, json_spans
from .sinks import write_lines

#: Bytes of a file that an adapter sees before it claims it.
HEAD = 1024
#: Spans that leave a task at a time.
ROWS = 8192
#: Where a path tells pair and side.
PAIR, SIDE = r"(\d+)", r"/([ab])[^/]*$"
FOUND = f"adapter string, path string, {SPANS}"


class Adapter(Protocol):
    name: str

    def claims(self, path: str, head: bytes) -> bool: ...

    def spans(self, content: bytes) -> Iterator[dict]: ...


@dataclass(frozen=True)
class JsonLines:
    """Spans as one JSON object a line."""

    name: str = "json_lines"

    def claims(self, path: str, head: bytes) -> bool:
        return path.lower().endswith((".jsonl", ".json")) or path.lower().endswith(".txt") and head.lstrip()[:1] == b"{"

    def spans(self, content: bytes) -> Iterator[dict]:
        return json_spans(content)


@dataclass(frozen=True)
class Tabbed:
    """Spans as lines of x0, y0, x1, y1 and text, parted by tabs; other lines are skipped."""

    name: str = "tabbed"

    def claims(self, path: str, head: bytes) -> bool:
        return path.lower().endswith((".tsv", ".txt")) and head.split(b"\n", 1)[0].count(b"\t") >= 4

    def spans(self, content: bytes) -> Iterator[dict]:
        for line in content.decode("utf-8", "replace").splitlines():
            parts = line.split("\t", 4)
            try:
                box = dict(zip(("x0", "y0", "x1", "y1"), map(float, parts[:4]), strict=True))
            except ValueError:
                continue
            if len(parts) == 5:
                yield {**box, "text": parts[4]}


@dataclass(frozen=True)
class Drawing:
    """DWG drawings are recognised, but nothing here reads them."""

    name: str = "dwg"

    def claims(self, path: str, head: bytes) -> bool:
        return path.lower().endswith(".dwg") or head[:4] == b"AC10"

    def spans(self, content: bytes) -> Iterator[dict]:
        raise NotImplementedError("no reader for dwg files")


ADAPTERS: tuple[Adapter, ...] = (JsonLines(), Tabbed(), Drawing())


def resolve(path: str, head: bytes, adapters: Sequence[Adapter] = ADAPTERS) -> Adapter:
    """The first adapter that claims a file."""
    for adapter in adapters:
        if adapter.claims(path, head):
            return adapter
    raise ValueError(f"no adapter claims {path}")


def _rows(path: str, content: bytes, adapters: Sequence[Adapter], pair: str, side: str) -> Iterator[tuple]:
    adapter = resolve(path, content[:HEAD], adapters)
    number, letter = re.search(pair, path), re.search(side, path.lower())
    key = int(number[1]) if number else None, letter[1].upper() if letter else ""
    for i, s in enumerate(adapter.spans(content)):
        box = [float(s[k]) for k in ("x0", "y0", "x1", "y1")]
        yield (adapter.name, path, *key, int(s.get("sheet", 1)), i, str(s["text"]), *box, float(s.get("origin_x", box[0])), float(s.get("origin_y", box[3])), float(s.get("size", 10)))


def read_spans(files: DataFrame, adapters: Sequence[Adapter] = ADAPTERS, pair: str = PAIR, side: str = SIDE) -> DataFrame:
    """FOUND of files(path, content): each is read whole by the first adapter that claims it."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        found = (row for pdf in batches for r in pdf.itertuples() for row in _rows(r.path, bytes(r.content), adapters, pair, side))
        while rows := list(islice(found, ROWS)):  # small files share a frame, a large one has many
            yield pd.DataFrame(rows, columns=names).astype({"pair_id": "Int64", "sheet": "int32", "ord": "int32"})

    return files.select("path", "content").mapInPandas(run, FOUND)


def claimed(files: DataFrame, adapters: Sequence[Adapter] = ADAPTERS) -> DataFrame:
    """path, adapter (null if none claims it) of files(path, content); only the first bytes leave the JVM."""

    @F.pandas_udf("string")
    def name(path: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([next((a.name for a in adapters if a.claims(p, bytes(h or b""))), None) for p, h in zip(path, head, strict=True)], dtype=object)

    return files.select("path", name("path", F.substring("content", 1, HEAD)).alias("adapter"))


@dataclass
class File(InputPartition):
    path: str


class SpansReader(DataSourceReader):
    def __init__(self, options: dict, adapters: Sequence[Adapter]):
        self.root, self.pair, self.side, self.adapters = options["path"], options.get("pair", PAIR), options.get("side", SIDE), adapters

    def partitions(self) -> Sequence[File]:
        """One for each file below the path, in the order of names."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(p) for p in sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))]

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        with store.open_input_stream(partition.path) as stream:
            yield from _rows(partition.path, stream.read(), self.adapters, self.pair, self.side)


def source(adapters: Sequence[Adapter] = ADAPTERS, name: str = "revision_spans") -> type[DataSource]:
    """A data source of these adapters, to be registered."""

    class Spans(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FOUND

        def reader(self, schema) -> SpansReader:
            return SpansReader(dict(self.options), adapters)

    return Spans


def register(spark: SparkSession, adapters: Sequence[Adapter] = ADAPTERS, name: str = "revision_spans") -> None:
    """``spark.read.format(name).load(path)`` reads the spans of all files below a path from now on."""
    spark.dataSource.register(source(adapters, name))


def write_spans(spans: DataFrame, path: str) -> DataFrame:
    """Files of json lines, in folders by pair; a file holds spans of one pair and side alone, in the order of ord. Gives their paths."""
    line = F.to_json(F.struct("sheet", "text", "x0", "y0", "x1", "y1", "origin_x", "origin_y", "size"))
    rows = dealt(spans.select("pair_id", F.lower("side").alias("side"), "ord", line.alias("value")), "pair_id", "side").sortWithinPartitions("pair_id", "side", "ord")
    folder = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.translate(F.url_encode(F.col(c).cast("string")), "%", "="), F.lit("__HIVE_DEFAULT_PARTITION__")))
    # Tasks open their own files; Spark's committer moves each, and its local file system starts processes for them.
    return write_lines(rows.select(F.concat_ws("/", folder("pair_id"), folder("side"), F.lit("spans.txt")).alias("name"), "value"), path)
