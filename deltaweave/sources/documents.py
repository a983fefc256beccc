"""Sources of extracted spans and files.

Decoding PDF pages or running OCR needs libraries that are not assumed here. The
seam is an extractor: a picklable callable from a file's bytes to rows of spans.
``register_extractor`` names one for a kind of file; executors call it in Arrow
batches, one file at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dealing import dealt
from .sinks import store

SPANS = "pair_id long, side string, sheet int, ord int, text string, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, size double"
FILES = "path string, extension string, magic string, length long, content binary"

Extractor = Callable[[bytes], Iterator[dict]]
_extractors: dict[str, Extractor] = {}


def register_extractor(kind: str, extractor: Extractor) -> None:
    _extractors[kind] = extractor


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, magic (first two bytes), length, content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.substring(F.col("content"), 1, 2).cast("string").alias("magic"), "length", "content")


#: Bytes of files that travel at a time; a longer file stands alone.
BATCH = 1 << 22


def opened(files: DataFrame) -> DataFrame:
    """path, content of files whose paths are known; tasks open them, and no folder is listed."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches):
        paths, contents, held = [], [], 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            files_of, name = store(path)
            with files_of.open_input_stream(name) as stream:
                content = stream.read()
            paths.append(path)
            contents.append(content)
            held += len(content)
            if held >= BATCH or len(paths) >= 4096:
                yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, schema)
                paths, contents, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths, "content": contents}, schema)

    # Paths are a few bytes, and what they name is not.
    return dealt(files.select("path"), "path").mapInArrow(run, "path string, content binary")


def is_dwg(extension, magic):
    """DWG is recognised, but there is no reader for it."""
    return (extension == "dwg") & (magic == "AC")


def json_spans(content: bytes) -> Iterator[dict]:
    """Spans stored one JSON object a line; lines and spans that are not whole are skipped."""
    for line in content.decode("utf-8", "replace").splitlines():
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and row.get("text") is not None and all(isinstance(row.get(k), (int, float)) for k in ("x0", "y0", "x1", "y1")):
            yield row


register_extractor("jsonl", json_spans)


def extract_spans(found: DataFrame, pair_id: str = r"(\d+)", side: str = r"/([ab])[^/]*$") -> DataFrame:
    """Spans of every file with an extractor; the path tells the pair and the side. A file of a kind without one raises."""
    known = dict(_extractors)
    names = [c.split()[0] for c in SPANS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.extension not in known:
                    raise NotImplementedError(f"no extractor for {r.extension} files: {r.path}")
                for i, s in enumerate(known[r.extension](bytes(r.content))):
                    rows.append((r.pair_id, r.side, s.get("sheet", 1), i, s["text"], *[float(s[k]) for k in ("x0", "y0", "x1", "y1")], float(s.get("origin_x", s["x0"])), float(s.get("origin_y", s["y1"])), float(s.get("size", 10))))
            yield pd.DataFrame(rows, columns=names).astype({"pair_id": "int64", "sheet": "int32", "ord": "int32"})

    keyed = found.select("path", "extension", "content", F.regexp_extract("path", pair_id, 1).try_cast("long").alias("pair_id"), F.upper(F.regexp_extract(F.lower("path"), side, 1)).alias("side"))
    return keyed.mapInPandas(run, SPANS)
