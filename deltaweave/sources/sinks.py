"""Files written by executors: one for each row, or one for rows that follow each other."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def store(root: str):
    """The file system of a path and the path in it, on the machine that asks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class FilesWriter(DataSourceWriter):
    """Rows (name, content) as files below a path. A file appears under its name once it is whole, so a repeated task leaves the same files."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> Written:
        files_of, root = store(self.root)
        files_of.create_dir(root, recursive=True)
        files = []
        for row in rows:
            name = row["name"]
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"a file's name must stay below the folder: {name}")
            whole = f"{root}/{name}"
            files_of.create_dir(whole.rsplit("/", 1)[0], recursive=True)
            part = f"{whole}.{uuid.uuid4().hex}.part"
            with files_of.open_output_stream(part) as stream:
                stream.write(bytes(row["content"]))
            files_of.move(part, whole)
            files.append(name)
        return Written(files)

    def abort(self, messages) -> None:
        """Whole files of tasks that ended stay; a later run writes them anew."""


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options)["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)


def write_files(rows: DataFrame, path: str) -> None:
    """Each of rows(name, content) as a file below a path that all executors share."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("named_files").mode("append").save(path)


def write_lines(rows: DataFrame, path: str) -> DataFrame:
    """Lines (name, value) as text files below a path that all executors share; path, of each file.

    Lines of a name must follow each other in one partition. Tasks open the files
    themselves, and leave their names in a table beside the path, so nobody lists the
    folder. What stood below the path before goes.
    """
    spark, names = rows.sparkSession, f"{path.rstrip('/')}.names"
    before = spark._jvm.org.apache.hadoop.fs.Path(path)
    before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)

    def run(batches):
        files_of, root = store(path.rstrip("/"))
        lines = ((n, v) for b in batches for n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        done = []
        for name, found in groupby(lines, lambda x: x[0]):
            whole = f"{root}/{name}"
            part = f"{whole}.{uuid.uuid4().hex}.part"
            files_of.create_dir(whole.rsplit("/", 1)[0], recursive=True)
            with files_of.open_output_stream(part, buffer_size=1 << 16) as stream:
                for _, value in found:
                    stream.write(value.encode() + b"\n")
            files_of.move(part, whole)
            done.append(f"{path.rstrip('/')}/{name}")
            if len(done) == 4096:
                yield pa.RecordBatch.from_pydict({"path": done})
                done = []
        if done:
            yield pa.RecordBatch.from_pydict({"path": done})

    rows.select("name", "value").mapInArrow(run, "path string").write.mode("overwrite").parquet(names)
    return spark.read.parquet(names)
