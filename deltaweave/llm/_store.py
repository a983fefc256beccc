"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
again. Where that is unset, a folder of this machine is made only for a local
master, whose tasks all see it (tests); on a cluster ValueError is raised.

Operators drop what nothing reads any more. What a returned DataFrame still reads
goes by ``drop_all``, at the end of the program at the latest.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}

#: Shuffle files go as soon as the table that needed them is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows, most of them with texts, that go to a Python worker at a time.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="deltaweave-"))
    return found.rstrip("/")


_open: dict[str, "Scratch"] = {}


@atexit.register
def drop_all() -> None:
    """Remove every table that operators have left for the DataFrames they returned."""
    for scratch in list(_open.values()):
        with contextlib.suppress(Exception):  # the session may have ended
            scratch.drop()


class Scratch:
    """Tables of one run of an operator, each under a name of its own."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        _open[self.root] = self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read again."""
        schema = df.schema
        with settings(self.spark, {CLEANUP: "true"} | BATCH_ROWS):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them, once nothing reads it any more."""
        if not name:
            _open.pop(self.root, None)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
