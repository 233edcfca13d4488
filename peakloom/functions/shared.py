"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_RUN: ContextVar[str] = ContextVar("peakloom-run", default="peakloom")


def shared_dir(spark: SparkSession) -> str:
    """URI of the session's own folder below the one named by ``spark.checkpoint.dir``, which Spark completes with the default file system.

    Where it is unset, a local session gets a temporary folder of its own (tests); on a
    cluster that is an error, because executors do not see each other's local folders.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="peakloom-")
        sc.setCheckpointDir(named)
    uri = sc.getCheckpointDir()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def run_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one (not created yet)."""
    return f"{shared_dir(spark).rstrip('/')}/{_RUN.get()}/{what}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables and files written inside go to one folder, which is removed at the end: read or write results before."""
    name = f"peakloom-run-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    token = _RUN.set(name)
    try:
        yield path
    finally:
        _RUN.reset(token)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with no lineage before it."""
    spark, path = df.sparkSession, run_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
