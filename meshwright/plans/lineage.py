"""Cutting lineage: a frame is written once to the folder all executors share, and read back from there."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side of narrow columns that may be broadcast (about 20 bytes a row); a larger side is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only where all executors are threads of this process may it be unset, as in tests:
    then it is a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_meshwright_dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark._meshwright_dir = "file://" + tempfile.mkdtemp(prefix="meshwright-")
    return at


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that this thread cuts to inside the block are deleted at its end: what has been made of them must be written by then. Outside of any
    block they stay, as frames that are returned still read them, until the cluster cleans its folder."""
    _open.paths, before = [], getattr(_open, "paths", None)
    try:
        yield _open.paths
    finally:
        mine, _open.paths = _open.paths, before
        for p in mine:
            delete(spark, p)


def fresh(spark: SparkSession, kind: str = "cut") -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there and no executor owns it."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A cut frame, marked for broadcast if a count shows at most `rows` rows, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
