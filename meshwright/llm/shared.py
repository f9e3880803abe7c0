"""What the operators share: cut lineage in the shared folder, checked broadcasts, distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import BROADCAST_ROWS, cut, shared_dir, small  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts: a batch is held twice on its way to Python.
TEXT_ROWS = 1000


def bounded(texts: DataFrame) -> DataFrame:
    """texts, after the session's Arrow batches were limited to TEXT_ROWS rows."""
    conf, key = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return texts


def size_bytes(text: str | Column) -> Column:
    """UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def chunks(rows: int, of: int) -> int:
    return max(1, -(-rows // of))


def running_total(totals: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of a bounded table of totals (a row for each key and bucket, never one for each input row)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
