"""Stream positions: the highest applied offset of each partition, where an absent partition is 0. Frames are (partition, offset)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def frame(spark: SparkSession, position: dict[int, int]) -> DataFrame:
    return spark.createDataFrame([(int(p), int(o)) for p, o in position.items()], "partition long, offset long")


def advance(records: DataFrame) -> DataFrame:
    return records.groupBy("partition").agg(F.max("offset").alias("offset"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The later of two positions, partition by partition."""
    other = b.select(F.col("partition").alias("_p"), F.col("offset").alias("_o"))
    both = a.join(other, F.col("partition") == F.col("_p"), "full")
    return both.select(F.coalesce("partition", "_p").alias("partition"), F.greatest("offset", "_o").alias("offset"))


def behind(a: DataFrame, b: DataFrame) -> DataFrame:
    """Partitions in which a is not as far as b: a dominates b if there are none."""
    own = a.select(F.col("partition").alias("_p"), F.col("offset").alias("_o"))
    return b.join(own, F.col("partition") == F.col("_p"), "left").where(F.coalesce("_o", F.lit(0)) < F.col("offset")).select("partition", "offset", F.coalesce("_o", F.lit(0)).alias("reached"))


def dominates(a: dict[int, int], b: dict[int, int]) -> bool:
    return all(a.get(p, 0) >= o for p, o in b.items())


def joined(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    return {p: max(a.get(p, 0), b.get(p, 0)) for p in sorted({*a, *b})}


def above(records: DataFrame, position: DataFrame) -> DataFrame:
    """Records that a position hasn't applied yet. The position has a row for each partition."""
    p = position.select(F.col("partition").alias("_p"), F.col("offset").alias("_o"))
    return records.join(F.broadcast(p), F.col("partition") == F.col("_p"), "left").where(F.col("offset") > F.coalesce("_o", F.lit(0))).drop("_p", "_o")


def out_of_order(records: DataFrame, arrival: str) -> DataFrame:
    """Records whose offset isn't above the one that came before in their partition; arrival orders a batch. Partitions may interleave."""
    w = Window.partitionBy("partition").orderBy(arrival)
    return records.withColumn("before", F.lag("offset").over(w)).where(F.col("offset") <= F.col("before"))


def faults(records: DataFrame) -> DataFrame:
    """Records at the reserved offset 0 or below, or given twice in a batch."""
    n = records.groupBy("partition", "offset").agg(F.count("*").alias("times"))
    return n.where((F.col("offset") <= 0) | (F.col("times") > 1))


def extents(records: DataFrame, by: list[str]) -> DataFrame:
    """First and last position, and rows, of each file (or other unit)."""
    return records.groupBy(*by, "partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("rows"))


def droppable(segments: DataFrame, position: DataFrame) -> DataFrame:
    """(segment, droppable) of segments (segment, partition, offset: their last ones): those that a committed position dominates."""
    p = position.select(F.col("partition").alias("_p"), F.col("offset").alias("_o"))
    done = segments.join(F.broadcast(p), F.col("partition") == F.col("_p"), "left")
    return done.groupBy("segment").agg(F.bool_and(F.col("offset") <= F.coalesce("_o", F.lit(0))).alias("droppable"))
