"""The data model: edge events, visibility, the edge table, and the edge logs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GLOBAL_SCOPE = 0

EVENT = T.StructType(
    [
        T.StructField("src", T.LongType(), False),
        T.StructField("dst", T.LongType(), False),
        T.StructField("scopes", T.ArrayType(T.LongType()), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("props", T.StringType()),
    ]
)
RECORD = T.StructType([T.StructField("partition", T.LongType(), False), T.StructField("offset", T.LongType(), False), *EVENT.fields])
EDGE_TABLE = T.StructType(
    [
        T.StructField("partition", T.LongType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("src", T.LongType(), False),
        T.StructField("dst", T.LongType(), False),
        T.StructField("scope_id", T.LongType(), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("props", T.StringType()),
    ]
)


def normalize(scopes: str | Column) -> Column:
    """The scopes of an edge, sorted and different: an empty list, or one with the global scope in it, is the global scope alone."""
    s = F.col(scopes) if isinstance(scopes, str) else scopes
    s = F.coalesce(s, F.array().cast("array<bigint>")).cast("array<bigint>")
    return F.when((F.size(s) == 0) | F.array_contains(s, GLOBAL_SCOPE), F.array(F.lit(GLOBAL_SCOPE).cast("long"))).otherwise(F.array_sort(F.array_distinct(s)))


def parse_scope(text: str | Column) -> Column:
    """A scope given as text: `global` in any case, or a number from 0 to 2**32 - 1; else null."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    n = F.when(t.rlike(r"^[0-9]{1,10}$"), t.cast("long"))
    return F.when(F.lower(t) == "global", F.lit(GLOBAL_SCOPE).cast("long")).when(n < 1 << 32, n)


def parse_event(line: str | Column) -> Column:
    """A struct like EVENT of one NDJSON line, null where the line isn't an event. Visibility is "global" or {"scoped": [..]}."""
    line = F.col(line) if isinstance(line, str) else line
    j = F.from_json(line, "src decimal(20,0), dst decimal(20,0), visibility string, event_time_ms bigint, props string")
    v = j["visibility"]
    scoped = F.from_json(v, "scoped array<bigint>")["scoped"]
    scopes = F.when(v == "global", F.array().cast("array<bigint>")).otherwise(scoped)
    whole = j["src"].isNotNull() & j["dst"].isNotNull() & scopes.isNotNull() & j["event_time_ms"].isNotNull()
    # Ids of 2**63 and more would not keep their order as signed numbers.
    whole = whole & (j["src"] >= 0) & (j["dst"] >= 0) & (j["src"] <= (1 << 63) - 1) & (j["dst"] <= (1 << 63) - 1)
    event = F.struct(j["src"].cast("long").alias("src"), j["dst"].cast("long").alias("dst"), normalize(scopes).alias("scopes"), F.timestamp_millis(j["event_time_ms"]).alias("event_time"), j["props"].alias("props"))
    return F.when(whole, event)


def explode_by_scope(records: DataFrame) -> DataFrame:
    """A row for each record and scope that sees it."""
    return records.withColumn("scope_id", F.explode(normalize("scopes"))).select([f.name for f in EDGE_TABLE.fields])


def f1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts as a graph: (src, dst, scope_id), first lines global, the others by ship year."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    scope = F.when(F.col("l_linenumber") == 1, 0).otherwise(F.year("l_shipdate") - 1994).cast("long")
    return li.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"), scope.alias("scope_id"))


def f2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of four partitions, like RECORD."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.when(F.col("event_type") == "error", F.array().cast("array<bigint>")).otherwise(F.array(F.length("event_type").cast("long") % 4 + 1))
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select((F.col("event_id") % 4).alias("partition"), (F.floor(F.col("event_id") / 4) + 1).alias("offset"), F.col("user_id").alias("src"), (k + 1_000_000).alias("dst"), kinds.alias("scopes"), F.col("ts").alias("event_time"), "props")
