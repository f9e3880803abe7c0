"""Sharding by balanced label propagation: documents with equal texts are linked; from a hashed start, iterative joins move the linked documents
of a shard towards the shard that most of their neighbours are in, under capacity quotas; what exceeds a shard's share then moves to shards
with room, unlinked documents first. Row counts end at most one apart. DataFrame functions only.

Defined cases: a null text has size 1 and the empty text's checksum and links; null or repeated ids and repeated rows are rows of their own;
a group larger than a shard's share stays in as many shards as it needs; an empty table gives an empty result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, size_bytes, small

SHARDS, ROUNDS = 16, 10


def _pick(values: list[int], by: Column) -> Column:
    """values[by] for a short list known to the driver."""
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), by)


def _loads(df: DataFrame, weight: Column, shards: int) -> list[int]:
    got = df.agg(*(F.sum(F.when(F.col("shard") == s, weight)) for s in range(shards))).first()
    return [int(x or 0) for x in got]


def _before(df: DataFrame, to: str, totals: list[tuple[int, int, int]]) -> DataFrame:
    """df with _before: the sum of the totals (a number of `to`, a bucket, a weight) of its row's `to` in lower buckets; 0 where there is none. The
    totals are a few for each bucket, and there are as many buckets as the root of a shard's rows."""
    rows, sums = [], dict.fromkeys((t for t, _, _ in totals), 0)
    for t, bucket, x in sorted(totals):
        rows.append((t, bucket, sums[t]))
        sums[t] += x
    lower = F.broadcast(df.sparkSession.createDataFrame(rows, "_to int, _bucket int, _before long"))
    return df.join(lower, (F.col(to) == F.col("_to")) & (F.col("bucket") == F.col("_bucket")), "left").drop("_to", "_bucket").withColumn("_before", F.coalesce("_before", F.lit(0)))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", (size_bytes("text") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g"), F.xxhash64(F.lit(5), text).alias("g2"), F.xxhash64("doc_id", text).alias("u")
    ).withColumn("start", F.pmod("u", F.lit(shards)).cast("int"))
    base = cut(base)
    n = base.count()
    share = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = max(1, math.isqrt(n // shards))
    # Bundles are the documents of a group that start in one shard; they move together. A group's bundles, at most one for each shard, are in one
    # bucket, so that a round deals them out once, by buckets.
    linked = base.groupBy("g", "g2", "start").agg(F.count("*").alias("w")).withColumn("bucket", F.pmod(F.xxhash64("g", "g2"), F.lit(buckets)).cast("int"))
    group = Window.partitionBy("bucket", "g", "g2")
    bundles = linked.repartition("bucket").withColumn("all", F.sum("w").over(group)).where("all > 1")
    bundles = cut(bundles.select("g", "g2", "start", "w", "bucket", F.col("start").alias("shard")))
    load = _loads(bundles, F.col("w"), shards)
    for _ in range(rounds):
        room = [max(0, s - x) for s, x in zip(share, load)]
        b = bundles.repartition("bucket").withColumn("in_shard", F.sum("w").over(Window.partitionBy("bucket", "g", "g2", "shard")))
        b = b.withColumn("in_shards", F.collect_set(F.struct("in_shard", (-F.col("shard")).alias("minus"))).over(group))  # at most an entry for each shard
        own = F.array_max(F.filter("in_shards", lambda x: x["minus"] == -F.col("shard")))
        # Most neighbours, where there is room; of equal shards the first. No bundle moves to fewer neighbours, so none goes back and forth.
        best = F.array_max(F.filter("in_shards", lambda x: (x > own) & (_pick(room, (-x["minus"]).cast("int")) >= F.col("w"))))
        b = b.withColumn("want", F.coalesce((-best["minus"]).cast("int"), F.col("shard"))).drop("in_shards", "in_shard")
        b = b.withColumn("moving", F.when(F.col("want") != F.col("shard"), F.col("w")).otherwise(F.lit(0)))
        queue = Window.partitionBy("bucket", "want").orderBy("g", "g2", "start")
        b = b.withColumns({"upto": F.sum("moving").over(queue.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("w").over(queue).isNull()})
        b = cut(b)
        totals = [tuple(r) for r in b.where("last and upto > 0").select("want", "bucket", "upto").collect()]
        if not totals:
            break
        fits = (F.col("moving") > 0) & (F.col("_before") + F.col("upto") <= _pick(room, F.col("want")))
        moved = _before(b, "want", totals).withColumn("shard", F.when(fits, F.col("want")).otherwise(F.col("shard")))
        bundles = moved.select("g", "g2", "start", "w", "bucket", "shard")
        before, load = load, _loads(bundles, F.col("w"), shards)
        if load == before and moved.where((F.col("moving") > 0) & (F.col("shard") == F.col("want"))).isEmpty():
            break
    to = small(bundles.select(F.col("g").alias("_g"), F.col("g2").alias("_g2"), F.col("start").alias("_s"), F.col("shard").alias("_to")))
    on = (F.col("g") == F.col("_g")) & (F.col("g2") == F.col("_g2")) & (F.col("start") == F.col("_s"))
    placed = base.join(to, on, "left").select("doc_id", "size", "text_crc32", "u", F.coalesce("_to", "start").alias("shard"), F.col("_to").isNull().alias("free"))
    # Linked documents take the first slots, so that those beyond a shard's share are free ones while it has some.
    placed = cut(placed.withColumns({"bucket": (F.pmod("u", F.lit(buckets)) + F.when(F.col("free"), buckets).otherwise(0)).cast("int"), "one": F.lit(1).cast("long")}))
    totals = [tuple(r) for r in placed.groupBy("shard", "bucket").agg(F.sum("one")).collect()]
    load = [sum(x for t, _, x in totals if t == s) for s in range(shards)]
    spare, lack = [max(0, x - s) for s, x in zip(share, load)], [max(0, s - x) for s, x in zip(share, load)]
    w = Window.partitionBy("shard", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _before(placed.withColumn("_in", F.coalesce(F.sum("one").over(w), F.lit(0))), "shard", totals).withColumn("rank", F.col("_before") + F.col("_in"))
    starts = lambda v: [sum(v[:i]) for i in range(shards)]
    over = F.col("rank") - _pick(share, F.col("shard")) + _pick(starts(spare), F.col("shard"))  # this document's place among all that must move
    to_shard, to_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, (a, k) in enumerate(zip(starts(lack), lack)):
        if k:
            here = (F.col("over") >= a) & (F.col("over") < a + k)
            to_shard, to_slot = F.when(here, s).otherwise(to_shard), F.when(here, F.col("over") - a + load[s]).otherwise(to_slot)
    moves = F.col("rank") >= _pick(share, F.col("shard"))
    return ranked.withColumn("over", F.when(moves, over)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(moves, to_shard).otherwise(F.col("shard")).alias("shard"), F.when(moves, to_slot).otherwise(F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
