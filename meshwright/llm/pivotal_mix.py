"""Mixing sources to target weights by pivotal dependent rounding: every document of a source starts with the same fractional number of copies;
pairs of documents exchange word mass at random, with unchanged expectations, until one of them is whole, so a source's words stay on its
target; chunks of documents leave one unrounded document each, and these are combined through a reduction tree. DataFrame functions only.

Rows with the same source, id and text are counted before anything else, so that no task holds them all: among themselves they exchange mass
until one is left unrounded, which stands for them in the tree; the counts become rows again at the end, in blocks dealt to all tasks.

Defined cases: a null or wordless text has size 0 and is taken 0 times its words; a null source is a source of its own, the last in order;
repeated rows and null ids are documents of their own (equal rows may be rounded differently); a source without words has target 0; the
random numbers are hashes of id and text, so reruns agree; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small

#: The weights that sources take in turn, the share of all words, the most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
CHUNK, SEED = 128, 20_240
#: Equal rows that one step of a task writes out.
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and rows (n) of each source, with its target: the level at which the weights, each cut off at `most` times the
    source's size, use up the share. That is where resharing the excess by weight ends."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source, not for each document
    s = sources.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumns({"cap": F.col("source_size") * float(most)}).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = [F.col("ratio"), F.col("source").isNull(), F.col("source")]
    upto, rest = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("level", F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(every))
    return s.select("source", "source_size", "n", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _meet(s: Column, x: Column) -> Column:
    """The fold's step: the carried document meets the next one; one of the two is rounded and joins `out`, the other is carried on."""
    c = s["c"]
    q, zc, f, z = c["f"], c["size"], x["f"], x["size"]
    c_up, x_down, c_down, x_up = zc * (1 - q), f * z, q * zc, z * (1 - f)
    a, b = F.least(c_up, x_down), F.least(c_down, x_up)
    r = F.pmod(F.xxhash64(c["u"], x["u"], F.lit(SEED)), F.lit(1 << 53)) / float(1 << 53)
    up = r * (a + b) < b  # mass goes to the carried document, with the probability that keeps both expectations
    c_whole = F.when(up, c_up <= x_down).otherwise(c_down <= x_up)
    left = F.when(c_whole, F.when(up, f - c_up / z).otherwise(f + c_down / z)).otherwise(F.when(up, q + x_down / zc).otherwise(q - x_up / zc))
    whole = F.when(c_whole, c).otherwise(x)
    put = lambda d, v: F.struct(*(d[k].alias(k) for k in ("size", "u", "doc_id", "rows", "more")), v.alias("f"))
    done = put(whole, F.when(c_whole == up, F.lit(1.0)).otherwise(F.lit(0.0)))
    on = put(F.when(c_whole, x).otherwise(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)))
    return F.struct(on.alias("c"), F.concat(s["out"], F.array(done)).alias("out"))


#: What stands for `rows` equal rows, `more` of which are rounded up already, in the tree.
_UNIT = "struct<size:bigint,u:bigint,doc_id:bigint,rows:bigint,more:bigint,f:double>"


def _level(units: DataFrame) -> DataFrame:
    """Folds each (source, chunk) of rows (source, chunk, unit), longest first: those are rounded while many shorter ones can still take up
    their mass, so the one that stays unrounded is short."""
    g = units.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("d"))
    start = F.struct(F.col("d")[0].alias("c"), F.array().cast(f"array<{_UNIT}>").alias("out"))
    return g.select("source", "chunk", F.aggregate(F.slice("d", 2, 1 << 30), start, _meet).alias("s"))


def _groups(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, chunk: int) -> DataFrame:
    """A row for each group of rows with the same source, id and text: source, doc_id, size, u (the hash of id and text), source_size, target, rows,
    whole (copies of every row) and more (the rows that have one copy more)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("u"))
    base = cut(base.groupBy("source", "doc_id", "size", "u").agg(F.count("*").alias("rows")))
    sources = targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n")), weights, share, most)
    sources = cut(sources.withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    of = small(sources.select(F.col("source").alias("_source"), "source_size", "target", "n", "p"))
    rows = base.join(of, F.col("source").eqNullSafe(F.col("_source"))).withColumn("whole", F.floor("p"))
    # Equal rows are as long as each other: rounding them up and down in pairs leaves one of them with the rest of their sum.
    mass = F.when(F.col("size") == 0, 0.0).otherwise((F.col("p") - F.col("whole")) * F.col("rows"))
    rows = rows.withColumn("more", F.floor(mass + 1e-9)).withColumn("f", F.greatest(F.lit(0.0), mass - F.col("more")))
    plain = F.col("f") <= 1e-9
    out = ["source", "doc_id", "size", "u", "source_size", "target", "rows", "whole", "more"]
    found = [rows.where(plain).select(out)]
    unit = F.struct("size", "u", "doc_id", "rows", "more", "f").cast(_UNIT).alias("unit")
    units = rows.where(~plain).select("source", F.pmod("u", F.ceil(F.col("n") / chunk)).alias("chunk"), unit)
    most_chunks = max([r["n"] for r in sources.agg(F.max("n").alias("n")).collect() if r["n"]], default=0)
    while most_chunks:
        most_chunks = -(-most_chunks // chunk)
        last = most_chunks == 1
        s = _level(units)
        if last:
            r = F.pmod(F.xxhash64(F.col("s.c.u"), F.lit(SEED + 1)), F.lit(1 << 53)) / float(1 << 53)
            end = F.col("s.c").withField("f", F.when(r < F.col("s.c.f"), F.lit(1.0)).otherwise(F.lit(0.0)))
            s = s.select("source", "chunk", F.struct(F.col("s.c").alias("c"), F.concat("s.out", F.array(end)).alias("out")).alias("s"))
        s = cut(s)
        done = s.select("source", F.explode("s.out").alias("unit")).select("source", "unit.*")
        done = done.join(of, F.col("source").eqNullSafe(F.col("_source"))).withColumns({"whole": F.floor("p"), "more": F.col("more") + F.col("f").cast("long")})
        found.append(done.select(out))
        units = s.select("source", F.floor(F.col("chunk") / chunk).alias("chunk"), F.col("s.c").alias("unit"))
        if last:
            break
    mixed = found[0]
    for f in found[1:]:
        mixed = mixed.unionByName(f)
    return mixed


def _times(rows: DataFrame, n: str) -> DataFrame:
    """Each row as many times as its column n says; a high number is dealt to all tasks in blocks."""
    once = lambda d: d.select("*", F.explode(F.sequence(F.lit(1), F.col(n)))).drop("col", n)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = rows.where(F.col(n) > BLOCK).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK))))
    many = many.withColumn(n, F.least(F.lit(BLOCK).cast("long"), F.col(n) - F.col("_at") * BLOCK)).repartition(parts, "_at").drop("_at")
    return once(rows.where(F.col(n).between(1, BLOCK))).unionByName(once(many))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and u (the hash of id and text) for each row of docs."""
    both = F.explode(F.array(F.struct(F.col("more").alias("n"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("rows") - F.col("more")).alias("n"), F.col("whole").alias("copies"))))
    per = _groups(docs, weights, share, most, chunk).select("doc_id", "size", "source_size", "target", "u", both.alias("b")).select("*", "b.n", F.col("b.copies").cast("int").alias("copies")).drop("b")
    return _times(per, "n").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "u")


def repeat(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The mix itself: each row of docs as many times as mix takes it. Rows with the same source, id and text share their copies as evenly as they
    can, in the order of a hash of all their columns."""
    per = cut(_groups(docs, WEIGHTS, SHARE, MOST, chunk).select(F.col("u").alias("_u"), F.col("source").alias("_source"), "rows", "whole", "more"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("u"), F.col("source").alias("of"))
    on = lambda p: (F.col("u") == F.col("_u")) & F.col("of").eqNullSafe(F.col("_source"))
    found = own.join(small(per.where("rows = 1")), on(per)).select("row", (F.col("whole") + F.col("more")).alias("n"))
    twice = per.where("rows > 1")
    if not twice.isEmpty():
        # Rows that are equal in all columns are counted, as they can't be told apart.
        same = own.join(small(cut(twice)), on(per)).withColumn("h", F.xxhash64("row")).groupBy("u", "of", "h").agg(F.first("row").alias("row"), F.count("*").alias("same"), F.first("whole").alias("whole"), F.first("more").alias("more"))
        before = F.coalesce(F.sum("same").over(Window.partitionBy("u", "of").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        extra = F.greatest(F.lit(0), F.least(F.col("same"), F.col("more") - before))
        found = found.unionByName(same.select("row", (F.col("same") * F.col("whole") + extra).alias("n")))
    return _times(found, "n").select("row.*")
