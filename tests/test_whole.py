"""Queries that answer for all nodes, scopes and components."""

from pyspark.sql import functions as F

from meshwright.operators import topology
from meshwright.queries import QUERIES

AT, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_members_of_every_component(spark):
    roots = {(r["scope_id"], r["node"], r["root"]) for r in QUERIES["scope_root_all"](spark, AT).collect()}
    got = [(r["scope_id"], r["member"], r["root"]) for r in QUERIES["members_all"](spark, AT).collect()]
    assert len(got) == len(roots) and set(got) == roots
    capped = {(r["scope_id"], r["node"], r["root"]) for r in QUERIES["members_capped"](spark, AT).collect()}
    assert capped == roots


def test_members_beyond_the_cap(spark):
    n = topology.MOST_MEMBERS + 5
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).cast("long").alias("scope_id"))
    asked = spark.range(1).select(F.lit(3).cast("long").alias("scope_id"), F.lit(0).cast("long").alias("node"))
    state = topology.build(chain)
    rows = topology.member_rows(state, asked)
    assert rows.count() == rows.select("member").distinct().count() == n
    full = topology.members(state, asked, topology.MOST_MEMBERS).first()
    assert full["truncated"] and full["members"] == list(range(topology.MOST_MEMBERS))


def test_a_hub_is_looked_at_by_the_cap(spark):
    """A hub's index holds no more children than any answer, and each step of a capped answer looks at cap + 1 of them."""
    n, cap = 30_000, 5
    hub = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("scope_id"))
    state = topology.build(hub)
    index = topology.ranked_children(state.shared)
    assert index.count() == topology.MOST_MEMBERS + 1 and index.agg(F.max("node")).first()[0] == topology.MOST_MEMBERS + 1
    asked = spark.range(n).select(F.lit(1).cast("long").alias("scope_id"), F.col("id").alias("node"))  # everyone asks
    assert topology._down(state, topology.scope_root(state, asked), cap).count() == cap + 1
    got = topology.members(state, asked, cap)
    assert got.count() == n and {tuple(r["members"]) for r in got.select("members").distinct().collect()} == {tuple(range(cap))}


def test_connected_pairs_of_every_node(spark):
    root = {(r["scope_id"], r["node"]): r["root"] for r in QUERIES["scope_root_all"](spark, AT).collect()}
    got = {(r["scope_id"], r["u"], r["v"]): r["connected"] for r in QUERIES["connected_pairs"](spark, AT).collect()}
    assert got == {(s, n, n + 7): root[s, n] == root[s, n + 7] for s, n in root if (s, n + 7) in root}


def test_whole_listings(spark):
    li = spark.read.parquet(f"{LARGER}/lineitem.parquet")
    scoped = li.where("l_linenumber <> 1 AND year(l_shipdate) = 1997")
    got = QUERIES["edge_table_scan"](spark, LARGER).collect()
    assert sum(r["n"] for r in got) == scoped.count()
    named = {r[0] for r in li.where("l_linenumber = 2").select("l_orderkey").collect()}
    old = {r[0] for r in spark.read.parquet(f"{LARGER}/orders.parquet").where("o_orderdate < '1997-01-01'").select("o_orderkey").collect()}
    assert {r["object"] for r in QUERIES["retention_live_set"](spark, LARGER).collect()} == old - named
