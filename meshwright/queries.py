"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.model import explode_by_scope, f1_edges, f2_records, normalize, parse_scope
from .operators import layers, positions, topology
from .plans.lineage import cut, fresh
from .sources import logs
from .streaming.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SCOPES = 8  # 0, the shared graph, and seven tenants

F1 = "SELECT l_orderkey AS src, 10000000 + l_partkey AS dst, CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(year(l_shipdate) AS BIGINT) - 1994 END AS scope_id FROM lineitem"
F2 = """SELECT event_id % 4 AS partition, event_id // 4 + 1 AS "offset", user_id AS src, 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst,
  CASE WHEN event_type = 'error' THEN 0 ELSE length(event_type) % 4 + 1 END AS scope_id, ts AS event_time, props FROM events"""


def _cc(scopes: int = SCOPES) -> str:
    """Common table expressions of F1's components: e, n (nodes) and a (scope_id, node, root)."""
    return f"""WITH RECURSIVE e AS ({F1}),
 und AS (SELECT src u, dst v, scope_id FROM e UNION SELECT dst, src, scope_id FROM e),
 n AS (SELECT DISTINCT u FROM und), sc AS (SELECT unnest(range(0, {scopes})) s),
 cc(s, node, root) USING KEY (s, node) AS (
   SELECT s, u, u FROM n, sc
   UNION
   SELECT r.s, und.v, min(c.root) FROM cc c
   JOIN und ON und.u = c.node AND (und.scope_id = 0 OR und.scope_id = c.s)
   JOIN recurring.cc r ON r.s = c.s AND r.node = und.v
   WHERE c.root < r.root GROUP BY r.s, und.v),
 a AS (SELECT s AS scope_id, node, root FROM cc)"""


def _query(sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _all_nodes(edges: DataFrame, scopes: int = SCOPES) -> DataFrame:
    return topology.nodes(edges).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(scopes - 1).cast("long"))).alias("scope_id"), "node")


def _roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, topology.State, DataFrame]:
    e = f1_edges(spark, sf_dir)
    state = topology.build(e)
    return e, state, topology.scope_root(state, _all_nodes(e)).select("scope_id", "node", "root")


@_query(_cc() + " SELECT scope_id, node, root FROM a")
def scope_root_all(spark, sf_dir):
    return _roots(spark, sf_dir)[2]


@_query(_cc() + " SELECT scope_id, node, root FROM a WHERE scope_id = 2")
def scope_root_single(spark, sf_dir):
    """Every node's root in one scope."""
    e = f1_edges(spark, sf_dir)
    own = topology.nodes(e).select(F.lit(2).cast("long").alias("scope_id"), "node")
    return topology.scope_root(topology.build(e), own).select("scope_id", "node", "root")


@_query(_cc(1) + " SELECT node, root FROM a")
def global_components(spark, sf_dir):
    e = f1_edges(spark, sf_dir)
    shared = topology.build(e.where("scope_id = 0")).shared
    return topology.shared_roots(topology.nodes(e), "node", shared, "root").select("node", "root")


@_query(_cc() + " SELECT x.scope_id, x.node AS u, y.node AS v, x.root = y.root AS connected FROM a x JOIN a y ON x.scope_id = y.scope_id AND y.node = x.node + 7")
def connected_pairs(spark, sf_dir):
    e = f1_edges(spark, sf_dir)
    n = topology.nodes(e)
    asked = _all_nodes(e).withColumnRenamed("node", "u").withColumn("v", F.col("u") + 7).join(n.withColumnRenamed("node", "v"), "v", "left_semi")
    return topology.connected(topology.build(e), asked).select("scope_id", "u", "v", "connected")


def _components(spark, sf_dir) -> tuple[topology.State, DataFrame]:
    """The state, and a question for the lowest node of every component of every scope."""
    _, state, roots = _roots(spark, sf_dir)
    return state, roots.select("scope_id", F.col("root").alias("node")).distinct()


@_query(_cc() + """ SELECT scope_id, root, array_to_string(list_sort(list(node))[1:10000], ',') AS members, CAST(least(count(*), 10000) AS BIGINT) AS n, count(*) > 10000 AS truncated
 FROM a GROUP BY scope_id, root""")
def members_complete(spark, sf_dir):
    """The members of every component of every scope, up to the most that may be asked for."""
    m = topology.members(*_components(spark, sf_dir), topology.MOST_MEMBERS)
    return m.select("scope_id", "root", _joined(F.col("members")).alias("members"), F.col("count").cast("long").alias("n"), "truncated")


@_query(_cc() + """, m AS (SELECT scope_id, root, array_to_string(list_sort(list(node))[1:3], ',') AS members, count(*) > 3 AS truncated FROM a GROUP BY scope_id, root)
 SELECT a.scope_id, a.node, a.root, m.members, m.truncated FROM a JOIN m USING (scope_id, root)""")
def members_capped(spark, sf_dir):
    """The lowest three members of the component of every node in every scope."""
    e, state, _ = _roots(spark, sf_dir)
    m = topology.members(state, _all_nodes(e), 3)
    return m.select("scope_id", "node", "root", _joined(F.col("members")).alias("members"), "truncated")


@_query(_cc() + " SELECT scope_id, root, node AS member FROM a")
def members_all(spark, sf_dir):
    """Every member of every component of every scope. A row for each member, so that a component's size is no bound."""
    return topology.member_rows(*_components(spark, sf_dir)).select("scope_id", "root", "member")


@_query(_cc() + " SELECT scope_id, root, count(*) AS n FROM a GROUP BY ALL")
def component_sizes(spark, sf_dir):
    return _roots(spark, sf_dir)[2].groupBy("scope_id", "root").agg(F.count("*").alias("n"))


@_query(_cc() + " SELECT scope_id, count(DISTINCT root) AS components, max(n) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY scope_id, root) AS n FROM a) GROUP BY ALL")
def components_per_scope(spark, sf_dir):
    sizes = _roots(spark, sf_dir)[2].groupBy("scope_id", "root").agg(F.count("*").alias("n"))
    return sizes.groupBy("scope_id").agg(F.count("*").alias("components"), F.max("n").alias("largest"))


@_query(_cc(1) + " SELECT node, root FROM a WHERE node <> root")
def shared_pairs(spark, sf_dir):
    return topology.build(f1_edges(spark, sf_dir).where("scope_id = 0")).shared


@_query(_cc() + """, g AS (SELECT * FROM a WHERE scope_id = 0),
 k AS (SELECT DISTINCT e.scope_id, g.root AS node FROM e JOIN g ON g.node IN (e.src, e.dst) WHERE e.scope_id <> 0)
 SELECT k.scope_id, k.node, a.root FROM k JOIN a ON a.scope_id = k.scope_id AND a.node = k.node WHERE a.root <> k.node""")
def overlay_pairs(spark, sf_dir):
    return topology.build(f1_edges(spark, sf_dir)).overlay


@_query(_cc(1) + " SELECT DISTINCT a.root, e.scope_id FROM e JOIN a ON a.node IN (e.src, e.dst) WHERE e.scope_id <> 0")
def registry(spark, sf_dir):
    return topology.build(f1_edges(spark, sf_dir)).registry


@_query(_cc(1) + " SELECT a.root, count(DISTINCT e.scope_id) AS scopes FROM e JOIN a ON a.node IN (e.src, e.dst) WHERE e.scope_id <> 0 GROUP BY ALL")
def scopes_for_root(spark, sf_dir):
    return topology.scopes_for_root(topology.build(f1_edges(spark, sf_dir))).groupBy("root").agg(F.count("scope_id").alias("scopes"))


@_query(_cc().replace("und.u = c.node AND (und.scope_id = 0 OR und.scope_id = c.s)", "und.u = c.node").replace("unnest(range(0, 8))", "0") + " SELECT node, root FROM a")
def union_components(spark, sf_dir):
    """Components over the edges of all scopes together."""
    e = f1_edges(spark, sf_dir)
    return topology.shared_roots(topology.nodes(e), "node", topology.union_view(e), "root").select("node", "root")


def _two_batches(spark, sf_dir) -> tuple[DataFrame, topology.State, topology.Delta]:
    """All edges, the state after those of two thirds of the sources, and what the others change."""
    e = f1_edges(spark, sf_dir)
    first = topology.build(e.where("src % 3 <> 0"))
    return e, first, topology.advance(first, e.where("src % 3 = 0"))


@_query(_cc() + " SELECT scope_id, node, root FROM a")
def incremental_roots(spark, sf_dir):
    e, first, delta = _two_batches(spark, sf_dir)
    return topology.scope_root(first.plus(delta), _all_nodes(e)).select("scope_id", "node", "root")


@_query(_cc() + " SELECT scope_id, node, root FROM a")
def layered_resolve(spark, sf_dir):
    """Roots by the pairs of two layers, resolved to one."""
    e, first, delta = _two_batches(spark, sf_dir)
    both = first.plus(delta)
    return topology.scope_root(topology.State(both.shared, both.overlay, both.registry), _all_nodes(e)).select("scope_id", "node", "root")


@_query(_cc() + " SELECT scope_id, node, root FROM a")
def compaction_equivalence(spark, sf_dir):
    """Roots by one run that stands for two."""
    e, first, delta = _two_batches(spark, sf_dir)
    one = layers.merged([layers.Run(first.shared, first.overlay, first.registry), layers.Run.of(delta)])
    return topology.scope_root(topology.State(cut(one.shared), cut(one.overlay), one.registry), _all_nodes(e)).select("scope_id", "node", "root")


@_query(_cc(1) + " SELECT DISTINCT a.root, e.scope_id FROM e JOIN a ON a.node IN (e.src, e.dst) WHERE e.scope_id <> 0")
def merged_registry(spark, sf_dir):
    """The registry of one run that stands for two: roots that the second absorbed are corrected."""
    _, first, delta = _two_batches(spark, sf_dir)
    return layers.merged([layers.Run(first.shared, first.overlay, first.registry), layers.Run.of(delta)]).registry.select("root", "scope_id")


_HALF = f"""WITH RECURSIVE e AS ({F1}), h AS (SELECT src u, dst v FROM e WHERE scope_id = 0 AND src % 3 <> 0),
 und AS (SELECT u, v FROM h UNION SELECT v, u FROM h), n AS (SELECT DISTINCT u FROM und),
 old(node, root) USING KEY (node) AS (SELECT u, u FROM n UNION SELECT und.v, min(c.root) FROM old c JOIN und ON und.u = c.node JOIN recurring.old r ON r.node = und.v WHERE c.root < r.root GROUP BY und.v),
 all_und AS (SELECT src u, dst v FROM e WHERE scope_id = 0 UNION SELECT dst, src FROM e WHERE scope_id = 0), all_n AS (SELECT DISTINCT u FROM all_und),
 new(node, root) USING KEY (node) AS (SELECT u, u FROM all_n UNION SELECT x.v, min(c.root) FROM new c JOIN all_und x ON x.u = c.node JOIN recurring.new r ON r.node = x.v WHERE c.root < r.root GROUP BY x.v)"""


@_query(_HALF + """, gone AS (SELECT o.root AS child, w.root AS parent FROM (SELECT DISTINCT root FROM old) o JOIN new w ON w.node = o.root WHERE w.root <> o.root),
 reg AS (SELECT DISTINCT coalesce(o.root, x.n) AS root, x.scope_id FROM (SELECT src AS n, scope_id FROM e WHERE scope_id <> 0 AND src % 3 <> 0 UNION SELECT dst, scope_id FROM e WHERE scope_id <> 0 AND src % 3 <> 0) x LEFT JOIN old o ON o.node = x.n),
 lone AS (SELECT x.root AS child, w.root AS parent FROM (SELECT DISTINCT root FROM reg) x JOIN new w ON w.node = x.root WHERE w.root <> x.root)
 SELECT DISTINCT reg.scope_id, g.child, g.parent FROM (SELECT * FROM gone UNION SELECT * FROM lone) g JOIN reg ON reg.root = g.child""")
def merge_fixups_delta(spark, sf_dir):
    """Absorbed shared roots that a scope has overlay state on: the scopes a global merge must reach."""
    _, first, delta = _two_batches(spark, sf_dir)
    gone = delta.shared.select(F.col("node").alias("root"), F.col("root").alias("parent"))
    return first.registry.join(gone, "root").select("scope_id", F.col("root").alias("child"), "parent")


@_query(_cc() + " SELECT e.scope_id, a.root AS graph_id, count(*) AS edges, min(e.src) AS lowest_src FROM e JOIN a ON a.scope_id = e.scope_id AND a.node = e.src GROUP BY ALL")
def edges_by_component(spark, sf_dir):
    e = f1_edges(spark, sf_dir)
    q = topology.scope_root(topology.build(e), e, "src", "graph_id")
    return q.groupBy("scope_id", "graph_id").agg(F.count("*").alias("edges"), F.min("src").alias("lowest_src"))


@_query(_cc() + " SELECT e.src, e.dst, e.scope_id, a.root AS graph_id_current FROM e JOIN a ON a.scope_id = e.scope_id AND a.node = e.src")
def graph_id_current(spark, sf_dir):
    e = f1_edges(spark, sf_dir)
    return topology.scope_root(topology.build(e), e, "src", "graph_id_current").select("src", "dst", "scope_id", "graph_id_current")


@_query(_HALF + " SELECT e.src, e.dst, coalesce(o.root, e.src) AS graph_id_at_ingest, w.root AS graph_id_current FROM e LEFT JOIN old o ON o.node = e.src JOIN new w ON w.node = e.src WHERE e.scope_id = 0 AND e.src % 3 <> 0")
def graph_id_at_ingest(spark, sf_dir):
    """The component a global edge of the first batch had when it came, and has now."""
    e, first, delta = _two_batches(spark, sf_dir)
    q = topology.shared_roots(e.where("scope_id = 0 AND src % 3 <> 0"), "src", first.shared_layers, "graph_id_at_ingest")
    return topology.shared_roots(q, "src", first.plus(delta).shared_layers, "graph_id_current").select("src", "dst", "graph_id_at_ingest", "graph_id_current")


_LISTS = "CASE event_id % 5 WHEN 0 THEN [] WHEN 1 THEN [0, 5] WHEN 2 THEN [7, 7, 3] WHEN 3 THEN [event_id % 4 + 1] ELSE [event_id % 4 + 2, event_id % 3 + 1] END"


@_query(f"""SELECT event_id, CASE WHEN len(s) = 0 OR list_contains(s, 0) THEN '0' ELSE array_to_string(list_sort(list_distinct(s)), ',') END AS scopes
 FROM (SELECT event_id, CAST({_LISTS} AS BIGINT[]) AS s FROM events)""")
def visibility_normalize(spark, sf_dir):
    i = F.col("event_id")
    lit = lambda *v: F.array(*(F.lit(x).cast("long") for x in v)).cast("array<bigint>")
    s = F.when(i % 5 == 0, lit()).when(i % 5 == 1, lit(0, 5)).when(i % 5 == 2, lit(7, 7, 3)).when(i % 5 == 3, F.array(i % 4 + 1)).otherwise(F.array(i % 4 + 2, i % 3 + 1))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _joined(normalize(s)).alias("scopes"))


@_query("""SELECT event_id, CASE WHEN lower(s) = 'global' THEN 0 WHEN regexp_full_match(s, '[0-9]+') THEN CAST(s AS BIGINT) END AS scope_id
 FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Global' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN '-1' ELSE 'x7' END AS s FROM events)""")
def scope_parse(spark, sf_dir):
    i = F.col("event_id")
    s = F.when(i % 4 == 0, "Global").when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, "-1").otherwise("x7")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", parse_scope(s).alias("scope_id"))


@_query(f"""SELECT partition, "offset", src, dst, s AS scope_id, event_time, props FROM ({F2}) f, (SELECT unnest([0, 6]) AS x) u,
 LATERAL (SELECT CASE WHEN x = 0 THEN f.scope_id ELSE 6 END AS s) WHERE x = 0 OR f.scope_id <> 0""")
def edge_explode(spark, sf_dir):
    """A row for each scope of each event, with scope 6 added to the scoped ones."""
    r = f2_records(spark, sf_dir)
    return explode_by_scope(r.withColumn("scopes", F.when(F.size("scopes") == 0, F.col("scopes")).otherwise(F.array_append("scopes", F.lit(6).cast("long")))))


@_query(f"SELECT src, dst, count(*) AS n FROM ({F1}) WHERE scope_id = 3 GROUP BY ALL")
def edge_table_scan(spark, sf_dir):
    """A read of the edge table by scope, the order its files are sorted in."""
    t = cut(f1_edges(spark, sf_dir).repartition("scope_id").sortWithinPartitions("scope_id", "src"))
    return t.where("scope_id = 3").groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query(f'SELECT partition, max("offset") AS "offset" FROM ({F2}) GROUP BY ALL')
def position_per_partition(spark, sf_dir):
    return positions.advance(f2_records(spark, sf_dir))


@_query(f'SELECT ("offset" - 1) // 100 AS file, partition, min("offset") AS first_offset, max("offset") AS last_offset, count(*) AS rows FROM ({F2}) GROUP BY ALL')
def data_file_extent(spark, sf_dir):
    return positions.extents(f2_records(spark, sf_dir).withColumn("file", F.floor((F.col("offset") - 1) / 100)), ["file"])


@_query(f'SELECT partition, "offset", src, dst FROM ({F2}) WHERE "offset" > CASE partition WHEN 0 THEN 100 WHEN 2 THEN 37 ELSE 0 END')
def dedup_below_position(spark, sf_dir):
    return positions.above(f2_records(spark, sf_dir), positions.frame(spark, {0: 100, 2: 37})).select("partition", "offset", "src", "dst")


_A, _B = 'partition < 3 AND "offset" <= 1000 * (partition + 1)', 'partition > 0 AND "offset" <= 1500 * partition'
_MARKS = f'WITH f AS ({F2}), a AS (SELECT partition, max("offset") AS o FROM f WHERE {_A} GROUP BY ALL), b AS (SELECT partition, max("offset") AS o FROM f WHERE {_B} GROUP BY ALL)'


def _marks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two positions in the log, neither of which dominates the other."""
    f = f2_records(spark, sf_dir)
    return positions.advance(f.where(_A.replace('"', "`"))), positions.advance(f.where(_B.replace('"', "`")))


@_query(_MARKS + ' SELECT partition, max(o) AS "offset" FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL')
def position_merge(spark, sf_dir):
    return positions.merge(*_marks(spark, sf_dir))


@_query(_MARKS + ' SELECT b.partition, b.o AS "offset", coalesce(a.o, 0) AS reached FROM b LEFT JOIN a USING (partition) WHERE coalesce(a.o, 0) < b.o')
def position_dominates(spark, sf_dir):
    return positions.behind(*_marks(spark, sf_dir))


_SHUFFLED = 'CASE WHEN event_id % 50 = 7 THEN event_id // 4 ELSE event_id // 4 + 1 END'


@_query(f'SELECT partition, "offset", before FROM (SELECT event_id % 4 AS partition, {_SHUFFLED} AS "offset", lag({_SHUFFLED}) OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS before FROM events) WHERE "offset" <= before')
def out_of_order_detect(spark, sf_dir):
    i = F.col("event_id")
    late = F.floor(i / 4) + F.when(i % 50 == 7, 0).otherwise(1)
    r = spark.read.parquet(f"{sf_dir}/events.parquet").select((i % 4).alias("partition"), late.alias("offset"), "event_id")
    return positions.out_of_order(r, "event_id").select("partition", "offset", "before")


@_query(f"""WITH f AS ({F2}), s AS (SELECT ("offset" - 1) // 100 AS segment, partition, max("offset") AS o FROM f GROUP BY ALL)
 SELECT segment, bool_and(o <= CASE partition WHEN 0 THEN 250 WHEN 1 THEN 300 WHEN 2 THEN 199 ELSE 260 END) AS droppable FROM s GROUP BY ALL""")
def drop_committed_segments(spark, sf_dir):
    """Segments that a committed position dominates."""
    s = f2_records(spark, sf_dir).withColumn("segment", F.floor((F.col("offset") - 1) / 100)).groupBy("segment", "partition").agg(F.max("offset").alias("offset"))
    return positions.droppable(s, positions.frame(spark, {0: 250, 1: 300, 2: 199, 3: 260}))


_RUNS = "SELECT o_orderkey AS run, o_orderkey * 3 + CASE WHEN o_orderkey % 40 = 9 THEN 1 ELSE 0 END AS min_sequence, o_orderkey * 3 + 2 AS max_sequence FROM orders"


@_query(f"SELECT run, min_sequence, before FROM (SELECT *, lag(max_sequence) OVER (ORDER BY run) AS before FROM ({_RUNS})) WHERE before + 1 <> min_sequence")
def run_adjacency_check(spark, sf_dir):
    """Runs that don't begin right after the one before."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run"))
    o = o.select("run", (F.col("run") * 3 + F.when(F.col("run") % 40 == 9, 1).otherwise(0)).alias("min_sequence"), (F.col("run") * 3 + 2).alias("max_sequence"))
    return layers.gaps(o)


@_query("SELECT o_orderkey AS object FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def retention_live_set(spark, sf_dir):
    """All objects of a listing that are old enough and that nothing names."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderdate < TIMESTAMP '1997-01-01'").select(F.col("o_orderkey").alias("object"))
    live = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 2").select(F.col("l_orderkey").alias("object"))
    return layers.unreachable(o, live)


@_query(f"""WITH RECURSIVE f AS ({F2}), und AS (SELECT src u, dst v FROM f WHERE scope_id = 0 UNION SELECT dst, src FROM f WHERE scope_id = 0), n AS (SELECT DISTINCT u FROM und),
 cc(node, root) USING KEY (node) AS (SELECT u, u FROM n UNION SELECT und.v, min(c.root) FROM cc c JOIN und ON und.u = c.node JOIN recurring.cc r ON r.node = und.v WHERE c.root < r.root GROUP BY und.v)
 SELECT (SELECT count(*) FROM f) AS events_applied, (SELECT count(*) FROM f WHERE scope_id = 0) AS global_links, (SELECT count(*) FROM f WHERE scope_id <> 0) AS scope_links,
 (SELECT count(DISTINCT scope_id) FROM f WHERE scope_id <> 0) AS active_scopes, (SELECT count(*) FROM cc WHERE node <> root) AS base_shared_pairs, (SELECT max("offset") FROM f) AS last_offset,
 CAST(2 AS BIGINT) AS folds, TRUE AS members_available""")
def stats(spark, sf_dir):
    """The counters of a warehouse that has applied the whole log in two commits, records of the first being sent again with the second."""
    e = Engine(spark, _posix(fresh(spark, "warehouse")), check=False)
    records = f2_records(spark, sf_dir)
    e.apply(records.where("partition < 2"))
    e.apply(records)
    return e.stats().select("events_applied", "global_links", "scope_links", "active_scopes", "base_shared_pairs", "last_offset", "folds", "members_available")


@_query(f"SELECT scope_id, count(*) AS n, date_trunc('milliseconds', min(event_time)) AS first_time FROM ({F2}) GROUP BY ALL")  # a log has milliseconds
def log_replay(spark, sf_dir):
    """The events, written as a log and read back as an edge table, by scope."""
    at = fresh(spark, "log")
    logs.write_log(f2_records(spark, sf_dir), at)
    return explode_by_scope(logs.read_log(spark, at)).groupBy("scope_id").agg(F.count("*").alias("n"), F.min("event_time").cast("timestamp_ntz").alias("first_time"))


def _posix(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)
