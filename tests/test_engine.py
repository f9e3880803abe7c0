"""The engine against plain union-find, over seeded random edges, crashes, replays, merges and races."""

import itertools
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from meshwright.functions import model
from meshwright.operators import components, layers, positions, topology
from meshwright.sources import catalog, logs
from meshwright.streaming.engine import Engine, LogBackedError


def _roots(edges, scopes, nodes):
    out = {}
    for s in scopes:
        up = {n: n for n in nodes}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for u, v, e in edges:
            if e in (0, s):
                a, b = find(u), find(v)
                up[max(a, b)] = min(a, b)
        out |= {(s, n): find(n) for n in nodes}
    return out


def _random(rnd, n, nodes=40, scopes=4, glob=0.25):
    return [(rnd.randrange(nodes), rnd.randrange(nodes), 0 if rnd.random() < glob else rnd.randint(1, scopes)) for _ in range(n)]


def _frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, scope_id long")


def _asked(spark, scopes, nodes):
    return spark.createDataFrame([(s, n) for s in scopes for n in nodes], "scope_id long, node long")


def _answers(df):
    return {(r["scope_id"], r["node"]): r["root"] for r in df.collect()}


@pytest.mark.parametrize("finish", [10**6, 0])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH_EDGES", finish)
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    want = _roots([(u, v, 0) for u, v in edges], [0], {x for e in edges for x in e})
    assert got == {n: r for (_, n), r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_shot_and_incremental(spark):
    rnd = random.Random(20_261)
    batches = [_random(rnd, 12, glob=0.1), _random(rnd, 15, glob=0.6), [(1, 2, 3), (2, 2, 1)]]
    scopes, nodes = range(7), range(-1, 42)
    asked = _asked(spark, scopes, nodes)
    state, seen = topology.build(_frame(spark, batches[0])), list(batches[0])
    for b in batches[1:]:
        state = state.plus(topology.advance(state, _frame(spark, b)))
        seen += b
        want = _roots(seen, scopes, nodes)
        assert _answers(topology.scope_root(state, asked)) == want
    whole = topology.build(_frame(spark, seen))
    assert _answers(topology.scope_root(whole, asked)) == want
    some = _asked(spark, [0, 2, 3, 6], [0, 1, 5, 41])
    size = {k: sorted(n for (s, n), r in want.items() if s == k[0] and r == want[k]) for k in want}
    for cap in (1, 3, 10_000):
        for r in topology.members(state, some, cap).collect():
            full = size[r["scope_id"], r["node"]]
            assert r["members"] == full[:cap] and r["truncated"] == (len(full) > cap) and r["count"] == min(cap, len(full))
    with pytest.raises(ValueError):
        topology.members(state, some, 0)
    pairs = spark.createDataFrame([(s, u, v) for s in (0, 3) for u in (0, 1) for v in (2, 41)], "scope_id long, u long, v long")
    assert all(r["connected"] == (want[r["scope_id"], r["u"]] == want[r["scope_id"], r["v"]]) for r in topology.connected(state, pairs).collect())


def test_scope_edge_then_global_merge(spark):
    state = topology.build(_frame(spark, [(5, 9, 1)]))
    delta = topology.advance(state, _frame(spark, [(3, 9, 0)]))
    assert [tuple(r) for r in delta.fixups.collect()] == [(1, 9, 3)] and [tuple(r) for r in delta.overlay.collect()] == [(1, 5, 3)]
    state = state.plus(delta)
    assert _answers(topology.scope_root(state, _asked(spark, [0, 1], [3, 5, 9]))) == {(0, 3): 3, (0, 5): 5, (0, 9): 3, (1, 3): 3, (1, 5): 3, (1, 9): 3}


def test_visibility_and_events(spark):
    rows = [('{"src":1,"dst":2,"visibility":"global","event_time_ms":5}', [0]), ('{"src":1,"dst":2,"visibility":{"scoped":[7,7,3]},"event_time_ms":5,"props":"{\\"w\\":1}"}', [3, 7]), ('{"src":1,"dst":2,"visibility":{"scoped":[]},"event_time_ms":5}', [0]),
            ('{"src":1,"dst":2,"visibility":{"scoped":[0,5]},"event_time_ms":5}', [0]), ('{"src":9223372036854775808,"dst":2,"visibility":"global","event_time_ms":5}', None), ("", None), ("{", None), ('{"src":1,"dst":2,"visibility":"some","event_time_ms":5}', None)]
    got = spark.createDataFrame(rows, "line string, want array<long>").select(model.parse_event("line")["scopes"].alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert [r[0] for r in spark.createDataFrame([("GLOBAL",), ("7",), ("-1",), ("4294967296",), ("x",)], "s string").select(model.parse_scope("s")).collect()] == [0, 7, None, None, None]


def test_positions(spark):
    a, b = positions.frame(spark, {0: 5, 1: 2}), positions.frame(spark, {1: 3, 2: 1})
    assert {tuple(r) for r in positions.merge(a, b).collect()} == {(0, 5), (1, 3), (2, 1)}
    assert {tuple(r) for r in positions.behind(a, b).collect()} == {(1, 3, 2), (2, 1, 0)}
    assert positions.dominates({0: 5, 1: 3}, {1: 3}) and not positions.dominates({0: 5}, {1: 1}) and positions.joined({0: 1}, {0: 2, 3: 4}) == {0: 2, 3: 4}


def test_tier_policy():
    """Against a plain search over all stacks of up to seven runs of three levels."""

    def plain(levels, fanout, ceiling):
        for least in [fanout] + [2] * (len(levels) >= ceiling):
            for level in sorted(set(levels)):
                for a in range(len(levels)):
                    n = 0
                    while a + n < len(levels) and levels[a + n] == level:
                        n += 1
                    if n >= least:
                        return a, a + min(n, fanout)
        return None

    for n in range(8):
        for levels in itertools.product(range(3), repeat=n):
            for fanout, ceiling in ((2, 100), (3, 4), (4, 6), (4, 100), (10, 3)):
                assert layers.pick_merge(list(levels), fanout, ceiling) == plain(levels, fanout, ceiling)
    assert layers.pick_merge([0, 0], 1, 100) == (0, 2) and layers.merged_level([]) == 0 and layers.merged_level([0, 2, 1]) == 3
    assert layers.locate("abcde", "cd") == 2 and layers.locate("abde", "cd") is None and layers.spliced("abcde", 2, 2, "X") == list("abXe")


def test_catalog(tmp_path):
    catalog.preflight(tmp_path)

    class Broken(catalog.Committer):
        def put(self, path, text):
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
            return True

    with pytest.raises(catalog.CatalogError):
        catalog.preflight(tmp_path, Broken())
    c, run = catalog.Catalog(tmp_path), lambda a, b: catalog.RunMeta(f"runs/{a}", 0, a, b)
    assert c.latest() is None and c.commit(catalog.Snapshot(1, position={0: 5}, runs=[run(1, 1)]))
    assert not c.commit(catalog.Snapshot(1, position={0: 9}, runs=[run(1, 1)]))
    for bad in (catalog.Snapshot(2, position={0: 4}, runs=[run(1, 2)]), catalog.Snapshot(2, position={0: 6}, runs=[run(1, 1)]), catalog.Snapshot(3, position={0: 6}, runs=[run(1, 3)]), catalog.Snapshot(2, position={0: 6}, runs=[run(1, 0), run(2, 2)])):
        with pytest.raises(catalog.CatalogError):
            c.commit(bad)
    assert catalog.Snapshot.from_json('{"sequence": 7, "watermark": 100, "base_sequence": 4, "new_field": 1}').stream_position() == {0: 100}


def test_log_replay_crash_and_stream(spark, tmp_path):
    records = logs.simulate(spark, 240, 60, 4, partitions=3, seed=7)
    logs.write_log(records, str(tmp_path / "raw"))
    folder = tmp_path / "log"
    folder.mkdir()
    for p in range(3):
        text = "".join(f.read_text() for f in sorted((tmp_path / "raw" / f"partition={p}").glob("part-*")))
        (folder / f"partition-{p}.ndjson").write_text(text)
    got = logs.read_log(spark, str(folder))
    cols = ["partition", "offset", "src", "dst", "scopes", "event_time", "props"]
    assert got.count() == 240 and got.select(cols).exceptAll(records.select(cols)).isEmpty()
    with open(folder / "partition-1.ndjson", "a") as f:
        f.write('{"src":1')  # a line that isn't whole yet
    assert logs.read_log(spark, str(folder)).count() == 240
    with pytest.raises(logs.LogError):
        logs.seek(got, {0: 999})
    assert logs.seek(got, {0: 70, 1: 80}).count() == 10 + 0 + 80

    stream = {"source": "log", "name": "edges"}
    e = Engine(spark, str(tmp_path / "w"), stream)
    e.apply(records.where("offset <= 30"))
    e = Engine(spark, str(tmp_path / "w"), stream)  # a new worker, which gets some records again
    snap = e.apply(records.where("offset <= 60 OR partition = 2"))
    assert snap.position == {0: 60, 1: 60, 2: 80} and e.apply(records.where("offset < 20")) is None
    pinned = e.state()
    schema = model.RECORD
    records.where("offset > 50").select([f.name for f in schema.fields]).coalesce(1).write.parquet(str(tmp_path / "drop"))
    q = e.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "drop")), str(tmp_path / "cp"))
    q.awaitTermination()
    assert e.position() == {0: 80, 1: 80, 2: 80} and e.edges().select("partition", "offset").distinct().count() == 240
    edges = [(r["src"], r["dst"], s) for r in records.collect() for s in r["scopes"]]
    asked, want = _asked(spark, range(6), range(0, 60, 3)), _roots(edges, range(6), range(60))
    want = {k: v for k, v in want.items() if k[1] % 3 == 0}
    assert _answers(e.components(asked)) == want
    old = _answers(topology.scope_root(pinned, asked))
    e.fanout = 2
    before = len(e.catalog.latest().runs)
    assert e.compact() and len(e.catalog.latest().runs) < before and e.position() == {0: 80, 1: 80, 2: 80}
    assert _answers(e.components(asked)) == want and _answers(topology.scope_root(pinned, asked)) == old
    assert not e.retain().deleted and not e.retain(keep=1, window_ms=0).snapshots_kept == 0  # nothing is old enough
    stray = tmp_path / "w" / "data" / "part-of-a-failed-commit"
    stray.mkdir()
    (stray / "x.parquet").write_text("x")
    assert e.retain(keep=1, window_ms=0).too_young and stray.exists()  # a writer may be about to commit it
    gone = e.retain(keep=1, window_ms=0, grace_ms=0)
    assert "data/part-of-a-failed-commit" in gone.deleted and not e.retain(keep=1, window_ms=0, grace_ms=0).deleted
    e = Engine(spark, str(tmp_path / "w"), stream)
    assert _answers(e.components(asked)) == want and e.position() == {0: 80, 1: 80, 2: 80}
    assert e.edges().select("partition", "offset").distinct().count() == 240 and e.edges().count() == len(edges)
    s = e.stats().first()
    assert s["events_applied"] == 240 and s["active_scopes"] == 4 and s["folds"] == 3 and s["last_offset"] == 80
    assert s["global_links"] == sum(x == 0 for *_, x in edges) and s["scope_links"] == sum(x > 0 for *_, x in edges)
    assert s["base_mapped_bytes"] > 0 and s["base_index_bytes"] > 0 and s["base_shared_pairs"] == e.state().shared.count()
    with pytest.raises(LogBackedError):
        e.inject(records)
    with pytest.raises(catalog.CatalogError):
        Engine(spark, str(tmp_path / "w"), {"source": "log", "name": "other"})


def test_inject(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    rows = spark.createDataFrame([(1, 2, [], None), (2, 3, [4], "{}")], "src long, dst long, scopes array<long>, props string")
    e.inject(rows)
    assert _answers(e.components(e.ask([("global", 3), ("4", 3), ("9", 2)]))) == {(0, 3): 3, (4, 3): 1, (9, 2): 1}
    with pytest.raises(ValueError):
        e.ask([("seven", 1)])
    with pytest.raises(ValueError):
        e.apply(spark.createDataFrame([(0, 0, 1, 2, [], None)], "partition long, offset long, src long, dst long, scopes array<long>, props string").withColumn("event_time", F.current_timestamp()))


def test_filters_reach_the_scan(spark, tmp_path):
    model.f1_edges(spark, "/root/testdata/sf0.001").sortWithinPartitions("scope_id", "src").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where("scope_id = 3 AND src < 20").select("src")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(scope_id,3)" in plan and "LessThan(src,20)" in plan
