"""Logs that grow, commits that fail or race, merges beside ingestion, old snapshots: answers stay those of plain union-find."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from meshwright import __main__ as cli
from meshwright.config import Settings
from meshwright.operators import topology
from meshwright.sources import catalog, logs
from meshwright.streaming import engine as engines
from meshwright.streaming.engine import Conflict, Engine, MembersUnavailable
from test_engine import _answers, _asked, _frame, _roots

RECORD = "partition long, offset long, src long, dst long, scopes array<long>, event_time timestamp, props string"


def _line(src, dst, scopes=()):
    return json.dumps({"src": src, "dst": dst, "visibility": {"scoped": list(scopes)} if scopes else "global", "event_time_ms": 5})


def _edges(rnd, n, nodes=40):
    return [(rnd.randrange(nodes), rnd.randrange(nodes), () if rnd.random() < 0.3 else (rnd.randint(1, 3),)) for _ in range(n)]


def _records(spark, edges, first=1, partition=0):
    rows = [(partition, first + i, u, v, list(s), None) for i, (u, v, s) in enumerate(edges)]
    return spark.createDataFrame(rows, "partition long, offset long, src long, dst long, scopes array<long>, props string").withColumn("event_time", F.lit(0).cast("timestamp"))


def _want(edges, scopes=range(5), nodes=range(40)):
    return _roots([(u, v, x) for u, v, s in edges for x in (s or (0,))], scopes, nodes)


def test_lines_that_are_there(spark, tmp_path):
    at = tmp_path / "one.ndjson"
    at.write_bytes(b"".join(_line(i, i + 1).encode() + b"\r\n" for i in range(3)) + b'{"src":')
    assert [r["offset"] for r in logs.read_lines(spark, str(at)).orderBy("offset").collect()] == [1, 2, 3] and logs.read_log(spark, str(at)).count() == 3
    at.write_bytes(b"".join(_line(i, i + 1).encode() + b"\n" for i in range(3)) + b"\xff\xfe\n")
    assert logs.read_lines(spark, str(at)).count() == 4 and [r["offset"] for r in logs.malformed(spark, str(at)).collect()] == [4]
    with pytest.raises(Exception, match="partition 0, offset 4"):
        logs.read_log(spark, str(at)).collect()
    with pytest.raises(logs.LogError):
        logs.read_lines(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(logs.LogError, match="no partitions"):
        logs.read_lines(spark, str(tmp_path / "empty"))


def test_follow_partitions_that_grow(spark, tmp_path):
    """Appended lines, an open last line, a partition that comes later, and a second worker that goes on from the committed position."""
    rnd, folder, w = random.Random(3), tmp_path / "log", str(tmp_path / "w")
    folder.mkdir()
    parts = {p: _edges(rnd, 25) for p in range(3)}
    write = lambda p, rows, tail="": open(folder / f"partition-{p}.ndjson", "a").write("".join(_line(*e) + "\n" for e in rows) + tail)
    write(0, parts[0][:20])
    write(1, parts[1][:10], _line(*parts[1][10])[:9])
    stream = {"source": "log", "name": "grows"}
    assert Engine(spark, w, stream).ingest(str(folder)).position == {0: 20, 1: 10}
    write(1, [], _line(*parts[1][10])[9:] + "\n")
    write(1, parts[1][11:])
    write(2, parts[2])
    write(0, parts[0][20:])
    e = Engine(spark, w, stream)
    q = e.follow_log(str(folder), str(tmp_path / "cp"), max_records=30)  # a slice of ten lines of each partition at a time
    try:
        _wait(e, {0: 25, 1: 25, 2: 25})
        write(2, [(1, 39, ())], _line(3, 4))
        _wait(e, {0: 25, 1: 25, 2: 26})
    finally:
        q.stop()
    assert e.stats().first()["events_applied"] == 76 and e.stats().first()["folds"] > 3
    assert _answers(e.components(_asked(spark, range(5), range(40)))) == _want([x for p in parts.values() for x in p] + [(1, 39, ())])
    assert e.ingest(str(folder)) is None
    (folder / "partition-0.ndjson").write_text(_line(1, 2) + "\n")
    with pytest.raises(logs.LogError, match="before the committed"):
        e.ingest(str(folder))
    with pytest.raises(Exception, match="before the committed"):
        e.follow_log(str(folder), str(tmp_path / "third")).awaitTermination()


def _wait(e, position, seconds=120):
    end = time.time() + seconds
    while e.position() != position and time.time() < end:
        time.sleep(0.5)
    assert e.position() == position


def test_slices_end_at_lines(tmp_path):
    at = tmp_path / "x"
    rnd = random.Random(1)
    lines = [b"y" * rnd.randrange(9) + b"\n" for _ in range(200)]
    at.write_bytes(b"".join(lines) + b"open")
    for begin in (0, 7, 100):
        for most in (1, 5, 77, 1000):
            own = lines[begin : begin + most]
            assert logs._advance(str(at), sum(map(len, lines[:begin])), most, block=16) == (sum(map(len, own)), len(own))


def test_a_partition_that_goes_backwards(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    rows = [(0, 1, 1, 2, [], None, 0), (1, 1, 1, 3, [], None, 1), (0, 3, 2, 4, [], None, 2), (0, 2, 2, 5, [], None, 3)]
    came = spark.createDataFrame(rows, "partition long, offset long, src long, dst long, scopes array<long>, props string, at int").withColumn("event_time", F.current_timestamp())
    with pytest.raises(ValueError, match="offset 2 came after 3"):
        e.apply(came, arrival="at")
    assert e.position() == {} and e.apply(came.where("at < 3"), arrival="at").position == {0: 3, 1: 1}


@pytest.mark.parametrize("step", ["data", "children", "commit"])
def test_a_tick_that_fails(spark, tmp_path, monkeypatch, step):
    """Whatever step of a commit fails, nothing of it is seen, and the same records can be applied after."""
    rnd = random.Random(5)
    first, second = _edges(rnd, 20), _edges(rnd, 20)
    e = Engine(spark, str(tmp_path / "w"))
    e.apply(_records(spark, first))
    before = _answers(e.components(_asked(spark, range(5), range(40))))
    write, put = Engine._write, catalog.Committer.put

    def broken(self, name, *rest):
        if name.startswith("data/") if step == "data" else name.endswith(f"/{step}"):
            raise OSError("no room")
        return write(self, name, *rest)

    with monkeypatch.context() as m:
        m.setattr(Engine, "_write", broken)
        if step == "commit":
            m.setattr(catalog.Committer, "put", lambda *_: (_ for _ in ()).throw(OSError("no room")))
        with pytest.raises(OSError):
            e.apply(_records(spark, second, 21))
    assert catalog.Committer.put is put and e.position() == {0: 20} and _answers(e.components(_asked(spark, range(5), range(40)))) == before == _want(first)
    assert e.apply(_records(spark, first + second)).position == {0: 40}
    assert _answers(e.components(_asked(spark, range(5), range(40)))) == _want(first + second) 
    gone = e.retain(grace_ms=0).deleted  # what the failed tick had written
    assert (step == "data") == (not gone) and e.edges().count() == len([x for _, _, s in first + second for x in s or (0,)])


def test_two_writers(spark, tmp_path, monkeypatch):
    """The loser of a race gets a conflict, and what it wrote is swept later; applied again, its records are in."""
    rnd = random.Random(6)
    mine, other = _edges(rnd, 15), _edges(rnd, 15)
    a, b = Engine(spark, str(tmp_path / "w")), Engine(spark, str(tmp_path / "w"))
    advance = topology.advance

    def late(state, edges):
        monkeypatch.setattr(engines.topology, "advance", advance)
        b.apply(_records(spark, other, partition=1))
        return advance(state, edges)

    monkeypatch.setattr(engines.topology, "advance", late)
    with pytest.raises(Conflict):
        a.apply(_records(spark, mine))
    assert a.position() == {1: 15} and a.apply(_records(spark, mine)).position == {0: 15, 1: 15}
    assert _answers(a.components(_asked(spark, range(5), range(40)))) == _want(mine + other)
    assert sum(n.startswith(("data/", "runs/")) for n in a.retain(grace_ms=0).deleted) == 2 and a.edges().count() == 30


def test_merge_beside_commits(spark, tmp_path):
    """A merge that was begun is spliced in after other commits; one whose window is gone is discarded."""
    rnd = random.Random(8)
    batches = [_edges(rnd, 8) for _ in range(4)]
    e = Engine(spark, str(tmp_path / "w"), fanout=2)
    for k, rows in enumerate(batches[:2]):
        e.apply(_records(spark, rows, 1 + 8 * k))
    one, two = e.begin_merge(), e.begin_merge()
    e.apply(_records(spark, batches[2], 17))
    done = e.adopt(one)
    assert [(m.level, m.min_sequence, m.max_sequence) for m in done.runs] == [(1, 1, 2), (0, 3, 4)] and done.position == {0: 24}
    gone = two.thread and two.thread.join() or two.run.path
    assert e.adopt(two) is None and not (tmp_path / "w" / gone).exists()
    e.apply(_records(spark, batches[3], 25))
    every = _want([x for b in batches for x in b])
    asked = _asked(spark, range(5), range(40))
    assert _answers(e.components(asked)) == every
    size = {k: sorted(n for (s, n), r in every.items() if s == k[0] and r == every[k]) for k in every}
    for r in e.members(asked, 4).collect():
        assert r["members"] == size[r["scope_id"], r["node"]][:4] and r["truncated"] == (len(size[r["scope_id"], r["node"]]) > 4)
    assert e.scopes().count() == len({x for b in batches for _, _, s in b for x in s})


def test_members_are_refused_without_an_index(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"), member_index=False)
    e.apply(_records(spark, [(1, 2, ())]))
    asked = _asked(spark, [0], [1])
    for x in (e, Engine(spark, str(tmp_path / "w"))):  # one run without it is enough
        with pytest.raises(MembersUnavailable):
            x.members(asked)
        assert not x.stats().first()["members_available"]
    full = Engine(spark, str(tmp_path / "v"))
    full.apply(_records(spark, [(1, 2, ())]))
    assert full.members(asked).first()["members"] == [1, 2]
    with pytest.raises(ValueError):
        full.members(asked, 0)


def test_old_snapshots(spark, tmp_path):
    """Snapshots without a run list chain back to their base, and a run without a registry gets one from its overlay."""
    e = Engine(spark, str(tmp_path / "w"))
    rnd = random.Random(9)
    a, b = _edges(rnd, 20), _edges(rnd, 20)
    e.apply(_records(spark, a))
    e.apply(_records(spark, b, 21))
    for s in (1, 2):
        at = e.catalog.path(s)
        d = json.loads(at.read_text())
        old = {"sequence": s, "watermark": 20 * s, "base_sequence": 1, "puffin_path": d["runs"][-1]["path"], "data_files": d["data_files"]}
        at.write_text(json.dumps(old))
        import shutil

        shutil.rmtree(tmp_path / "w" / old["puffin_path"] / "registry")
    e = Engine(spark, str(tmp_path / "w"))
    asked = _asked(spark, range(5), range(40))
    assert e.position() == {0: 40} and e.catalog.latest().chain() == [1, 2] and not e.members_available
    assert _answers(e.components(asked)) == _want(a + b)
    c = [(u, v, ()) for u, v, _ in _edges(rnd, 6)]  # global merges must reach the rebuilt registry
    e.apply(_records(spark, c, 41))
    assert _answers(e.components(asked)) == _want(a + b + c) and e.catalog.latest().runs[0].max_sequence == 1
    assert not e.retain(keep=1, window_ms=0, grace_ms=0).deleted == [] and _answers(e.components(asked)) == _want(a + b + c)
    e.catalog.path(1).unlink(missing_ok=True)
    with pytest.raises(catalog.CatalogError, match="missing"):
        e.catalog.run_set(catalog.Snapshot(7, watermark=5, base_sequence=1, format_version=0))


def test_what_a_commit_writes_follows_the_batch(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    big = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("partition"), F.col("id").alias("offset"), (F.col("id") * 3).alias("src"), (F.col("id") * 3 + 1).alias("dst"), F.array((F.col("id") % 3 + 1)).alias("scopes"), F.lit(0).cast("timestamp").alias("event_time"), F.lit(None).cast("string").alias("props"))
    e.apply(big)
    e.apply(_records(spark, [(3, 7, (1,)), (9, 3, ())], 20_001))
    a, b = e.catalog.latest().runs
    assert b.pairs <= 4 < 20_000 <= a.pairs and b.bytes * 4 < a.bytes
    plan = e.components(_asked(spark, [1], [7]))
    assert _answers(plan) == {(1, 7): 3}


def test_scratch_is_deleted(spark, tmp_path):
    from pathlib import Path

    from meshwright.plans import lineage

    at = Path(lineage.shared_dir(spark).removeprefix("file://"))
    before = set(at.iterdir())
    Engine(spark, str(tmp_path / "w")).apply(_records(spark, [(1, 2, ()), (2, 3, (1,))]))
    assert set(at.iterdir()) == before
    with pytest.raises(ZeroDivisionError), lineage.scratch(spark):
        lineage.cut(spark.range(3))
        1 / 0
    assert set(at.iterdir()) == before


def test_warehouses_elsewhere_are_refused():
    for at in ("s3://bucket/w", "S3A://bucket/w", "hdfs://h/w"):
        with pytest.raises(catalog.CatalogError, match="no warehouse on"):
            catalog.Catalog(at)
    assert str(catalog.Catalog("file:///a/b").root) == "/a/b" and catalog.Catalog("memory://").root.is_dir()


def test_command_line(spark, tmp_path):
    run = lambda *a: cli.main(list(a), spark)
    run("generate", "--out", str(tmp_path / "raw"), "--events", "60", "--scopes", "3", "--partitions", "2")
    assert logs.read_log(spark, str(tmp_path / "raw")).groupBy("partition").agg(F.max("offset").alias("o"), F.count("*").alias("n")).where("o = n").count() == 2
    (tmp_path / "log").mkdir()
    for p in range(2):
        (tmp_path / "log" / f"partition-{p}.ndjson").write_text("".join(f.read_text() for f in sorted((tmp_path / "raw" / f"partition={p}").glob("part-*"))))
    at = ["--warehouse", str(tmp_path / "w"), "--log", str(tmp_path / "log")]
    assert json.loads(run("ingest", *at)[0]) == {"0": 30, "1": 30} and json.loads(run("stats", *at)[0])["events_applied"] == 60
    root = json.loads(run("components", *at, "--scope", "global", "--node", "5")[0])["root"]
    assert json.loads(run("connected", *at, "--scope", "global", "--node", "5", "--other", str(root))[0])["connected"]
    assert root in json.loads(run("members", *at, "--scope", "0", "--node", "5", "--cap", "9000")[0])["members"]
    assert len(run("scopes", *at)) == 3 and json.loads(run("retain", *at)[0])["deleted"] == [] and json.loads(run("health", *at)[0])["status"] == "ok"
    for bad in ({"fanout": 1}, {"stream_name": "x"}, {"keep": 0}):
        with pytest.raises(ValueError):
            Settings("w", **bad)


def test_union_view_and_children(spark):
    edges = [(1, 5, 0), (5, 9, 1), (9, 12, 2), (20, 21, 3), (1, 7, 0)]
    got = {r["node"]: r["root"] for r in topology.union_view(_frame(spark, edges)).collect()}
    assert got == {5: 1, 9: 1, 12: 1, 7: 1, 21: 20}
    state = topology.build(_frame(spark, edges))
    kids = topology.children_of(state, spark.createDataFrame([(1,)], "root long"), 1)
    assert [(r["root"], r["node"]) for r in kids.collect()] == [(1, 5)]
    assert {tuple(r) for r in topology.scopes_for_root(state, spark.createDataFrame([(9,), (3,)], "root long")).collect()} == {(9, 1), (9, 2)}
