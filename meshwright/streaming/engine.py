"""The engine: applies records to a warehouse, commits snapshots, answers lookups from the latest one.

A warehouse has data/ (edge rows, Parquet), runs/ (routing state) and metadata/ (snapshots). Rows and runs are visible only once a snapshot
names them. Records at or below the committed position are skipped, so a batch may come again. A commit writes what its batch changed; merges
of runs are made beside it and put in place by commits of their own."""

from __future__ import annotations

import shutil
import threading
import time
import uuid
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import EDGE_TABLE, explode_by_scope, normalize, parse_scope
from ..operators import layers, positions, topology
from ..plans.lineage import cut, scratch
from ..sources.catalog import GRACE_MS, KEEP, WINDOW_MS, Catalog, CatalogError, Reclaimed, RunMeta, Snapshot, collect, preflight

PAIRS, SCOPED, REGISTRY = "node long, root long", "scope_id long, node long, root long", "root long, scope_id long"
CHILDREN, SCOPED_CHILDREN = "root long, rank int, node long", "scope_id long, root long, rank int, node long"
#: Edge rows of a data file.
FILE_ROWS = 5_000_000
#: Rows that one task writes.
SMALL_ROWS = 500_000


class LogBackedError(RuntimeError):
    """Edges can't be injected by hand into a warehouse that follows a log."""


class Conflict(RuntimeError):
    """Another writer committed first."""


class MembersUnavailable(RuntimeError):
    """A run of the warehouse was written without the member index."""


@dataclass
class Merge:
    """A merge of runs that was begun: the window it read, by identity, and the run it writes."""

    window: list[RunMeta]
    run: RunMeta | None = None
    error: BaseException | None = None
    thread: threading.Thread | None = None


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str, stream: dict | None = None, fanout: int = 4, ceiling: int = 12, check: bool = True, member_index: bool = True, bloom: bool = True):
        """stream: {source, name} of the log that the warehouse follows. member_index: whether runs get one; without it in any run, members are
        refused. bloom: whether runs get Parquet bloom filters on their keys."""
        self.spark, self.stream, self.fanout, self.ceiling, self.member_index, self.bloom = spark, stream, fanout, ceiling, member_index, bloom
        self.catalog = Catalog(warehouse)
        self.root, self.began = str(self.catalog.root), time.time()
        if check:
            preflight(self.root)
        last = self.catalog.latest()
        if last and stream and last.stream and any(last.stream.get(k) != stream.get(k) for k in ("source", "name")):
            raise CatalogError(f"the warehouse follows {last.stream}, not {stream}")

    # reading

    def _frame(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"file://{self.root}/{path}")

    def _runs(self, metas: list[RunMeta]) -> list[layers.Run]:
        runs = []
        for m in metas:
            shared, overlay = self._frame(f"{m.path}/shared", PAIRS), self._frame(f"{m.path}/overlay", SCOPED)
            known = (Path(self.root) / m.path / "registry").exists()
            runs.append(layers.Run(shared, overlay, self._frame(f"{m.path}/registry", REGISTRY) if known else layers.fallback_registry([r.shared for r in runs] + [shared], overlay)))
        return runs

    def state(self, snapshot: Snapshot | None = None) -> topology.State:
        """The state of a snapshot (the latest), as its layers: later commits don't change it."""
        snap = snapshot or self.catalog.latest()
        metas = self.catalog.run_set(snap) if snap else []
        if not metas:
            empty = lambda s: self.spark.createDataFrame([], s)
            return topology.State(empty(PAIRS), empty(SCOPED), empty(REGISTRY))
        runs = self._runs(metas)
        registry = runs[0].registry
        for r in runs[1:]:
            registry = registry.unionByName(r.registry)
        children = None
        if all(m.member_index for m in metas):
            children = [self._frame(f"{m.path}/children", CHILDREN) for m in metas], [self._frame(f"{m.path}/scoped_children", SCOPED_CHILDREN) for m in metas]
        return topology.State([r.shared for r in runs], [r.overlay for r in runs], registry, children)

    def position(self) -> dict[int, int]:
        last = self.catalog.latest()
        return last.stream_position() if last else {}

    def edges(self) -> DataFrame:
        """The edge rows of all commits, those of expired snapshots too."""
        files = [f"file://{self.root}/{f['path']}" for f in self.catalog.data_files()]
        return self.spark.read.schema(EDGE_TABLE).parquet(*files) if files else self.spark.createDataFrame([], EDGE_TABLE)

    def components(self, asked: DataFrame) -> DataFrame:
        return topology.scope_root(self.state(), asked)

    def connected(self, asked: DataFrame) -> DataFrame:
        return topology.connected(self.state(), asked)

    @property
    def members_available(self) -> bool:
        last = self.catalog.latest()
        return self.member_index and all(m.member_index for m in (self.catalog.run_set(last) if last else []))

    def members(self, asked: DataFrame, cap: int | None = None) -> DataFrame:
        """The members of the components of asked (scope_id, node), `cap` of each at most (MEMBER_CAP if None). Refused without the member index."""
        if not self.members_available:
            raise MembersUnavailable("a run was written without the member index; members can't be listed in bounded work")
        return topology.members(self.state(), asked, topology.MEMBER_CAP if cap is None else cap)

    def scopes(self) -> DataFrame:
        return topology.scopes(self.state())

    def ask(self, scopes: list[tuple[str, int]]) -> DataFrame:
        """(scope_id, node) of scopes given as text; a bad scope raises."""
        df = self.spark.createDataFrame(scopes, "scope string, node long").withColumn("scope_id", parse_scope("scope"))
        bad = [r["scope"] for r in df.where("scope_id is null").collect()]
        if bad:
            raise ValueError(f"not a scope: {bad}")
        return df.select("scope_id", "node")

    def stats(self) -> DataFrame:
        """One row of counters. Those of events are kept with the commits, so that nothing is read again. scope_links counts events and the scopes
        that see them, merged or not; merge_fixups those that changed something. No rows wait in a buffer and no index is held in memory, as a
        batch is written before it is committed."""
        snap = self.catalog.latest()
        metas, c = (self.catalog.run_set(snap), snap.counters) if snap else ([], {})
        row = {k: c.get(k, 0) for k in ("events_applied", "global_merges", "global_links", "scope_links", "merge_fixups", "folds")}
        row |= {
            "members_available": self.members_available, "member_heap_bytes": 0, "active_scopes": self.scopes().count() if metas else 0,
            "base_shared_pairs": sum(m.shared_pairs for m in metas), "base_overlay_pairs": sum(m.overlay_pairs for m in metas),
            "base_mapped_bytes": sum(m.bytes for m in metas), "base_index_bytes": sum(m.index_bytes for m in metas), "base_sequence": snap.sequence if snap else 0, "runs": len(metas),
            "active_rows": 0, "sealed_rows": 0, "sealed_segments": 0, "sealed_bytes": 0, "last_offset": max(snap.stream_position().values(), default=0) if snap else 0,
        }
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in row.items()))

    def health(self) -> dict:
        return {"status": "ok", "worker_id": self.catalog.id, "leader": True, "uptime_secs": int(time.time() - self.began)}

    # writing

    def _write(self, name: str, df: DataFrame, sort: list[str], key: str | None = None, rows: int = FILE_ROWS) -> None:
        """Writes a frame of about so many rows, one file if they are few, with a Bloom filter of the key that is as large as they need."""
        w = (df.coalesce(1) if rows <= SMALL_ROWS else df).sortWithinPartitions(*sort).write.option("compression", "zstd")
        if key and self.bloom:
            w = w.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, min(rows, FILE_ROWS))))
        w.parquet(f"file://{self.root}/{name}")

    def _write_run(self, run: layers.Run, level: int, first: int, last: int, shared_rows: int, overlay_rows: int, registry_rows: int) -> RunMeta:
        path = f"runs/run-{last:012d}-{uuid.uuid4().hex}"
        at = Path(self.root) / path
        self._write(f"{path}/shared", run.shared.select("node", "root"), ["node"], "node", shared_rows)
        self._write(f"{path}/overlay", run.overlay.select("scope_id", "node", "root"), ["scope_id", "node"], "node", overlay_rows)
        self._write(f"{path}/registry", run.registry.select("root", "scope_id"), ["root"], "root", registry_rows)
        shared, overlay = self._frame(f"{path}/shared", PAIRS), self._frame(f"{path}/overlay", SCOPED)
        if self.member_index:
            self._write(f"{path}/children", topology.ranked_children(shared), ["root", "rank"], "root", shared_rows)
            self._write(f"{path}/scoped_children", topology.ranked_children(overlay, True), ["scope_id", "root", "rank"], "root", overlay_rows)
        size = lambda *names: sum(f.stat().st_size for n in names for f in (at / n).rglob("*.parquet"))
        a, b = shared.count(), overlay.count()
        return RunMeta(path, level, first, last, a + b, size("shared", "overlay", "registry"), a, b, self.member_index, size("children", "scoped_children"))

    def _commit(self, snap: Snapshot) -> Snapshot:
        if not self.catalog.commit(snap):
            raise Conflict(f"snapshot {snap.sequence} is taken")
        return snap

    def apply(self, records: DataFrame, arrival: str | None = None) -> Snapshot | None:
        """Applies the records above the committed position and commits them; None if there are none. Raises on a reserved or repeated offset, and
        where a column tells the order in which records arrived, on a partition that goes backwards. records are evaluated once."""
        with scratch(self.spark):
            return self._apply(records, arrival)

    def _apply(self, records: DataFrame, arrival: str | None) -> Snapshot | None:
        last = self.catalog.latest()
        done = last.stream_position() if last else {}
        sequence = (last.sequence if last else 0) + 1
        came = cut(records)
        bad = positions.faults(came).limit(1).collect()
        if bad:
            raise ValueError(f"partition {bad[0]['partition']}: offset {bad[0]['offset']} is reserved or repeated")
        back = positions.out_of_order(came, arrival).limit(1).collect() if arrival else []
        if back:
            raise ValueError(f"partition {back[0]['partition']}: offset {back[0]['offset']} came after {back[0]['before']}")
        new = positions.above(came, positions.frame(self.spark, done))
        extent = positions.extents(new, []).collect()
        if not extent:
            return None
        events = sum(r["rows"] for r in extent)
        data = f"data/part-{sequence:012d}-{uuid.uuid4().hex}"
        rows = explode_by_scope(new).select("partition", "offset", "src", "dst", "scope_id", "event_time", "props")
        files = -(-events // FILE_ROWS)
        rows = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "scope_id", "src")  # files hold ranges of scopes and sources
        self._write(data, rows, ["scope_id", "src"])
        rows = self._frame(data, EDGE_TABLE)
        links = rows.agg(F.count_if(F.col("scope_id") == 0).alias("g"), F.count_if(F.col("scope_id") != 0).alias("s")).first()
        delta = topology.advance(self.state(last), rows.select("src", "dst", "scope_id"))
        run = self._write_run(layers.Run.of(delta), 0, sequence, sequence, delta.shared.count(), delta.overlay.count(), delta.registry.count())
        first, end = {r["partition"]: r["first_offset"] for r in extent}, {r["partition"]: r["last_offset"] for r in extent}
        file = {"path": data, "rows": links["g"] + links["s"], "bytes": sum(f.stat().st_size for f in (Path(self.root) / data).glob("*.parquet")), "first_position": first, "last_position": end, "min_offset": min(first.values()), "max_offset": max(end.values())}
        metas = [replace(m) for m in (self.catalog.run_set(last) if last else [])]
        if metas:
            metas[-1].max_sequence = sequence - 1  # commits without a run of their own
        more = {"events_applied": events, "global_links": links["g"], "scope_links": links["s"], "global_merges": run.shared_pairs, "merge_fixups": delta.fixups.count(), "folds": 1}
        old = last.counters if last else {}
        counters = {k: old.get(k, 0) + v for k, v in more.items()}
        return self._commit(Snapshot(sequence, position=positions.joined(done, end), stream=self.stream or (last.stream if last else None), data_files=[file], runs=[*metas, run], history=last.history if last else None, counters=counters))

    def begin_merge(self, wait: bool = False) -> Merge | None:
        """Starts to merge the runs that the policy names, beside whatever is applied meanwhile; None if nothing is due."""
        last = self.catalog.latest()
        metas = self.catalog.run_set(last) if last else []
        due = layers.pick_merge([m.level for m in metas], self.fanout, self.ceiling)
        if not due:
            return None
        merge = Merge(metas[due[0] : due[1]])

        def work():
            try:
                with scratch(self.spark):
                    one, w = layers.merged(self._runs(merge.window)), merge.window
                    shared, overlay = sum(m.shared_pairs for m in w), sum(m.overlay_pairs for m in w)
                    merge.run = self._write_run(one, layers.merged_level([m.level for m in w]), w[0].min_sequence, w[-1].max_sequence, shared, overlay, 2 * overlay)
            except BaseException as e:  # told to whoever adopts the merge
                merge.error = e

        if wait:
            work()
        else:
            merge.thread = threading.Thread(target=work, daemon=True)
            merge.thread.start()
        return merge

    def adopt(self, merge: Merge) -> Snapshot | None:
        """Commits a finished merge in place of its window, with the previous position and no data files. If the window is gone, or another writer
        commits first, the merged run is discarded."""
        if merge.thread:
            merge.thread.join()
        if merge.error:
            raise merge.error
        last = self.catalog.latest()
        stack = self.catalog.run_set(last)
        at = layers.locate([m.path for m in stack], [m.path for m in merge.window])
        if at is not None:
            one = replace(merge.run, min_sequence=stack[at].min_sequence, max_sequence=stack[at + len(merge.window) - 1].max_sequence)
            stack = [replace(m) for m in layers.spliced(stack, at, len(merge.window), one)]
            stack[-1].max_sequence = last.sequence + 1
            new = Snapshot(last.sequence + 1, position=last.stream_position(), stream=last.stream, runs=stack, history=last.history, counters=last.counters)
            if self.catalog.commit(new):
                return new
        shutil.rmtree(Path(self.root) / merge.run.path)
        return None

    def compact(self) -> Snapshot | None:
        """Merges the runs that the policy names and commits the shorter stack; None if nothing is due."""
        merge = self.begin_merge(wait=True)
        return self.adopt(merge) if merge else None

    def retain(self, keep: int = KEEP, window_ms: int = WINDOW_MS, grace_ms: int = GRACE_MS, now_ms: int | None = None) -> Reclaimed:
        return collect(self.catalog, keep, window_ms, grace_ms, now_ms)

    def inject(self, rows: DataFrame) -> Snapshot | None:
        """Applies edges (src, dst, scopes, props) with offsets minted after the last one of partition 0."""
        if self.stream:
            raise LogBackedError(f"the warehouse follows {self.stream}")
        at = self.position().get(0, 0)
        with scratch(self.spark):
            own = cut(rows.select("src", "dst", normalize("scopes").alias("scopes"), F.current_timestamp().alias("event_time"), "props", F.monotonically_increasing_id().alias("m")))
            # Offsets may have gaps: a row's place among all keeps them increasing without a sort in one task.
            return self._apply(own.select(F.lit(0).cast("long").alias("partition"), (F.col("m") + at + 1).alias("offset"), "src", "dst", "scopes", "event_time", "props"), None)

    def follow(self, records: DataFrame, checkpoint: str, available_now: bool = True, seconds: float = 1.0, merge: bool = False):
        """Starts a streaming query that applies each micro-batch of a streaming frame of records. Positions in the catalog, not batch numbers,
        tell what has been applied. merge: whether runs are merged between batches when due."""

        def one(batch: DataFrame, _: int) -> None:
            self.apply(batch)
            if merge:
                self.compact()

        write = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        return (write.trigger(availableNow=True) if available_now else write.trigger(processingTime=f"{seconds} seconds")).start()

    def ingest(self, path: str) -> Snapshot | None:
        """Applies what a log of files has after the committed position, in one batch of any size."""
        from ..sources.logs import read_log, seek

        with scratch(self.spark):
            return self._apply(seek(read_log(self.spark, path), self.position()), None)

    def follow_log(self, path: str, checkpoint: str, max_records: int = 10_000, merge: bool = False):
        """Follows a folder of partition-<n>.ndjson files, or one file, from the committed position on for as long as they grow."""
        from ..sources.logs import read_stream

        return self.follow(read_stream(self.spark, path, self.position(), max_records), checkpoint, available_now=False, merge=merge)
