"""Edge logs: NDJSON files whose offsets are line numbers from 1, alone or as partition-<n>.ndjson in a folder."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.model import normalize, parse_event
from ..plans.lineage import cut, small


class LogError(RuntimeError):
    """A log that isn't there, or isn't the one that was applied."""


_FILE = re.compile(r"partition-(\d+)\.ndjson$")


def _files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(file, whether its last line is open) of a log: one file, the partition-<n>.ndjson files of a folder, or the files below its partition=<n>
    folders. The driver reads the last byte of each."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise LogError(f"no log at {path}")
    found = []
    for s in [fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else [x for x in fs.listStatus(at)]:
        name = s.getPath().getName()
        if s.isDirectory() and re.match(r"partition=\d+$", name):
            found += [x for x in fs.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        elif s.isFile() and (_FILE.search(name) or s.getPath().equals(fs.getFileStatus(at).getPath())):
            found.append(s)
    if not found:
        raise LogError(f"{path} has no partitions")
    out = []
    for s in found:
        stop = s.getLen()
        if stop:
            one = fs.open(s.getPath())
            one.seek(stop - 1)
            out.append((s.getPath().toString(), one.read() != 10))
            one.close()
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(partition, offset, line) of whole lines; a last line without its line break isn't there yet. Files are read in splits: a line's number is
    its place in its split, after the lines of the partition's earlier files and splits."""
    files = _files(spark, path)
    if not files:
        return spark.createDataFrame([], "partition long, offset long, line string")
    whole = spark.read.option("lineSep", "\n").text([f for f, _ in files])  # a line that ends with \r\n keeps its \r, which JSON takes for a space
    raw = cut(whole.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")))
    number = F.regexp_extract("file", r"partition[-=](\d+)(?:\.ndjson|/[^/]*)$", 1)
    number = F.when(number == "", 0).otherwise(number.cast("long")).cast("long")
    ends = {re.sub(r"^file:/+", "/", f) for f, is_open in files if is_open}
    per = raw.groupBy("file", "block").agg(F.count("*").alias("lines"))
    before = Window.partitionBy("_p").orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(number.alias("_p"), F.col("file").alias("_f"), F.col("block").alias("_b"), "lines").withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    is_open = F.regexp_replace("_f", r"^file:/+", "/").isin(sorted(ends)) if ends else F.lit(False)
    last = F.row_number().over(Window.partitionBy("_f").orderBy(F.desc("_b"))) == 1
    per = small(cut(per.withColumn("short", last & is_open)))
    at = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    lines = raw.join(per, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).withColumn("at", at)
    return lines.where(~(F.col("short") & (F.col("at") == F.col("lines")))).select(F.col("_p").alias("partition"), (F.col("at") + F.col("before")).cast("long").alias("offset"), "line")


def read_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records (partition, offset, src, dst, scopes, event_time, props). strict: a line that is no event fails the job and names its place; else
    such lines are left out, see `malformed`."""
    return _events(read_lines(spark, path), strict)


def _events(lines: DataFrame, strict: bool) -> DataFrame:
    e = lines.withColumn("e", parse_event("line"))
    if strict:
        said = F.concat(F.lit("malformed record at partition "), F.col("partition").cast("string"), F.lit(", offset "), F.col("offset").cast("string"))
        e = e.withColumn("e", F.when(F.col("e").isNull(), F.raise_error(said).cast(e.schema["e"].dataType)).otherwise(F.col("e")))
    else:
        e = e.where("e is not null")
    return e.select("partition", "offset", "e.*")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).where(parse_event("line").isNull())


def seek(records: DataFrame, position: dict[int, int]) -> DataFrame:
    """Records after a position. A position past a partition's end is an error: the log isn't the one that was applied."""
    ends = {r["partition"]: r["offset"] for r in records.groupBy("partition").agg(F.max("offset").alias("offset")).collect()}
    for p, o in position.items():
        if o > ends.get(p, 0):
            raise LogError(f"partition {p} ends at {ends.get(p, 0)}, before the committed {o}")
    done = F.lit(0)
    for p, o in position.items():
        done = F.when(F.col("partition") == p, o).otherwise(done)
    return records.where(F.col("offset") > done)


@dataclass
class _Slice(InputPartition):
    """Whole lines of a file, from a byte on, the first of which has this offset."""

    file: str
    partition: int
    offset: int
    begin: int
    end: int


def _partitions(path: str) -> dict[int, str]:
    """The partition files that are there now."""
    at = Path(re.sub(r"^file:(//)?(?=/)", "", path))
    if at.is_file():
        return {int(m[1]) if (m := _FILE.search(at.name)) else 0: str(at)}
    found = {int(m[1]): str(f) for f in at.iterdir() if (m := _FILE.search(f.name))} if at.is_dir() else {}
    if not found:
        raise LogError(f"{path} has no partitions")
    return found


def _advance(file: str, begin: int, most: int, block: int = 1 << 20) -> tuple[int, int]:
    """(bytes, lines) of the whole lines after a byte, `most` lines at most."""
    lines, end, at = 0, begin, begin
    with open(file, "rb") as f:
        f.seek(begin)
        while lines < most and (data := f.read(block)):
            n = data.count(b"\n")
            if lines + n > most:
                for _ in range(most - lines):
                    end = at + data.index(b"\n", max(0, end - at)) + 1
                return end - begin, most
            if n:
                end, lines = at + data.rindex(b"\n") + 1, lines + n
            at += len(data)
    return end - begin, lines


class _LogStream(DataSourceStreamReader):
    """Offsets of the stream are {partition: [lines, bytes]} read so far. Each batch takes up to max_records lines, the partitions in equal shares;
    the driver counts line breaks in those, executors read and number the lines."""

    def __init__(self, path: str, position: dict[int, int], max_records: int):
        self.path, self.position, self.max_records, self.at = path, position, max_records, None

    def initialOffset(self) -> dict:
        files, out = _partitions(self.path), {}
        for p, lines in sorted(self.position.items()):
            size, found = _advance(files[p], 0, lines) if p in files else (0, 0)
            if found < lines:
                raise LogError(f"partition {p} ends at {found}, before the committed {lines}")
            out[str(p)] = [lines, size]
        return out

    def latestOffset(self) -> dict:
        files = _partitions(self.path)
        at = dict(self.at if self.at is not None else self.initialOffset())
        share = max(1, -(-self.max_records // len(files)))
        for p, file in sorted(files.items()):
            lines, size = at.get(str(p), [0, 0])
            if os.path.getsize(file) > size:
                more, n = _advance(file, size, share)
                lines, size = lines + n, size + more
            at[str(p)] = [lines, size]
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, out = _partitions(self.path), []
        self.at = max(self.at or {}, end, key=lambda o: sum(v[0] for v in o.values()))
        for p, (lines, size) in end.items():
            first, begin = start.get(p, [0, 0])
            if lines > first:
                out.append(_Slice(files[int(p)], int(p), first + 1, begin, size))
        return out or [_Slice("", 0, 0, 0, 0)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if partition.end <= partition.begin:
            return
        with open(partition.file, "rb") as f:
            f.seek(partition.begin)
            left, offset = partition.end - partition.begin, partition.offset
            while left > 0:
                line = f.readline()
                left -= len(line)
                yield partition.partition, offset, line.decode("utf-8", "replace").rstrip("\r\n")
                offset += 1


class LogSource(DataSource):
    """spark.readStream.format("meshwright_log"): options path, position (JSON, {partition: offset}) and max_records. The files must be on a file
    system that the driver and all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "meshwright_log"

    def schema(self) -> str:
        return "partition long, offset long, line string"

    def streamReader(self, schema) -> _LogStream:
        position = json.loads(self.options.get("position", "{}"))
        return _LogStream(self.options["path"], {int(p): int(o) for p, o in position.items()}, int(self.options.get("max_records", 10_000)))


def read_stream(spark: SparkSession, path: str, position: dict[int, int] | None = None, max_records: int = 10_000) -> DataFrame:
    """Records of a log as a stream, from a position on: appended lines and new partitions are picked up, a line without its line break is left
    until it has one, and a line that is no event fails the batch. A stream that goes on from a checkpoint goes on from there."""
    spark.dataSource.register(LogSource)
    lines = spark.readStream.format("meshwright_log").options(path=path, position=json.dumps({str(p): o for p, o in (position or {}).items()}), max_records=max_records).load()
    return _events(lines, strict=True)


def write_log(records: DataFrame, path: str) -> None:
    """Writes records (partition, offset, src, dst, scopes, event_time, props) as a log: a folder of NDJSON text in offset order for each
    partition. Meant for tests and simulation."""
    scopes = normalize("scopes")
    v = F.when(F.array_contains(scopes, 0), F.lit('"global"')).otherwise(F.concat(F.lit('{"scoped":'), F.to_json(scopes), F.lit("}")))
    props = F.when(F.col("props").isNull(), "").otherwise(F.concat(F.lit(',"props":'), F.expr("substr(to_json(array(props)), 2, length(to_json(array(props))) - 2)")))
    line = F.concat(F.lit('{"src":'), F.col("src").cast("string"), F.lit(',"dst":'), F.col("dst").cast("string"), F.lit(',"visibility":'), v, F.lit(',"event_time_ms":'), F.unix_millis(F.col("event_time").cast("timestamp")).cast("string"), props, F.lit("}"))
    records.select("partition", "offset", line.alias("value")).repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset").select("value", "partition").write.partitionBy("partition").text(path)


def simulate(spark: SparkSession, events: int, nodes: int | None, scopes: int, global_pct: int = 15, multi_pct: int = 20, partitions: int = 1, seed: int = 42, links_per_node: float = 1.8) -> DataFrame:
    """Random records, the same for the same arguments. Without nodes, there are so many that each has links_per_node links."""
    nodes = nodes or max(2, int(events / links_per_node))
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    one, two = pick(1, scopes) + 1, pick(2, scopes) + 1
    seen = F.when(pick(3, 100) < global_pct, F.array().cast("array<bigint>")).when(pick(4, 100) < multi_pct, F.array(one, two)).otherwise(F.array(one))
    t = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id"))
    return spark.range(events).select(
        (F.col("id") % partitions).alias("partition"), (F.floor(F.col("id") / partitions) + 1).alias("offset"), pick(5, nodes).alias("src"), pick(6, nodes).alias("dst"), normalize(seen).alias("scopes"), t.alias("event_time"),
        F.concat(F.lit('{"weight":'), (pick(7, 99) + 1).cast("string"), F.lit("}")).alias("props")
    )
