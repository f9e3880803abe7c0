"""Settings of a warehouse and its log, for programs and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .sources.catalog import GRACE_MS, KEEP, WINDOW_MS
from .streaming.engine import Engine


@dataclass
class Settings:
    warehouse: str
    log: str = ""  # a folder of partition-<n>.ndjson files, or one file
    stream_source: str = ""  # with stream_name, the identity of the log
    stream_name: str = ""
    checkpoint: str = ""
    follow: bool = False
    max_records: int = 10_000
    fanout: int = 4
    ceiling: int = 12
    merge: bool = True
    member_index: bool = True
    bloom: bool = True
    check: bool = True  # whether the commit is tried out first
    keep: int = KEEP
    window_ms: int = WINDOW_MS
    grace_ms: int = GRACE_MS

    def __post_init__(self):
        if self.fanout < 2 or self.ceiling < 2 or self.max_records < 1 or self.keep < 1 or min(self.window_ms, self.grace_ms) < 0:
            raise ValueError("fanout and ceiling are 2 or more, max_records and keep 1 or more, times not below 0")
        if bool(self.stream_source) != bool(self.stream_name):
            raise ValueError("a stream has a source and a name")

    def engine(self, spark: SparkSession) -> Engine:
        stream = {"source": self.stream_source, "name": self.stream_name} if self.stream_name else {"source": "log", "name": self.log} if self.log else None
        return Engine(spark, self.warehouse, stream, self.fanout, self.ceiling, self.check, self.member_index, self.bloom)

    @staticmethod
    def add_to(parser: argparse.ArgumentParser) -> None:
        for f in fields(Settings):
            flag = f"--{f.name.replace('_', '-')}"
            if f.type == "bool":
                parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
            else:
                parser.add_argument(flag, type={"int": int}.get(f.type, str), **({"default": f.default} if f.name != "warehouse" else {"required": True}))

    @staticmethod
    def of(args: argparse.Namespace) -> Settings:
        return Settings(**{f.name: getattr(args, f.name) for f in fields(Settings)})
