"""Command line: python -m meshwright COMMAND --warehouse PATH .. Answers are printed as lines of JSON."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import asdict
from json import dumps

from pyspark.sql import SparkSession

from .config import Settings
from .sources import logs


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meshwright")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "components", "connected", "members", "scopes", "stats", "health", "compact", "retain"):
        p = commands.add_parser(name)
        Settings.add_to(p)
        if name in ("components", "connected", "members"):
            p.add_argument("--scope", required=True, help="a number, or global")
            p.add_argument("--node", type=int, required=True)
        if name == "connected":
            p.add_argument("--other", type=int, required=True)
        if name == "members":
            p.add_argument("--cap", type=int)
    p = commands.add_parser("generate")
    p.add_argument("--out", required=True)
    for flag, default in (("events", 10_000), ("nodes", 0), ("scopes", 8), ("global-pct", 15), ("multi-pct", 20), ("partitions", 1), ("seed", 42)):
        p.add_argument(f"--{flag}", type=int, default=default)
    p.add_argument("--links-per-node", type=float, default=1.8)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("meshwright").getOrCreate()
    if a.command == "generate":
        logs.write_log(logs.simulate(spark, a.events, a.nodes or None, a.scopes, a.global_pct, a.multi_pct, a.partitions, a.seed, a.links_per_node), a.out)
        return []
    s = Settings.of(a)
    e = s.engine(spark)
    if a.command == "ingest":
        if s.follow:
            e.follow_log(s.log, s.checkpoint or f"{s.warehouse}/checkpoint", s.max_records, s.merge).awaitTermination()
        else:
            e.ingest(s.log)
            while s.merge and e.compact():
                pass
        return [dumps({str(p): o for p, o in e.position().items()})]
    if a.command == "compact":
        return [dumps({"sequence": (done := e.compact()) and done.sequence})]
    if a.command == "retain":
        return [dumps(asdict(e.retain(s.keep, s.window_ms, s.grace_ms)))]
    if a.command == "health":
        return [dumps(e.health())]
    if a.command in ("stats", "scopes"):
        return (e.stats() if a.command == "stats" else e.scopes()).toJSON().collect()
    asked = e.ask([(a.scope, a.node)])
    if a.command == "components":
        return e.components(asked).toJSON().collect()
    if a.command == "members":
        return e.members(asked, a.cap).toJSON().collect()
    other = asked.withColumnRenamed("node", "u").selectExpr("scope_id", "u", f"{a.other}L AS v")
    return e.connected(other).toJSON().collect()


if __name__ == "__main__":
    print("\n".join(main()))
