"""Layers of routing state: a run holds what a commit changed; a stack of runs, oldest first, resolves to the state. Runs are merged by a size-tiered
policy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import Delta, resolve, shared_roots


@dataclass
class Run:
    """Pairs whose keys were roots below this run, and registrations."""

    shared: DataFrame
    overlay: DataFrame
    registry: DataFrame

    @staticmethod
    def of(delta: Delta) -> Run:
        return Run(delta.shared, delta.overlay, delta.registry)


def merged(runs: list[Run]) -> Run:
    """One run that stands for several adjacent ones, with every key once. Registrations on roots that were absorbed among them move to the
    survivors."""
    shared = resolve([r.shared for r in runs])
    registry = runs[0].registry
    for r in runs[1:]:
        registry = registry.unionByName(r.registry)
    return Run(shared, resolve([r.overlay for r in runs], scoped=True), moved_registry(registry, [r.shared for r in runs[1:]]))


def moved_registry(registry: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """(root, scope_id) with roots that newer layers absorbed replaced by their survivors."""
    return shared_roots(registry, "root", layers, "root").select("root", "scope_id").distinct()


def fallback_registry(shared: list[DataFrame], overlay: DataFrame) -> DataFrame:
    """The registry of a run that was written without one: the ends of its overlay, under their live shared roots."""
    ends = overlay.select(F.explode(F.array("node", "root")).alias("root"), "scope_id")
    return moved_registry(ends, shared)


def gaps(stack: DataFrame) -> DataFrame:
    """Runs (run, min_sequence, max_sequence), run being the place in the stack, that don't begin right after the one before; `before` is where that
    one ends. A join by place, as a window over all runs would be one task."""
    before = stack.select((F.col("run") + 1).alias("run"), F.col("max_sequence").alias("before"))
    return stack.join(before, "run").where("before + 1 <> min_sequence").select("run", "min_sequence", "before")


def unreachable(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Objects (object) of a listing that nothing live names."""
    return listing.join(live.select("object"), "object", "left_anti")


def pick_merge(levels: list[int], fanout: int, ceiling: int) -> tuple[int, int] | None:
    """The runs [from, to) to merge next: the oldest `fanout` runs of a stretch of one level, of the lowest level with a stretch that long. With
    `ceiling` runs or more and none that long, the lowest stretch of two or more; else none."""
    fanout = max(2, fanout)
    edges = [i for i in range(len(levels) + 1) if i in (0, len(levels)) or levels[i] != levels[i - 1]]
    stretches = [(levels[a], a, b) for a, b in zip(edges, edges[1:])]
    for least in (fanout, 2) if len(levels) >= ceiling else (fanout,):
        full = [s for s in stretches if s[2] - s[1] >= least]
        if full:
            _, a, b = min(full)
            return a, min(b, a + fanout)
    return None


def merged_level(levels: list[int]) -> int:
    return max(levels) + 1 if levels else 0


def locate(stack: Sequence[str], window: Sequence[str]) -> int | None:
    """Where a window of runs, by their paths, stands in the stack; None if it is no longer there as it was."""
    n = len(window)
    return next((i for i in range(len(stack) - n + 1) if n and list(stack[i : i + n]) == list(window)), None)


def spliced(stack: Sequence, at: int, n: int, one) -> list:
    """The stack with the n runs from `at` on replaced by one."""
    return [*stack[:at], one, *stack[at + n :]]
