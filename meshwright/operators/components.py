"""Connected components by repeated contraction over DataFrames: every node hooks to its lowest neighbour, parents are jumped, the graph shrinks
to its parents. The lowest node of a component is never hooked, so it ends as the component's root."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, lowest node of its component) of an edge list in memory."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return nodes, nodes[label]
        a, b = la[differ], lb[differ]  # the contracted edges
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def spanning_stars(edges: DataFrame, by: list[str]) -> DataFrame:
    """Fewer edges with the same components: each partition's edges, replaced by stars around its local roots. Their number is below the
    partition's number of nodes."""
    schema = edges.select(*by, "u", "v").schema

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        if not by:
            groups = [((), t)]
        else:
            t = t.sort_by([(c, "ascending") for c in by])
            cols = [t[c].to_numpy() for c in by]
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            edge = [*np.flatnonzero(new).tolist(), t.num_rows]
            groups = [(tuple(c[i] for c in cols), t.slice(i, j - i)) for i, j in zip(edge, edge[1:])]
        for key, g in groups:
            node, root = local_roots(g["u"].to_numpy(), g["v"].to_numpy())
            keep = node != root
            n = int(keep.sum())
            if n:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, k), schema_type) for k, schema_type in zip(key, (t.schema.field(c).type for c in by))), pa.array(node[keep]), pa.array(root[keep])], names=[*by, "u", "v"])

    return edges.select(*by, "u", "v").mapInArrow(run, schema)


#: Contracted edges that one task may finish in memory (16 bytes each).
FINISH_EDGES = 500_000


def components(edges: DataFrame, by: tuple[str, ...] = (), max_rounds: int = 60) -> DataFrame:
    """(by.., node, root) of every node with a root other than itself. edges: (by.., u, v) of longs, without nulls; direction, repetition and loops
    don't matter. `by` columns keep separate graphs apart. The result has been written to the shared folder."""
    by = list(by)
    e = edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(spanning_stars(e, by).distinct())
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        left = e.count()
        if not left:
            break
        if left <= FINISH_EDGES:
            one = e.repartition(*by) if by else e.repartition(1)
            maps.append(cut(spanning_stars(one, by).withColumnRenamed("v", "p")))
            break
        both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy(*by, "u").agg(F.least("u", F.min("v")).alias("p"))
        up = p.where("p <> u").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("u").alias("_u"), F.col("p").alias("_p"))
        on = lambda col, by=by: [F.col(col) == F.col("_u"), *(F.col(c) == F.col(f"_{c}") for c in by)]
        p = cut(p.join(up, on("p"), "left").select(*by, "u", F.coalesce("_p", "p").alias("p")).where("p <> u"))
        up = p.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("u").alias("_u"), F.col("p").alias("_p"))
        maps.append(p)
        moved = e.join(up, on("u"), "left").select(*by, F.coalesce("_p", "u").alias("u"), "v").join(up, on("v"), "left").select(*by, "u", F.coalesce("_p", "v").alias("v"))
        # A parent that was hooked itself stays tied to its own parent.
        tied = p.join(p.select(*by, F.col("p").alias("u")).distinct(), [*by, "u"], "left_semi").select(*by, "u", F.col("p").alias("v"))
        e = moved.unionByName(tied).where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = cut(e)
    else:
        raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
    if not maps:
        return e.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
    if len(maps) == 1:
        return maps[0].select(*by, F.col("u").alias("node"), F.col("p").alias("root"))
    done = maps[-1]
    for m in reversed(maps[:-1]):
        up = done.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("u").alias("_u"), F.col("p").alias("_p"))
        new = m.join(up, [F.col("p") == F.col("_u"), *(F.col(c) == F.col(f"_{c}") for c in by)], "left").select(*by, "u", F.coalesce("_p", "p").alias("p"))
        done = new.unionByName(done.join(m.select(*by, "u"), [*by, "u"], "left_anti"))
    return cut(done.select(*by, F.col("u").alias("node"), F.col("p").alias("root")))
