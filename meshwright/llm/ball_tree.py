"""Exact top-k inner products by branch and bound on ball trees, whose nodes are visited in the order of their upper bound and left out below the
current k-th score.

The top of one tree, fitted to a bounded sample, deals the vectors to cells by where they lie; every cell's ball is measured over all its vectors.
A query's cells go by their bounds too: it searches the best one first, then a few more, then all those that may still hold something better than
its k-th score so far, which it carries from round to round and into the trees. Cells with many vectors or queries are split over tasks.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part; a query meets only vectors
of its own length and never those with its own id; a repeated row is a row of its own; of equal vectors only those with the lowest ids can be
found and are searched; ties go to the smaller id; an empty table gives an empty result. Components are floor(256 * x); one of 2**53 or more, or
less than -2**53, raises, as its floor isn't exact; scores of 2**63 and more raise as well."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import chunks, cut, small

TOP, QUERY_EVERY, SCALE = 5, 50, 256
#: Vectors (and queries) of a task's share of a cell, and vectors of a leaf.
SHARD, LEAF = 8192, 256
#: The bounds of the sample that the cells are fitted to, in components, and of the number of cells; tasks of a search at most.
SAMPLE_VALUES, MAX_CELLS, MAX_TASKS = 8_000_000, 16_384, 20_000
#: Cells that a query has searched after each round; then all that are left.
ROUNDS = (1, 8)


def upper_bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and ball, no less than the inner product with any vector in the ball, rounding included."""
    size = np.sqrt((q**2).sum(1))[:, None]
    bounds = q @ centre.T + size * radius
    return bounds + size * (np.sqrt((centre**2).sum(1)) + radius) * 1e-9 + 1e-3


def _matrix(column) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0), np.int64)


class Cells:
    """The top of a ball tree: halves of a sample, split between two far points of it, down to `least` vectors."""

    def __init__(self, x: np.ndarray, cells: int):
        x = x.astype(np.float64)
        self.splits: list[tuple[np.ndarray, float, int, int]] = []  # direction, threshold, cells or splits (from ~0 down) on either side
        centres: list[np.ndarray] = []

        def build(rows: np.ndarray, cells: int) -> int:
            own = x[rows]
            d = ((own - own.mean(0)) ** 2).sum(1) if len(rows) else np.zeros(0)
            if cells > 1 and len(rows) > 1 and d.max() > 0:
                far = own[d.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                side = own @ (other - far)
                at = float(np.median(side))
                left = side <= at
                if left.all():
                    at = float(side[left].max()) - 1e-9 if side.min() == side.max() else float((side.min() + side.max()) / 2)
                    left = side <= at
                if 0 < left.sum() < len(rows):
                    k = len(self.splits)
                    self.splits.append((other - far, at, 0, 0))
                    a = build(rows[left], -(-cells // 2))
                    b = build(rows[~left], cells // 2)
                    self.splits[k] = (other - far, at, a, b)
                    return ~k
            centres.append(own.mean(0) if len(rows) else np.zeros(x.shape[1]))
            return len(centres) - 1

        self.root = build(np.arange(len(x)), cells)
        self.centre = np.array(centres)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if k >= 0:
                out[rows] = k
            elif len(rows):
                direction, at, a, b = self.splits[~k]
                left = x[rows] @ direction <= at
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


class Tree:
    """Balls over rows of integers. Nodes are (rows from, rows to, left, right); centres and radii are arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii = [], []
        order = np.lexsort((ids,))
        self.x = x.astype(np.float64)

        def build(i: int, j: int) -> int:
            rows = self.x[order[i:j]]
            c = rows.mean(0)
            d = np.sqrt(((rows - c) ** 2).sum(1))
            k = len(self.nodes)
            self.nodes.append((i, j, -1, -1))
            centres.append(c)
            radii.append(d.max() * (1 + 1e-9) + 1e-6)
            if j - i > leaf and d.max() > 0:
                far = rows[d.argmax()]
                other = rows[((rows - far) ** 2).sum(1).argmax()]
                side = rows @ (other - far)
                by = np.argsort(side, kind="stable")
                order[i:j] = order[i:j][by]
                m = (i + j) // 2
                self.nodes[k] = (i, j, build(i, m), build(m, j))
            return k

        if len(ids):
            build(0, len(ids))
        self.ids, self.x = ids[order], self.x[order]
        self.exact = not len(ids) or np.abs(x).max(initial=0) ** 2 * x.shape[1] < 2**52
        self.whole = None if self.exact else x[order].astype(object)
        self.centre, self.radius = np.array(centres), np.array(radii)

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
        """(row of q, id, score) of what is in the top k of each query and not below its floor."""
        out: list[tuple[int, int, int]] = []
        if not self.nodes:
            return out
        qf = q.astype(np.float64)
        bounds = upper_bounds(qf, self.centre, self.radius)
        for r in range(len(q)):
            bound, least = bounds[r], floor[r]
            ids, best = np.zeros(0, np.int64), np.zeros(0, np.float64 if self.exact else object)
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= least:
                _, n = heapq.heappop(heap)
                i, j, a, b = self.nodes[n]
                if a >= 0:
                    for c in (a, b):
                        if bound[c] >= least:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                s = self.x[i:j] @ qf[r] if self.exact else np.array([int(v) for v in self.whole[i:j] @ q[r].astype(object)], object)
                ok = (s >= least) & (self.ids[i:j] != qid[r])
                if ok.any():
                    ids, best = np.concatenate([ids, self.ids[i:j][ok]]), np.concatenate([best, s[ok]])
                    if len(ids) > k:
                        top = np.lexsort((ids, -best))[:k]
                        ids, best = ids[top], best[top]
                    if len(ids) == k:
                        least = max(least, best.min())
            out += [(r, int(i), int(s)) for i, s in zip(ids, best)]
        return out


_HITS = "query_id long, query_rid long, vec_id long, score long"


def _search(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """Rows are (g, kind, rid, id, v, dim, floor): the vectors (kind 0) and then the queries (kind 1) of a share of a cell."""

    def run(batches):
        tree, now, held = None, None, []

        for b in batches:
            g, d, kind = K.column(b, "g").to_numpy(), K.column(b, "dim").to_numpy(), K.column(b, "kind").to_numpy()
            new = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (kind[1:] != kind[:-1])
            edge = [0, *(np.flatnonzero(new) + 1).tolist(), len(g)]
            for i, j in zip(edge, edge[1:]):
                if i == j:
                    continue
                key = (int(g[i]), int(d[i]))
                if key != now:
                    now, tree, held = key, None, []
                part = b.slice(i, j - i)
                if kind[i] == 0:
                    held.append(part)
                    continue
                if tree is None:
                    t = pa.Table.from_batches(held) if held else None
                    tree = Tree(t["id"].to_numpy(), _matrix(t["v"])) if t is not None else Tree(np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
                    held = []
                qid, qrid = K.column(part, "id").to_numpy(), K.column(part, "rid").to_numpy()
                hits = tree.search(qid, _matrix(K.column(part, "v")), k, K.column(part, "floor").to_numpy())
                if hits:
                    r, ids, s = (np.array(c, np.int64) for c in zip(*hits))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(qrid[r]), pa.array(ids), pa.array(s)], names=["query_id", "query_rid", "vec_id", "score"])

    return rows.select("g", "dim", "kind", "id", "rid", "v", "floor").repartition(min(shards, MAX_TASKS), "g").sortWithinPartitions("g", "dim", "kind").mapInArrow(run, _HITS)


def _cells(used: DataFrame, n: int, shard: int) -> dict[int, Cells]:
    """Cells for the vectors of each length, fitted by one task to a sample of at most SAMPLE_VALUES components; the driver gets planes and centres.
    A length that the sample misses has none: its vectors are one cell."""
    values = used.agg(F.sum("dim")).first()[0] or 0
    rate = min(1.0, SAMPLE_VALUES / max(1, values))
    sample = used.select("dim", "v", F.xxhash64("rid").alias("h")).where((F.pmod("h", F.lit(1 << 20)) < rate * (1 << 20)) & (F.col("dim") <= SAMPLE_VALUES)).limit(SAMPLE_VALUES)

    def fitted(batches):
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            dim = K.column(b, "dim").to_numpy()
            for d in np.unique(dim).tolist():
                pick = pa.array(np.flatnonzero(dim == d))
                by.setdefault(d, []).append(_matrix(K.column(b, "v").take(pick)) if d else np.zeros((len(pick), 0), np.int64))
        seen = sum(len(x) for own in by.values() for x in own)
        made = {}
        for d, own in by.items():
            x = np.concatenate(own)
            made[d] = Cells(x, min(MAX_CELLS, chunks(round(n * len(x) / max(1, seen)), shard)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["cells"])

    got = sample.select("dim", "v").repartition(1).mapInArrow(fitted, "cells binary").collect()
    return {d: c for r in got for d, c in pickle.loads(r["cells"]).items()}


def _placed(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """rows (rid, id, v, dim) with their cell and distance to its centre."""

    def run(batches):
        for b in batches:
            dim = K.column(b, "dim").to_numpy()
            cell, dist = np.zeros(len(dim), np.int64), np.zeros(len(dim))
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                x = _matrix(K.column(b, "v").take(pa.array(at))).astype(np.float64) if d else np.zeros((len(at), 0))
                own = cells.get(d)
                cell[at] = own.place(x) if own else 0
                dist[at] = np.sqrt(((x - (own.centre[cell[at]] if own else 0)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*(K.column(b, c) for c in ("rid", "id", "v", "dim")), pa.array(cell), pa.array(dist)], names=["rid", "id", "v", "dim", "cell", "dist"])

    return rows.select("rid", "id", "v", "dim").mapInArrow(run, "rid long, id long, v array<long>, dim int, cell long, dist double")


def _routed(queries: DataFrame, balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: int, last: int | None) -> DataFrame:
    """A row for each query (rid, id, v, dim, floor) and cell that comes first to last in the order of its bounds and may hold a score not below
    the query's floor. balls: cells, centres and radii of each length."""

    def run(batches):
        for b in batches:
            dim, floor = K.column(b, "dim").to_numpy(), K.column(b, "floor").to_numpy()
            rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                if d not in balls:
                    continue
                q = _matrix(K.column(b, "v").take(pa.array(at))).astype(np.float64) if d else np.zeros((len(at), 0))
                number, centre, radius = balls[d]
                bound = upper_bounds(q, centre, radius)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                r, c = np.nonzero(np.take_along_axis(bound, order, 1) >= floor[at][:, None])
                rows.append(at[r])
                to.append(number[order[r, c]])
            pick = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(K.column(b, c).take(pick) for c in ("rid", "id", "v", "dim", "floor")), pa.array(np.concatenate(to))], names=["rid", "id", "v", "dim", "floor", "cell"])

    return queries.select("rid", "id", "v", "dim", "floor").mapInArrow(run, "rid long, id long, v array<long>, dim int, floor double, cell long")


def top_k(vectors: DataFrame, k: int = TOP, query_every: int = QUERY_EVERY, shard: int = SHARD, report: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query: the rows whose vec_id is divisible by query_every. report gets the
    number of (query, share of a cell) pairs searched in each round."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    safe = F.when(F.forall("embedding", lambda x: F.abs(x.cast("double") * SCALE) < float(1 << 53)), F.transform("embedding", lambda x: whole(x).cast("long")))
    v = F.coalesce(safe, F.raise_error(F.concat(F.lit("a component is too large for exact scores: vec_id "), F.col("vec_id").cast("string"))).cast("array<bigint>"))
    used = cut(vectors.where(ok).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("rid")))
    low = F.lit(float("-inf"))
    queries = used.where(F.col("id") % query_every == 0).withColumn("floor", low)
    # Of equal vectors, a query can find those of the k + 1 lowest ids (one may be its own), k of an id at most. Both limits work in every task first.
    same = used.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(4), "v")})
    same = same.withColumn("n", F.row_number().over(Window.partitionBy("h", "h2", "id").orderBy("rid"))).where(F.col("n") <= k)
    same = same.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    n = used.count()
    cells = _cells(used, n, shard)
    home = cut(_placed(same, cells))
    found = home.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("dist")).orderBy("dim", "cell").collect()  # a row for each cell
    number = {(r["dim"], r["cell"]): i for i, r in enumerate(found)}
    balls = {}
    for d in {r["dim"] for r in found}:
        own = [r for r in found if r["dim"] == d]
        at = [r["cell"] for r in own]
        centre = cells[d].centre[at] if d in cells else np.zeros((len(own), d))
        balls[d] = (np.array([number[d, c] for c in at]), centre, np.array([r["dist"] for r in own]) * (1 + 1e-9) + 1e-6)
    shares = home.sparkSession.createDataFrame([(i, d, c, chunks(found[i]["n"], shard)) for (d, c), i in number.items()], "cell long, _dim int, _cell long, parts long")
    home = home.join(small(shares), (F.col("dim") == F.col("_dim")) & (home["cell"] == F.col("_cell"))).select(shares["cell"], "rid", "id", "v", "dim", "parts")
    shares = shares.select(F.col("cell").alias("_c"), "parts")
    hits, seen = None, 0
    for last in (*ROUNDS, None):
        asked = cut(_routed(queries, balls, seen, last)).join(small(shares), F.col("cell") == F.col("_c")).drop("_c")
        many = cut(asked.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("times"), F.sum("parts").alias("pairs")).withColumnRenamed("cell", "_c"))
        work = many.agg(F.sum("pairs"), F.sum("times"), F.count("*")).first()
        if report is not None:
            report.append(int(work[0] or 0))
        if work[0]:
            # A share of a cell's vectors meets a share of its queries: neither is held by one task as a whole.
            share = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), n)
            times = small(many.select("_c", "times"))
            a = home.join(times, F.col("cell") == F.col("_c")).withColumns({"i": share(F.col("parts"), 1), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)), "kind": F.lit(0), "floor": low})
            b = asked.join(times, F.col("cell") == F.col("_c")).withColumns({"j": share(F.col("times"), 2), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "kind": F.lit(1)})
            both = a.select("cell", "i", "j", "dim", "kind", "id", "rid", "v", "floor").unionByName(b.select("cell", "i", "j", "dim", "kind", "id", "rid", "v", "floor"))
            new = cut(_search(both.withColumn("g", F.xxhash64("cell", "i", "j")), int(work[1]) + n // shard + 1, k))
            hits = new if hits is None else hits.unionByName(new)
        seen = last
        if last is None or seen >= max((len(c) for c, _, _ in balls.values()), default=0):
            break
        # The k-th score so far is the floor of the rounds to come; without k hits there is none.
        best = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)
        best = best.groupBy(F.col("query_rid").alias("_rid")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(low).alias("_floor"))
        queries = used.where(F.col("id") % query_every == 0).join(best, F.col("rid") == F.col("_rid"), "left").withColumn("floor", F.coalesce("_floor", low))
    if hits is None:
        return home.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
