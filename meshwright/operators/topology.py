"""Topology of scoped graphs: what every scope shares is one set of components; each scope's own edges join shared components to larger ones.

State is three stacks of layers, oldest first: shared (node, root), overlay (scope_id, node, root) over shared roots, and registry
(root, scope_id). A layer's keys were roots below it, so that a node's root is found by one left join a layer, without recursion; a scope's root
of a node is overlay(shared(node)). A state that was built at once has one layer of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, small
from .components import components

MEMBER_CAP, MOST_MEMBERS = 1000, 10_000


@dataclass
class Delta:
    """What a batch changes: pairs of former roots, new registrations, and the fix-ups (scope_id, u, v) by which global merges reach overlays."""

    shared: DataFrame
    overlay: DataFrame
    registry: DataFrame
    fixups: DataFrame


class State:
    """shared and overlay: a frame, or its layers. registry may still name roots that were absorbed later; they are never asked for again.
    children: for each layer of both, its member index (`ranked_children`); without it, it is made when members are asked for."""

    def __init__(self, shared: DataFrame | list[DataFrame], overlay: DataFrame | list[DataFrame], registry: DataFrame, children: tuple[list[DataFrame], list[DataFrame]] | None = None):
        self.shared_layers = shared if isinstance(shared, list) else [shared]
        self.overlay_layers = overlay if isinstance(overlay, list) else [overlay]
        self.registry, self.children = registry, children

    @property
    def shared(self) -> DataFrame:
        return resolve(self.shared_layers)

    @property
    def overlay(self) -> DataFrame:
        return resolve(self.overlay_layers, scoped=True)

    def plus(self, delta: Delta) -> State:
        return State([*self.shared_layers, delta.shared], [*self.overlay_layers, delta.overlay], self.registry.unionByName(delta.registry))

    def routing(self) -> DataFrame:
        """(scope_id, node, root) with the shared layer as scope 0."""
        return self.shared.select(F.lit(0).cast("long").alias("scope_id"), "node", "root").unionByName(self.overlay)


def shared_roots(df: DataFrame, col: str, shared: DataFrame | list[DataFrame], out: str) -> DataFrame:
    """df with the shared root of a column."""
    df = df.withColumn(out, F.col(col))
    for layer in shared if isinstance(shared, list) else [shared]:
        s = layer.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        df = df.join(s, F.col(out) == F.col("_n"), "left").withColumn(out, F.coalesce("_r", out)).drop("_n", "_r")
    return df


def overlay_roots(df: DataFrame, col: str, overlay: DataFrame | list[DataFrame], out: str) -> DataFrame:
    """df (scope_id, ..) with its scope's root of a column of shared roots."""
    df = df.withColumn(out, F.col(col))
    for layer in overlay if isinstance(overlay, list) else [overlay]:
        o = layer.select(F.col("scope_id").alias("_s"), F.col("node").alias("_n"), F.col("root").alias("_r"))
        df = df.join(o, (F.col("scope_id") == F.col("_s")) & (F.col(out) == F.col("_n")), "left").withColumn(out, F.coalesce("_r", out)).drop("_s", "_n", "_r")
    return df


def resolve(stack: list[DataFrame], scoped: bool = False) -> DataFrame:
    """The pairs of all layers, their roots followed through the newer ones."""
    cols = ["scope_id", "node", "root"] if scoped else ["node", "root"]
    done = stack[0].select(cols)
    for layer in stack[1:]:
        moved = overlay_roots(done, "root", layer, "root") if scoped else shared_roots(done, "root", layer, "root")
        done = moved.select(cols).unionByName(layer.select(cols))
    return done.where("node <> root")


def contract(edges: DataFrame, shared: DataFrame | list[DataFrame]) -> DataFrame:
    """Scoped edges (src, dst, scope_id) between shared roots, as (scope_id, u, v)."""
    own = edges.where("scope_id <> 0").select("scope_id", "src", "dst").distinct()
    return shared_roots(shared_roots(own, "src", shared, "u"), "dst", shared, "v").select("scope_id", "u", "v").distinct()


def registered(own: DataFrame) -> DataFrame:
    """(root, scope_id) of both ends of contracted edges."""
    return own.select(F.explode(F.array("u", "v")).alias("root"), "scope_id").distinct()


def build(edges: DataFrame) -> State:
    """The state of a whole edge set (src, dst, scope_id), one row for each edge and scope."""
    shared = components(edges.where("scope_id = 0").select(F.col("src").alias("u"), F.col("dst").alias("v")))
    own = cut(contract(edges, shared))
    overlay = components(own, ("scope_id",))
    return State(shared, overlay.select("scope_id", "node", "root"), registered(own))


def union_view(edges: DataFrame) -> DataFrame:
    """(node, root) over the edges of all scopes together."""
    return components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def scope_root(state: State, asked: DataFrame, node: str = "node", out: str = "root") -> DataFrame:
    """asked (scope_id, node, ..) with the lowest node that the scope connects each node to. Unseen nodes are their own roots, unseen scopes see
    the shared graph."""
    return overlay_roots(shared_roots(asked, node, state.shared_layers, "_shared"), "_shared", state.overlay_layers, out).drop("_shared")


def connected(state: State, asked: DataFrame) -> DataFrame:
    """asked (scope_id, u, v) with `connected`."""
    q = scope_root(state, scope_root(state, asked, "u", "_ru"), "v", "_rv")
    return q.withColumn("connected", F.col("_ru") == F.col("_rv")).drop("_ru", "_rv")


def scopes_for_root(state: State, roots: DataFrame | None = None) -> DataFrame:
    """(root, scope_id): the scopes with overlay state on live shared roots, of those in roots (root) if given."""
    r = shared_roots(state.registry, "root", state.shared_layers, "root").select("root", "scope_id").distinct()
    return r if roots is None else r.join(roots.select("root").distinct(), "root", "left_semi")


def scopes(state: State) -> DataFrame:
    return state.registry.select("scope_id").distinct()


def ranked_children(pairs: DataFrame, scoped: bool = False, most: int = MOST_MEMBERS + 1) -> DataFrame:
    """The member index of a layer: each root's children with their ranks, the lowest `most` of each, as no answer holds more. Every task keeps that
    many of a root at most, so a hub is never in one place."""
    by = ["scope_id", "root"] if scoped else ["root"]
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("node"))).where(F.col("rank") <= most).select(*by, "rank", "node")


def children_of(state: State, roots: DataFrame, limit: int) -> DataFrame:
    """Up to `limit` nodes right below each root (root), lowest first, over all layers of the shared graph."""
    index = state.children[0] if state.children else [ranked_children(p, most=limit) for p in state.shared_layers]
    kids = None
    for layer in index:
        own = layer.where(F.col("rank") <= limit).join(roots.select("root").distinct(), "root", "left_semi").select("root", "node")
        kids = own if kids is None else kids.unionByName(own)
    return kids.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("node"))).where(F.col("rank") <= limit)


def _down(state: State, roots: DataFrame, cap: int | None) -> DataFrame:
    """(scope_id, root, member) of each different (scope_id, root): down the layers of the overlay, newest first, then down the shared ones. With a
    cap, the lowest cap + 1. A node is below its children, so those of a node left out would be left out too: each step may keep cap + 1 of a
    component, and look at cap + 1 children of a node."""

    # An overlay of several layers may name roots that the shared layer absorbed later, so that a member is reached twice.
    twice = len(state.overlay_layers) > 1

    def lowest(rows: DataFrame) -> DataFrame:
        rows = rows.distinct() if twice else rows
        if cap is None:
            return rows
        w = Window.partitionBy("scope_id", "root").orderBy("member")
        return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap + 1).drop("_n")

    def kids(pairs: list[DataFrame], index: list[DataFrame] | None, scoped: bool) -> list[DataFrame]:
        if cap is None:
            return pairs
        found = index if index is not None else [ranked_children(p, scoped, cap + 1) for p in pairs]
        return [f.where(F.col("rank") <= cap + 1) for f in found]

    rows = roots.select("scope_id", "root").distinct().withColumn("member", F.col("root"))
    own, common = state.children or (None, None), None
    for layer in reversed(kids(state.overlay_layers, own[1], True)):
        o = layer.select(F.col("scope_id").alias("_s"), F.col("root").alias("_r"), F.col("node").alias("_n"))
        more = rows.join(o, (F.col("scope_id") == F.col("_s")) & (F.col("member") == F.col("_r"))).select("scope_id", "root", F.col("_n").alias("member"))
        rows = lowest(rows.unionByName(more))
    for layer in reversed(kids(state.shared_layers, own[0], False)):
        s = layer.select(F.col("root").alias("_r"), F.col("node").alias("_n"))
        more = rows.join(s, F.col("member") == F.col("_r")).select("scope_id", "root", F.col("_n").alias("member"))
        rows = lowest(rows.unionByName(more))
    return rows


def member_rows(state: State, asked: DataFrame) -> DataFrame:
    """A row (scope_id, node, root, member) for each member of the component of each different (scope_id, node) asked for: an export, without a
    bound. Each component is listed once and then joined to those that ask for it."""
    q = scope_root(state, asked.select("scope_id", "node").distinct()).select("scope_id", "node", "root")
    return q.join(_down(state, q, None), ["scope_id", "root"]).select("scope_id", "node", "root", "member")


def members(state: State, asked: DataFrame, cap: int = MEMBER_CAP) -> DataFrame:
    """(scope_id, node, root, members, count, truncated) for each different (scope_id, node): the lowest `cap` members; truncated if there are more.
    Each component is listed once, from cap + 1 rows at most, whoever asks for it."""
    if not 1 <= cap <= MOST_MEMBERS:
        raise ValueError(f"cap must be from 1 to {MOST_MEMBERS}")
    q = cut(scope_root(state, asked.select("scope_id", "node").distinct()).select("scope_id", "node", "root"))
    found = _down(state, q, cap).groupBy("scope_id", "root").agg(F.array_sort(F.collect_list("member")).alias("all"))
    lists = found.select(F.col("scope_id").alias("_s"), F.col("root").alias("_r"), F.slice("all", 1, cap).alias("members"), (F.size("all") > cap).alias("truncated"))
    g = q.join(lists, (F.col("scope_id") == F.col("_s")) & (F.col("root") == F.col("_r")))
    return g.select("scope_id", "node", "root", "members", F.size("members").alias("count"), "truncated")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def advance(state: State, edges: DataFrame) -> Delta:
    """What a batch of edges changes; its size follows the batch, not the state.

    The shared layer moves first. A shared root that was absorbed may be an overlay key: in every scope registered on it, its survivor is united
    with it, and registered."""
    g = edges.where("scope_id = 0").select("src", "dst").distinct()
    g = shared_roots(shared_roots(g, "src", state.shared_layers, "u"), "dst", state.shared_layers, "v")
    merged = components(g.select("u", "v"))
    own = cut(contract(edges, [*state.shared_layers, merged]))
    gone = small(merged.select(F.col("node").alias("u"), F.col("root").alias("v")))
    fix = cut(state.registry.join(gone, F.col("root") == F.col("u")).select("scope_id", "u", "v").distinct())
    ends = lambda df: overlay_roots(overlay_roots(df, "u", state.overlay_layers, "a"), "v", state.overlay_layers, "b")
    fix = ends(fix)
    moved = ends(own).unionByName(fix).select("scope_id", F.col("a").alias("u"), F.col("b").alias("v"))
    overlay = components(moved, ("scope_id",)).select("scope_id", "node", "root")
    seen = cut(registered(own).unionByName(fix.select(F.col("v").alias("root"), "scope_id")).distinct())
    return Delta(merged, overlay, seen, fix.where("a <> b").select("scope_id", "u", "v"))
