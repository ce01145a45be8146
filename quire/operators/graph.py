"""Graphs and hierarchies: reachability, inheritance along chains, closures, composed mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.components import connected_components
from quire.plans.scratch import Scratch


def reachable(edges: DataFrame, roots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, node, depth) of all nodes that roots reach, with the least number of edges. Edges: (by, src, dst).

    A breadth-first search: each round joins the frontier with the edges and keeps what no earlier frontier
    has, so cycles end by themselves, and the driver learns only whether a frontier is empty. Frontiers are
    tables of their own; as soon as the last ones are as large as the one before them they become one, so a
    node is written again a logarithmic number of times, however many rounds there are."""
    by = by or []
    scratch = Scratch(edges.sparkSession, "reachable")
    hop = scratch.keep(edges.select(*by, F.col("src").alias("node"), F.col("dst")).distinct())
    front = scratch.keep(roots.select(*by, "node").distinct().withColumn("depth", F.lit(0)))
    levels = [(front, front.count())]
    depth = 0
    while levels[-1][1]:
        depth += 1
        new = front.join(hop, [*by, "node"]).select(*by, F.col("dst").alias("node")).distinct()
        for level, _ in levels:
            new = new.join(level, [*by, "node"], "left_anti")
        front = scratch.keep(new.withColumn("depth", F.lit(depth)))
        levels.append((front, front.count()))
        if not levels[-1][1]:
            break
        while len(levels) > 1 and levels[-1][1] >= levels[-2][1]:
            (a, n), (b, m) = levels[-2:]
            levels[-2:] = [(scratch.keep(a.unionByName(b)), n + m)]
    out = levels[0][0]
    for level, _ in levels[1:]:
        out = out.unionByName(level)
    return out


def ancestors(nodes: DataFrame, node: str, parent: str, by: list[str]) -> DataFrame:
    """(by, node, ancestor, depth): each node itself at depth 0, its parent at 1, and so on. A chain ends
    before a node that it has met, and before a parent that isn't a node. Chains have any length: in each
    round the ancestors up to a distance are joined to the one ancestor at just that distance, which doubles
    it, so a pair is made once."""
    scratch = Scratch(nodes.sparkSession, "ancestors")
    hops = _hops(nodes, node, parent, by, scratch)
    have = scratch.keep(hops.select(*by, "node", F.col("up").alias("ancestor"), F.lit(1).alias("depth")).where("node <> ancestor"))
    jump, reach, n = hops, 1, have.count()
    while n:
        at = jump.select(*by, F.col("node").alias("_n"), F.col("up").alias("node"))
        far = at.join(have, [*by, "node"]).select(*by, F.col("_n").alias("node"), "ancestor", (F.col("depth") + reach).alias("depth")).where("node <> ancestor")
        grown = scratch.keep(have.unionByName(far).groupBy(*by, "node", "ancestor").agg(F.min("depth").alias("depth")))
        more = grown.count()
        jump, reach = scratch.keep(_twice(jump, by)), 2 * reach
        have, n = grown, more if more > n else 0
    own = nodes.select(*by, F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(have)


def _hops(nodes: DataFrame, node: str, parent: str, by: list[str], scratch: Scratch) -> DataFrame:
    """(by, node, up) of the nodes whose parent is a node."""
    up = nodes.where(F.col(parent).isNotNull()).select(*by, F.col(node).alias("node"), F.col(parent).alias("up"))
    return scratch.keep(up.join(nodes.select(*by, F.col(node).alias("up")), [*by, "up"], "left_semi").select(*by, "node", "up"))


def _twice(jump: DataFrame, by: list[str]) -> DataFrame:
    on = jump.select(*by, F.col("node").alias("up"), F.col("up").alias("_up"))
    return jump.join(on, [*by, "up"]).select(*by, "node", F.col("_up").alias("up"))


def _nearest(nodes: DataFrame, node: str, parent: str, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, node, values): each value from the nearest node on the chain where it isn't null.

    Pointer doubling: what a node lacks it takes from the node it points to, and then points where that one
    points. A row a node and round; the rounds are the logarithm of the longest chain. In a cycle a pointer
    comes round, and ends when it can have met every node."""
    scratch = Scratch(nodes.sparkSession, "nearest")
    hops = _hops(nodes, node, parent, by, scratch)
    own = nodes.select(*by, F.col(node).alias("node"), *[v.alias(n) for n, v in values.items()])
    state = scratch.keep(own.join(hops, [*by, "node"], "left"))
    longest = state.groupBy(*by).count().agg(F.max("count")).first()[0] if by else state.count()
    met = 1
    lacking = F.array_contains(F.array(*[F.col(n).isNull() for n in values]), True)
    while met < (longest or 0) and not state.where(F.col("up").isNotNull() & lacking).isEmpty():
        there = state.select(*by, F.col("node").alias("up"), F.col("up").alias("_up"), *[F.col(n).alias(f"_{i}") for i, n in enumerate(values)])
        state = scratch.keep(state.join(there, [*by, "up"], "left").select(*by, "node", F.col("_up").alias("up"), *[F.coalesce(n, f"_{i}").alias(n) for i, n in enumerate(values)]))
        met *= 2
    return state.drop("up")


def inherited(nodes: DataFrame, node: str, parent: str, by: list[str], values: list[str]) -> DataFrame:
    """(by, node, values): each value from the nearest node on the chain that declares it; null if none does."""
    return _nearest(nodes, node, parent, by, {v: F.col(v) for v in values})


def effective_or_unresolved(nodes: DataFrame, node: str, parent: str, by: list[str], value: str, unresolved: str) -> DataFrame:
    """(by, node, value): as ``inherited``, but a nearer declaration that is unresolved leaves null."""
    bad = F.coalesce(F.col(unresolved), F.lit(False))
    declared = F.when(F.col(value).isNotNull() | bad, F.struct(F.col(value).alias("v"), bad.alias("bad")))
    out = _nearest(nodes, node, parent, by, {"_f": declared})
    return out.select(*by, "node", F.when(~F.coalesce(F.col("_f.bad"), F.lit(False)), F.col("_f.v")).alias(value))


def cyclic_nodes(nodes: DataFrame, node: str, parent: str, by: list[str]) -> DataFrame:
    """(by, node) of nodes whose chain of parents never ends: what no root reaches downwards."""
    known = nodes.select(*by, F.col(node).alias(parent))
    roots = nodes.join(known, [*by, parent], "left_anti").select(*by, F.col(node).alias("node"))
    down = nodes.where(F.col(parent).isNotNull()).select(*by, F.col(parent).alias("src"), F.col(node).alias("dst"))
    return nodes.select(*by, F.col(node).alias("node")).join(reachable(down, roots, by), [*by, "node"], "left_anti")


def package_closure(parts: DataFrame, relations: DataFrame, types: list[str], recursive: list[str]) -> DataFrame:
    """(pkg_id, node, depth): parts that the root's internal relationships of ``types`` name, and on from
    there along those of ``recursive`` types."""
    inner = relations.where("mode = 'Internal'")
    seeds = inner.where((F.col("owner") == "/") & F.col("type").isin(types)).select("pkg_id", F.col("target").alias("node"))
    edges = inner.where((F.col("owner") != "/") & F.col("type").isin(recursive)).select("pkg_id", F.col("owner").alias("src"), F.col("target").alias("dst"))
    return reachable(edges, seeds, ["pkg_id"]).join(parts.select("pkg_id", F.col("name").alias("node")), ["pkg_id", "node"], "left_semi")


def audit_package(parts: DataFrame, relations: DataFrame) -> DataFrame:
    """(pkg_id, code, subject) findings over package tables: repeated and badly named parts, parts without a
    content type, repeated relationship ids, relationships without an owner or target, external targets that
    are parts, and, only in packages without any other finding, unreachable parts (else ``unreached``)."""
    from quire.functions.text import is_part_name

    named = parts.select("pkg_id", "name", "content_type")
    tell = lambda df, code, subject: df.select("pkg_id", F.lit(code).alias("code"), subject.alias("subject"))
    inner = relations.where("mode = 'Internal'")
    owners = named.select("pkg_id", F.col("name").alias("owner"))
    targets = named.select("pkg_id", F.col("name").alias("target"))
    lower = named.groupBy("pkg_id", F.lower("name").alias("name")).count()
    found = [
        tell(lower.where("count > 1"), "duplicate-part", F.col("name")),
        tell(named.where(~is_part_name(F.col("name"))), "bad-part-name", F.col("name")),
        tell(named.where(F.coalesce("content_type", F.lit("")) == ""), "missing-content-type", F.col("name")),
        tell(relations.groupBy("pkg_id", "owner", "id").count().where("count > 1"), "duplicate-relationship", F.concat_ws("#", "owner", "id")),
        tell(relations.where("owner <> '/'").join(owners, ["pkg_id", "owner"], "left_anti"), "missing-owner", F.concat_ws("#", "owner", "id")),
        tell(inner.join(targets, ["pkg_id", "target"], "left_anti"), "missing-target", F.concat_ws("#", "owner", "id")),
        tell(relations.where("mode = 'External'").join(targets, ["pkg_id", "target"], "left_semi"), "external-part", F.concat_ws("#", "owner", "id")),
        tell(relations.where(~F.coalesce("mode", F.lit("")).isin("Internal", "External")), "bad-target-mode", F.concat_ws("#", "owner", "id")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    roots = named.select("pkg_id").distinct().withColumn("node", F.lit("/"))
    met = reachable(inner.select("pkg_id", F.col("owner").alias("src"), F.col("target").alias("dst")), roots, ["pkg_id"])
    lost = named.join(met.select("pkg_id", F.col("node").alias("name")), ["pkg_id", "name"], "left_anti")
    dirty = out.select("pkg_id").distinct().withColumn("_d", F.lit(True))
    lost = lost.join(dirty, "pkg_id", "left").select("pkg_id", F.when(F.col("_d").isNull(), "unreachable").otherwise("unreached").alias("code"), F.col("name").alias("subject"))
    return out.unionByName(lost)


def orphan_parts(parts: DataFrame, loaded: DataFrame, relations: DataFrame) -> DataFrame:
    """(pkg_id, name) of parts that weren't loaded, with all parts these lead to."""
    left = parts.select("pkg_id", "name").exceptAll(loaded.select("pkg_id", "name"))
    edges = relations.where("mode = 'Internal'").select("pkg_id", F.col("owner").alias("src"), F.col("target").alias("dst"))
    closed = reachable(edges, left.select("pkg_id", F.col("name").alias("node")), ["pkg_id"])
    return closed.join(parts.select("pkg_id", F.col("name").alias("node")), ["pkg_id", "node"], "left_semi").select("pkg_id", F.col("node").alias("name"))


#: States of preservation from the worst to the best.
STATES = ("REJECTED", "LOST", "OPAQUE", "VISUAL", "SEMANTIC")


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state)


def compose_mappings(first: DataFrame, second: DataFrame) -> DataFrame:
    """(group_id, sources, targets, state): two stages of (source, target, state) edges composed over their
    shared middle; groups are connected, and a group's state is the worst of its edges'. Node ids are longs
    and differ between the three layers."""
    edges = first.select(F.col("source").alias("a"), F.col("target").alias("b"), "state").unionByName(second.select(F.col("source").alias("a"), F.col("target").alias("b"), "state"))
    groups = connected_components(edges.sparkSession, edges)
    of = groups.select(F.col("node").alias("a"), F.col("component").alias("group_id"))
    worst = edges.join(of, "a").groupBy("group_id").agg(F.min(state_rank(F.col("state"))).alias("_s"))
    side = lambda df, c, name: df.select(F.col(c).alias("a")).distinct().join(of, "a").groupBy("group_id").agg(F.array_sort(F.collect_list("a")).alias(name))
    out = worst.join(side(first, "source", "sources"), "group_id", "left").join(side(second, "target", "targets"), "group_id", "left")
    none = F.array().cast("array<bigint>")
    state = F.element_at(F.array(*map(F.lit, STATES)), F.col("_s").cast("int"))
    return out.select("group_id", F.coalesce("sources", none).alias("sources"), F.coalesce("targets", none).alias("targets"), state.alias("state"))


def layers(*scans: tuple[str, DataFrame]) -> DataFrame:
    """Rows of several scans with their layer's number and name, the first lowest."""
    out = None
    for i, (name, df) in enumerate(scans):
        own = df.withColumns({"layer": F.lit(i), "layer_name": F.lit(name)})
        out = own if out is None else out.unionByName(own)
    return out
