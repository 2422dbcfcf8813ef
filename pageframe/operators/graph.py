"""Trees and object graphs: reachability, climbing, inherited values, cycles.

Object numbers repeat in every file, so nodes are named by `within` (the file) and
their id. Functions on trees take ("source_key",) for it unless told otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.session import cut_lineage, parquet_copy

FILE = ("source_key",)
#: Rounds after which a climb looks for cycles, as by then paths of 2^7 links are done, and a search for stretches.
TRUSTED_ROUNDS = 7


def reachable(edges: DataFrame, roots: DataFrame, node: str = "node", within: Sequence[str] = ()) -> DataFrame:
    """Nodes reachable from the roots over edges (*within, src, dst); cycles are fine.

    A round expands only what was found last, which is written out, and reads the edges once. What is still open after
    `TRUSTED_ROUNDS` rounds goes on over stretches without branches, so a long path takes few rounds and a flat graph
    pays for no stretch. Repeated edges count once; edges with a null end are left out.
    """
    links = edges.select(*within, "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    begin = parquet_copy(roots.select(*within, node).where(F.col(node).isNotNull()).distinct(), "roots")
    found, frontier = _search(links, begin, node, within, TRUSTED_ROUNDS)
    if frontier is None:
        return found
    found = cut_lineage(found)
    onward = links.distinct().join(found.select(*within, F.col(node).alias("dst")), [*within, "dst"], "left_anti")
    return found.unionByName(_over_stretches(cut_lineage(onward), frontier, node, within).join(frontier, [*within, node], "left_anti"))


def _over_stretches(links: DataFrame, begin: DataFrame, node: str, within: Sequence[str]) -> DataFrame:
    """`reachable` for distinct links and roots.

    Stretches without branches are passed in one round: a node with one way in, from a node with one way out, is reached
    exactly when that one is, so such stretches are named by their first node (paths double, log2 of their length rounds)
    and the search goes over these names. A root begins a stretch.
    """
    only = lambda side, other: links.groupBy(*within, side).agg(F.count(F.lit(1)).alias("n"), F.first(other).alias(other)).where("n = 1").drop("n")
    straight = only("src", "dst").join(only("dst", "src"), [*within, "src", "dst"]).where("src <> dst")
    inner = straight.join(begin.select(*within, F.col(node).alias("dst")), [*within, "dst"], "left_anti")
    heads = _stretches(cut_lineage(inner), within)
    named = lambda df, column, name: df.join(
        heads.select(*within, F.col("node").alias(column), F.col("head").alias("_head")), [*within, column], "left").withColumn(name, F.coalesce("_head", column)).drop("_head")
    jumps = named(named(links, "src", "_from"), "dst", "_to").where("_from <> _to").select(*within, F.col("_from").alias("src"), F.col("_to").alias("dst"))
    found, _ = _search(cut_lineage(jumps.distinct()), begin, node, within)
    members = heads.join(found.select(*within, F.col(node).alias("head")), [*within, "head"], "left_semi").select(*within, F.col("node").alias(node))
    return found.unionByName(members)


def _stretches(links: DataFrame, within: Sequence[str]) -> DataFrame:
    """(*within, node, head) of nodes that are not first in their stretch; `links` has one way in and one way out of a node.

    A ring without entrance is never reached from outside and gets no row.
    """
    state = links.select(*within, F.col("dst").alias("node"), F.col("src").alias("up"))
    total, rounds = state.count(), 0
    while (1 << rounds) < 2 * total:
        above = state.select(*within, F.col("node").alias("up"), F.col("up").alias("_next"))
        met = cut_lineage(state.join(above, [*within, "up"], "left").select(*within, "node", F.coalesce("_next", "up").alias("up"), "_next"))
        state = met.drop("_next")
        if met.where("_next IS NOT NULL").isEmpty():
            break
        rounds += 1
    ringed = state.select(*within, F.col("node").alias("up"))
    return state.join(ringed, [*within, "up"], "left_anti").select(*within, "node", F.col("up").alias("head"))


def _search(edges: DataFrame, roots: DataFrame, node: str, within: Sequence[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Nodes found in at most `most` rounds, and those found last if there may be more."""
    keys = [*within, node]
    frontier, found, rounds = roots, [roots], 0
    while rounds != most:
        step = edges.join(frontier.select(*within, F.col(node).alias("src")), [*within, "src"], "left_semi").select(*within, F.col("dst").alias(node)).distinct()
        for known in found:
            step = step.join(known, keys, "left_anti")
        frontier = parquet_copy(step, "frontier")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found), None
        found.append(frontier)
        if len(found) > 8:
            found = [cut_lineage(reduce(DataFrame.unionByName, found))]
        rounds += 1
    return reduce(DataFrame.unionByName, found), frontier


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, node: str = "node", within: Sequence[str] = ()) -> DataFrame:
    return nodes.join(reachable(edges, roots, node, within), [*within, node], "left_anti")


def cycles(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", within: Sequence[str] = FILE) -> DataFrame:
    """(*within, node, cycle) of the nodes on a cycle of parent links, which is named by its smallest node.

    Paths double until they are longer than there are nodes; those that still have not ended stand on a cycle, and the
    least node they met is its name. Nodes that reach a root leave in the round that shows it.
    """
    state = cut_lineage(nodes.where(F.col(parent).isNotNull()).select(*within, F.col(node).alias("_node"), F.col(parent).alias("_up"), F.col(node).alias("_low")))
    rounds, total = 0, state.count()
    while total and (1 << rounds) <= total:
        above = state.select(*within, F.col("_node").alias("_up"), F.col("_up").alias("_next"), F.col("_low").alias("_least"))
        met = state.join(above, [*within, "_up"]).select(*within, "_node", F.col("_next").alias("_up"), F.least("_low", "_least").alias("_low"))
        state = cut_lineage(met)
        if state.isEmpty():
            break
        rounds += 1
    ends = state.select(*within, F.col("_up").alias("_node")).distinct()
    return state.join(ends, [*within, "_node"], "left_semi").select(*within, F.col("_node").alias(node), F.col("_low").alias("cycle"))


def climb(
    nodes: DataFrame, carried: Mapping[str, tuple[Column, Callable[[Column, Column], Column]]], node: str = "node_id",
    parent: str = "parent_id", within: Sequence[str] = FILE, _rounds: int | None = TRUSTED_ROUNDS,
) -> DataFrame:
    """Combine values along the path from each node to its root.

    `carried` maps a name to its value at the node and a rule (own, above). Paths double in every round, so a tree of
    depth d takes log2(d) joins on a unique key. Finished nodes leave the join. A node whose parent is missing is a root,
    and so is the smallest node of a cycle: its parent link is cut.
    """
    names, keys = list(carried), [*within, node]
    state = cut_lineage(nodes.select(*keys, F.col(parent).alias("_up"), *[carried[n][0].alias(n) for n in names]))
    finished = [state.where(F.col("_up").isNull()).select(*keys, *names)]
    active, rounds = state.where(F.col("_up").isNotNull()), 0
    while not active.isEmpty():
        if rounds == _rounds:
            rings = cut_lineage(cycles(nodes.join(active.select(*keys), keys, "left_semi"), node, parent, within))
            if not rings.isEmpty():
                first = rings.where(F.col(node) == F.col("cycle")).select(*keys, F.lit(True).alias("_first"))
                cut = nodes.join(first, keys, "left").withColumn(parent, F.when(F.col("_first").isNull(), F.col(parent))).drop("_first")
                return climb(cut, carried, node, parent, within, None)
        above = state.select(*within, F.col(node).alias("_up"), F.col("_up").alias("_next"), F.lit(True).alias("_hit"), *[F.col(n).alias(f"_a_{n}") for n in names])
        met = active.join(above, [*within, "_up"], "left")
        moved = cut_lineage(met.select(
            *keys, F.col("_next").alias("_up"),
            *[F.when(F.col("_hit").isNull(), F.col(n)).otherwise(carried[n][1](F.col(n), F.col(f"_a_{n}"))).alias(n) for n in names]))
        finished.append(moved.where(F.col("_up").isNull()).select(*keys, *names))
        active = moved.where(F.col("_up").isNotNull())
        state = state.where(F.col("_up").isNull()).unionByName(moved)
        rounds += 1
    return reduce(DataFrame.unionByName, finished)


def inherit(nodes: DataFrame, keys: list[str], node: str = "node_id", parent: str = "parent_id", within: Sequence[str] = FILE) -> DataFrame:
    """Nearest value of each key on the way up, self first, and the node that owns it."""
    carried = {}
    for key in keys:
        carried[key] = (F.col(key), lambda own, above: F.coalesce(own, above))
        carried[f"{key}_owner"] = (F.when(F.col(key).isNotNull(), F.col(node)), lambda own, above: F.coalesce(own, above))
    return climb(nodes, carried, node, parent, within)


def qualified_name(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", name: str = "name", within: Sequence[str] = FILE) -> DataFrame:
    """Partial names that are not empty, joined by dots from the root down."""
    own = F.when(F.col(name) != "", F.col(name))
    names = climb(nodes, {"full_name": (own, lambda own, above: F.nullif(F.concat_ws(".", above, own), F.lit("")))}, node, parent, within)
    return names.withColumn("full_name", F.coalesce("full_name", F.lit("")))


def top_ancestor(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", within: Sequence[str] = FILE) -> DataFrame:
    return climb(nodes, {"top": (F.col(node), lambda own, above: above)}, node, parent, within)


def terminal_fields(nodes: DataFrame, within: Sequence[str] = FILE) -> DataFrame:
    """Fields without sub-fields. A child is a sub-field when it or a descendant has a name."""
    keys = [*within, "node_id"]
    upward = cut_lineage(nodes.where(F.col("parent_id").isNotNull()).select(*within, F.col("node_id").alias("src"), F.col("parent_id").alias("dst")))
    found = reachable(upward, nodes.where(F.col("name").isNotNull()).select(*within, F.col("node_id").alias("node")), "node", within)
    fields = cut_lineage(found.select(*within, F.col("node").alias("node_id")))
    parents = nodes.join(fields, keys, "left_semi").select(*within, F.col("parent_id").alias("node_id")).where(F.col("node_id").isNotNull()).distinct()
    candidates = nodes.join(fields.withColumn("_field", F.lit(True)), keys, "left")
    candidates = candidates.where(F.col("_field") | F.col("parent_id").isNull()).drop("_field")
    named = qualified_name(nodes, within=within).where(F.col("full_name") != "")
    return candidates.join(parents, keys, "left_anti").join(named, keys)


SCRUBBED = ("v", "dv", "rv", "aa", "a", "ap", "as")


def scrub_tree(nodes: DataFrame, roots: DataFrame, within: Sequence[str] = FILE) -> DataFrame:
    """Null every value and action of the given nodes and all nodes below them."""
    keys = [*within, "node_id"]
    marked = nodes.join(roots.select(*keys).distinct().withColumn("_root", F.lit(True)), keys, "left")
    marked = marked.withColumn("_root", F.coalesce("_root", F.lit(False)))
    inside = climb(marked, {"scrubbed": (F.col("_root"), lambda own, above: own | above)}, within=within)
    joined = nodes.join(inside, keys)
    cleared = {c: F.when(~F.col("scrubbed"), F.col(c)) for c in nodes.columns if c in SCRUBBED}
    return joined.withColumns(cleared) if cleared else joined
