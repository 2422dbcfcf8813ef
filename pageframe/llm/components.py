"""Connected components of a large link table by alternating stars.

Each round points every node at the smallest neighbour it knows, first over
larger neighbours, then over smaller ones; the links become a forest of stars
whose centres are the smallest nodes. A round is two grouped minima (combined
before the shuffle) and two equi-joins, and its links are written out, so a lost
executor costs one round at most. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm.store import written

LINK = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node that is not its own centre."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    left, right = index[: len(a)], index[len(a) :]
    while True:
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, parent[left], low)
        np.minimum.at(parent, parent[right], low)
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        if np.array_equal(parent, before):
            break
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a partition by the stars of their components; at most 2^20 links are held."""
    a, b = [], []

    def out() -> pa.RecordBatch:
        node, centre = forest(np.concatenate(a), np.concatenate(b))
        a[:], b[:] = [node], [centre]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(centre)], ["a", "b"])

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > 1 << 20:
            star = out()
            if star.num_rows > 1 << 19:
                yield star
                a.clear(), b.clear()
    if a:
        yield out()


def connected_components(links: DataFrame, contracted: bool = False) -> DataFrame:
    """(node, component) for every node that a link (a, b) ties to a smaller one; `component` is the smallest node.

    Links may repeat, point either way or at themselves; nulls are left out. Nodes
    that are their own centre have no row. An empty table gives an empty table.
    `contracted` says that `contract` has been over the partitions of the links: a second
    Python step in a stage would keep a second worker alive for each core.
    """
    spread = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    current = written((spread if contracted else spread.mapInArrow(contract, LINK)).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.where("a <> b").distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(smaller.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = mark(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
