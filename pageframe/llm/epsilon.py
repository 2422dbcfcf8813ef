"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors at cosine t are sqrt(2 - 2t) apart. Each vector is projected on leading
principal dimensions, which never lengthens a distance, and the projections fall into
grid cells of that width. Vectors of a label are sorted by cell (epsilon grid order) and
cut into intervals of `block` rows; `fan` intervals make one of the next level. Starting
from each label's whole sequence joined with itself, pairs of intervals are replaced by
pairs of their parts level by level, and a pair whose boxes are further apart than the
width is skipped, since no vector of one can be near one of the other. The pairs of
lowest intervals that remain are tiles; a tile goes on recursively down to `LEAF` rows
and compares those by exact cosine.

The principal dimensions are fitted on a bounded sample; they only decide how much is
skipped. Equal vectors are one row with a count. A tile returns, for each of its rows, the
number of vectors linked, and a spanning forest of its links instead of all of them, so
what it returns grows with its rows and a crowd of near copies stays linear in size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.components import connected_components, forest
from pageframe.llm.ranks import numbered
from pageframe.llm.store import over_batches, written

LEAF = 128
#: Rounding that a box distance may have.
SLACK = 1e-9


def usable() -> Column:
    """Whether a row (vec_id, v, label) takes part: it has an id and a label, and its vector is finite and not zero."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    full = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return F.coalesce(full & ~bad & F.exists("v", lambda x: x != 0.0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, sample: int, dimensions: int) -> dict[int, np.ndarray]:
    """Leading axes of the spread inside labels for each vector length among the `sample` rows with the smallest hash."""
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "label", "v").collect()
    axes = {}
    for dim in {r["dim"] for r in drawn}:
        own = [r for r in drawn if r["dim"] == dim]
        rows = _unit(np.array([r["v"] for r in own]))
        labels = np.unique([r["label"] for r in own], return_inverse=True)[1]
        means = np.stack([rows[labels == i].mean(axis=0) for i in range(labels.max() + 1)])
        spread = rows - means[labels]
        axes[dim] = np.linalg.eigh(spread.T @ spread)[1][:, ::-1][:, :dimensions]
    return axes


def _placed(vectors: DataFrame, axes: dict[int, np.ndarray], dimensions: int) -> DataFrame:
    """(vec_id, g, digest, u, c0...): group by label and length, 128 bits of the vector, unit vector, projection.

    A length that the sample did not hold is projected on its first coordinates. Missing dimensions are zero.
    """

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("v")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        dims = np.diff(offsets)
        unit, c = np.empty(len(flat)), np.zeros((len(dims), dimensions))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            where = offsets[at][:, None] + np.arange(dim)
            rows = _unit(flat[where])
            unit[where] = rows
            lead = axes.get(int(dim), np.eye(dim)[:, :dimensions])
            c[at, : lead.shape[1]] = rows @ lead
        digests = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        columns = [batch.column("vec_id"), batch.column("g"), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(lists.offsets, pa.array(unit))]
        names = ["vec_id", "g", "digest", "u", *[f"c{i}" for i in range(dimensions)]]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(c[:, i]) for i in range(dimensions)]], names)

    named = vectors.select("vec_id", F.concat_ws(":", F.col("label").cast("string"), F.col("dim").cast("string")).alias("g"), "v")
    return over_batches(named, place, "vec_id long, g string, digest binary, u array<double>, " + ", ".join(f"c{i} double" for i in range(dimensions)))


def _apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    return float((gap**2).sum())


def join_intervals(u: np.ndarray, c: np.ndarray, left: tuple[int, int], right: tuple[int, int], least: float, width: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows in two intervals of one sequence with cosine `least` or more, in pieces."""
    boxes = [(c[a:b].min(axis=0), c[a:b].max(axis=0)) for a, b in (left, right)]
    if left != right and _apart(*boxes[0], *boxes[1]) > width**2:
        return
    if max(left[1] - left[0], right[1] - right[0]) <= LEAF:
        i, j = np.nonzero(u[left[0] : left[1]] @ u[right[0] : right[1]].T >= least)
        i, j = i + left[0], j + right[0]
        yield i[i < j], j[i < j]
        return
    cut = lambda x: [x] if x[1] - x[0] <= LEAF else [(x[0], (x[0] + x[1]) // 2), ((x[0] + x[1]) // 2, x[1])]
    for x in cut(left):
        for y in cut(right):
            if x[0] <= y[0]:
                yield from join_intervals(u, c, x, y, least, width)


def _boxes(rows: DataFrame, keys: list[str], dimensions: int) -> DataFrame:
    both = [f(f"{n}{i}").alias(f"{o}{i}") for i in range(dimensions) for f, n, o in ((F.min, "lo", "lo"), (F.max, "hi", "hi"))]
    return rows.groupBy(*keys).agg(*both)


def interval_pairs(members: DataFrame, blocks: int, fan: int, width: float, dimensions: int) -> DataFrame:
    """(g, a, b): pairs a <= b of intervals that are not provably further apart than `width`; `members` has g, block, c0..."""
    ends = [F.col(f"c{i}").alias(f"{e}{i}") for i in range(dimensions) for e in ("lo", "hi")]
    levels = [written(_boxes(members.select("g", F.col("block").alias("id"), *ends), ["g", "id"], dimensions), "intervals")]
    while blocks > 1:
        parts = levels[-1].withColumn("id", F.floor(F.col("id") / fan).cast("long"))
        levels.append(written(_boxes(parts, ["g", "id"], dimensions), "intervals"))
        blocks = -(-blocks // fan)
    pairs = levels[-1].select("g", F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda s: level.select("g", F.floor(F.col("id") / fan).cast("long").alias(s), F.col("id").alias(f"_{s}"), *[F.col(f"{e}{i}").alias(f"{s}{e}{i}") for i in range(dimensions) for e in ("lo", "hi")])
        met = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).where("_a <= _b")
        gaps = [F.greatest(F.lit(0.0), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.col(f"blo{i}") - F.col(f"ahi{i}")) for i in range(dimensions)]
        near = met.where(reduce(lambda x, y: x + y, [g * g for g in gaps]) <= width**2)
        pairs = written(near.select("g", F.col("_a").alias("a"), F.col("_b").alias("b")), "pairs")
    return pairs


def near_embeddings(
    vectors: DataFrame, least: float = 0.93, column: str = "embedding", label: str = "label", block: int = 1024, fan: int = 8, dimensions: int = 6, sample: int = 4096
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`, by exact cosine of `least` or more inside a label.

    Vectors of one label and length are compared; those that are null, zero or hold null or non-finite components link with
    nothing, nor do rows without label or vec_id. Such a row is a component of its own and is kept; a row without vec_id has a
    null component. Equal vectors of a label link with one another; rows that repeat an id and a vector count each. Rows that
    share an id are one node where that id stands for their vector, the smallest of those equal to it. `n_links` counts rows.
    Other columns are ignored; an empty table gives no row.
    """
    if not 0 < least < 1 - 1e-12:
        raise ValueError("least must lie between 0 and 1")
    width = float(np.sqrt(2 - 2 * least)) + SLACK
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col(column), lambda x: x.cast("double")).alias("v"), F.col(label).cast("string").alias("label"))
    fit = given.where(usable()).withColumn("dim", F.size("v"))
    axes = principal_axes(fit, sample, dimensions)
    placed = written(_placed(fit, axes, dimensions), "vectors")
    first = [F.first(x).alias(x) for x in ("u", *[f"c{i}" for i in range(dimensions)])]
    classes = placed.groupBy("g", "digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), *first)
    cells = [F.floor(F.col(f"c{i}") / width).cast("long").alias(f"cell{i}") for i in range(dimensions)]
    order = [f"cell{i}" for i in range(dimensions)]
    ranked = numbered(classes.select("*", *cells), "g", [*order, "digest"]).drop(*order)
    members = written(ranked.withColumn("block", F.floor(F.col("idx") / block).cast("long")), "members")
    most = members.agg(F.max("n")).first()[0] or 0
    pairs = interval_pairs(members, -(-most // block), fan, width, dimensions)
    sides = pairs.select("g", F.col("a").alias("block"), "a", "b").unionByName(pairs.where("a < b").select("g", F.col("b").alias("block"), "a", "b"))
    coordinates = [f"c{i}" for i in range(dimensions)]
    tiles = members.select("g", "block", "idx", "node", "copies", "u", *coordinates).join(sides, ["g", "block"])

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("idx").combine_chunks()
        idx, node, copies = (tile[x].to_numpy() for x in ("idx", "node", "copies"))
        u = tile["u"].combine_chunks().flatten().to_numpy().reshape(len(idx), -1)
        c = np.stack([tile[x].to_numpy() for x in coordinates], axis=1)
        a, b = tile["a"][0].as_py(), tile["b"][0].as_py()
        split = int(np.searchsorted(idx, b * block)) if a < b else 0
        left, right = ((0, split), (split, len(idx))) if a < b else ((0, len(idx)), (0, len(idx)))
        counts, found, held = np.zeros(len(idx), np.int64), [], 0
        for i, j in join_intervals(u, c, left, right, least, width):
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            found.append((node[i], node[j]))
            held += len(i)
            if held > 1 << 18:
                found = [forest(*map(np.concatenate, zip(*found)))]
                held = 0
        ends = forest(*map(np.concatenate, zip(*found))) if sum(len(x[0]) for x in found) else (np.empty(0, np.int64), np.empty(0, np.int64))
        some, g, n = np.flatnonzero(counts), tile["g"][0].as_py(), len(ends[0])
        blank = lambda k: pa.nulls(k, pa.int64())
        join = lambda x, y: pa.chunked_array([x, y], pa.int64())
        columns = [pa.array([g] * (len(some) + n), pa.string()), join(pa.array(idx[some]), blank(n)), join(pa.array(counts[some]), blank(n))]
        return pa.table([*columns, join(blank(len(some)), pa.array(ends[0])), join(blank(len(some)), pa.array(ends[1]))], names=["g", "idx", "linked", "a", "b"])

    found = written(tiles.groupBy("g", "a", "b").applyInArrow(compare, "g string, idx long, linked long, a long, b long"), "links")
    counts = found.where("linked IS NOT NULL").groupBy("g", "idx").agg(F.sum("linked").alias("linked"))
    joined = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    judged = members.select("g", "digest", "idx", "node", "copies").join(counts, ["g", "idx"], "left").join(joined, "node", "left")
    links = (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    judged = judged.select("g", "digest", links, F.coalesce("component", "node").alias("component_id"))
    fine = placed.select("vec_id", "g", "digest").join(judged, ["g", "digest"]).select("vec_id", "n_links", "component_id")
    alone = given.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB twin: all pairs inside a label, components by closure.
SQL = """
WITH RECURSIVE rows AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
fine AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM rows WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT r.vec_id, coalesce(c.n, 0) AS n_links, least(r.vec_id, coalesce(l.b, r.vec_id)) AS component_id, r.vec_id = least(r.vec_id, coalesce(l.b, r.vec_id)) AS kept
FROM rows r LEFT JOIN counts c ON r.vec_id = c.a LEFT JOIN least l ON r.vec_id = l.a
"""
