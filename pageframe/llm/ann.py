"""Nearest neighbours by collision counting over single projections.

Every vector is projected on `projections` random lines. An index block holds, for
each line, its vectors sorted by their projection. A query opens a window around its
own projection on every line and widens all windows together, radius by radius
(virtual rehashing: no new index for a wider radius, only the newly covered flanks
of the sorted arrays are counted). A vector that collides on at least `share` of the
lines is verified by its exact distance. A query is done when the radius is `slack`
times its k-th verified distance, or every vector is verified.

Vectors are dealt to blocks of at most about `block` rows by hash, queries to blocks of
`query_block`; each pair of blocks is one group, so a task holds two bounded blocks.
Every block returns its k best and the best of all are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.store import written

SEED = 20_240_601


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, projections: int, share: float, slack: float = 1.45) -> Iterator[tuple]:
    """(query, candidate, distance) of the k nearest found in one block for each query; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    lines = np.random.default_rng(SEED).normal(size=(rows.shape[1], projections))
    placed, centres = rows @ lines, queries @ lines
    index = np.argsort(placed, axis=0, kind="stable")
    values = np.take_along_axis(placed, index, axis=0)
    threshold = max(1, int(np.ceil(share * projections)))
    norms = np.sqrt((rows**2).sum(axis=1))
    base = max(float(np.median(norms)) * 0.1, 1e-9)
    for qid, query, centre in zip(query_ids, queries, centres):
        others = int((ids != qid).sum())
        want = min(k, others)
        if not want:
            continue
        hits = np.zeros(len(ids), np.int32)
        low = np.array([np.searchsorted(values[:, i], centre[i]) for i in range(projections)])
        high = low.copy()
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        verified = np.zeros(len(ids), bool)
        verified[ids == qid] = True
        radius = base
        while True:
            flanks = []
            for i in range(projections):
                wider_low = np.searchsorted(values[:, i], centre[i] - radius)
                wider_high = np.searchsorted(values[:, i], centre[i] + radius, side="right")
                if wider_low < low[i]:
                    flanks.append(index[wider_low : low[i], i])
                    low[i] = wider_low
                if wider_high > high[i]:
                    flanks.append(index[high[i] : wider_high, i])
                    high[i] = wider_high
            if flanks:
                hits += np.bincount(np.concatenate(flanks), minlength=len(ids)).astype(np.int32)
            fresh = np.flatnonzero((hits >= threshold) & ~verified)
            if len(fresh):
                verified[fresh] = True
                distance = np.sqrt(((rows[fresh] - query) ** 2).sum(axis=1))
                best_ids, best = np.concatenate([best_ids, ids[fresh]]), np.concatenate([best, distance])
                keep = np.lexsort((best_ids, best))[:want]
                best_ids, best = best_ids[keep], best[keep]
            if (len(best) == want and slack * best[-1] <= radius) or verified.all():
                break
            radius *= 1.3
        for c, d in zip(best_ids.tolist(), best.tolist()):
            yield int(qid), c, d


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v, dim): vectors in double precision; null, zero and not finite ones are left out, and rows without id."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda x: x != 0.0)).withColumn("dim", F.size("v"))


def nearest(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    column: str = "embedding",
    projections: int = 48,
    share: float = 0.75,
    block: int = 8192,
    query_block: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`, by Euclidean distance.

    Candidates are all rows but those with the query's id; ties go to the smaller vec_id. Null, zero and non-finite
    vectors take no part, nor do rows without vec_id. Vectors meet those of their own length only. Rows that repeat an
    id and vector count once. Other columns are ignored; an empty table gives no row.
    """
    rows = written(usable(vectors, column).dropDuplicates(["vec_id", "v"]), "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("long")), F.lit(0))).first()
    n_blocks, n_queries = -(-total // block) or 1, -(-asked // query_block) or 1
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("dim", deal(n_blocks).alias("db"), each(n_queries).alias("qb"), F.lit(0).alias("asks"), "vec_id", "v")
    asks = rows.where(F.col("vec_id") % every == 0).select("dim", each(n_blocks).alias("db"), deal(n_queries).alias("qb"), F.lit(1).alias("asks"), "vec_id", "v")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        mine, query = group[group.asks == 0], group[group.asks == 1]
        if len(mine) and len(query):
            found = list(
                search_block(mine.vec_id.to_numpy(), np.vstack(mine.v.to_list()), query.vec_id.to_numpy(), np.vstack(query.v.to_list()), k, projections, share)
            )
        else:
            found = []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = data.unionByName(asks).groupBy("dim", "db", "qb").applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
