"""Ordered scans that never put one key into one task.

A plain window over a hot key sorts the whole key in a single task. Here each
key is cut into blocks of the order column; a window runs inside the blocks,
one summary row per block carries the state across block borders, and an
equi-join hands the carry back. The summary is smaller than the input by the
block width, and the join reuses the partitioning of the inner window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
BLOCK_COLUMN = "_block"


def _block_column(order: str, block: int | Column) -> Column:
    if isinstance(block, Column):
        return block
    return F.floor(F.col(order) / block)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    block: int | Column = BLOCK,
    backwards: bool = False,
) -> DataFrame:
    """Add the value of the row before (or after, when backwards) in key and order.

    `columns` maps new names to existing columns; `order` is unique inside a key.
    `block` is a width on an integer order or any Column that never falls along the order.
    """
    based = df.withColumn(BLOCK_COLUMN, _block_column(order, block))
    ends = [*keys, BLOCK_COLUMN]
    direction = F.col(order).desc() if backwards else F.col(order)
    inner = Window.partitionBy(*ends).orderBy(direction)
    value = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    edge = F.min_by if backwards else F.max_by
    edges = based.groupBy(*ends).agg(edge(value, F.col(order)).alias("_edge"))
    outer_order = F.col(BLOCK_COLUMN).desc() if backwards else F.col(BLOCK_COLUMN)
    carries = edges.select(
        *ends, F.lag("_edge").over(Window.partitionBy(*keys).orderBy(outer_order)).alias("_carry")
    ).where(F.col("_carry").isNotNull())
    joined = based.withColumn("_near", F.lag(value).over(inner)).join(carries, ends, "left")
    found = F.coalesce(F.col("_near"), F.col("_carry"))
    return joined.select(*df.columns, *[found[new].alias(new) for new in columns])


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggregates: Mapping[str, tuple[str, Column]],
    block: int | Column = BLOCK,
    exclusive: bool = False,
) -> DataFrame:
    """Add running values along the order: sum, max, min, or the last value that is not null.

    `aggregates` maps new names to (kind, column). Exclusive leaves out the current row.
    """
    names = list(aggregates)
    based = df.withColumn(BLOCK_COLUMN, _block_column(order, block))
    for name, (_, column) in aggregates.items():
        based = based.withColumn(f"_in_{name}", column)
    ends = [*keys, BLOCK_COLUMN]
    frame = (Window.unboundedPreceding, -1 if exclusive else 0)
    inner = Window.partitionBy(*ends).orderBy(order).rowsBetween(*frame)
    outer = Window.partitionBy(*keys).orderBy(BLOCK_COLUMN).rowsBetween(Window.unboundedPreceding, -1)

    def whole(name: str, kind: str) -> Column:
        column = F.col(f"_in_{name}")
        if kind == "last":
            return F.max_by(column, F.when(column.isNotNull(), F.col(order)))
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column)

    def over(column: Column, kind: str, window) -> Column:
        if kind == "last":
            return F.last(column, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column).over(window)

    blocks = based.groupBy(*ends).agg(*[whole(n, aggregates[n][0]).alias(f"_whole_{n}") for n in names])
    carries = blocks.select(*ends, *[over(F.col(f"_whole_{n}"), aggregates[n][0], outer).alias(f"_carry_{n}") for n in names])
    near = based
    for n in names:
        near = near.withColumn(f"_near_{n}", over(F.col(f"_in_{n}"), aggregates[n][0], inner))
    joined = near.join(carries, ends, "left")

    def combine(name: str, kind: str) -> Column:
        here, carry = F.col(f"_near_{name}"), F.col(f"_carry_{name}")
        if kind == "sum":
            return F.when(here.isNull() & carry.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            )
        if kind == "last":
            return F.coalesce(here, carry)
        return (F.greatest if kind == "max" else F.least)(here, carry)

    return joined.select(*df.columns, *[combine(n, aggregates[n][0]).alias(n) for n in names])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    previous: Mapping[str, str],
    starts: Callable[[], Column] | Mapping[str, Callable[[], Column]],
    name: str = "island",
    block: int | Column = BLOCK,
) -> DataFrame:
    """Number maximal stretches of rows; `starts` tests a row against the previous-row columns.

    `previous` maps the names `starts` uses for the row before to columns; the
    test may use those columns of the current row too. The first row of a key
    starts island 1. Several tests number several columns in the same two
    windows: one over the rows and one over the block summaries.
    """
    tests = dict(starts) if isinstance(starts, Mapping) else {name: starts}
    based = df.withColumn(BLOCK_COLUMN, _block_column(order, block))
    ends = [*keys, BLOCK_COLUMN]
    inner = Window.partitionBy(*ends).orderBy(order)
    value = F.struct(*[F.col(old).alias(new) for new, old in previous.items()])
    current = list(dict.fromkeys([*previous.values(), order]))
    opens = {n: F.when(F.coalesce(test(), F.lit(True)), 1).otherwise(0) for n, test in tests.items()}
    marked = based.withColumn("_near", F.lag(value).over(inner))
    marked = marked.select("*", *[F.col("_near")[new].alias(new) for new in previous])
    first = F.col("_near").isNull()
    marked = marked.select("*", *[F.when(first, 0).otherwise(o).alias(f"_opens_{n}") for n, o in opens.items()])
    blocks = marked.groupBy(*ends).agg(
        *[F.sum(f"_opens_{n}").alias(f"_within_{n}") for n in tests],
        F.min_by(F.struct(*current), order).alias("_first"),
        F.max_by(value, order).alias("_tail"),
    )
    outer = Window.partitionBy(*keys).orderBy(BLOCK_COLUMN)
    linked = blocks.withColumn("_before", F.lag("_tail").over(outer)).select(
        "*",
        *[F.col("_first")[c].alias(c) for c in current if c not in ends],
        *[F.col("_before")[new].alias(new) for new in previous],
    )
    linked = linked.select(
        "*", *[F.when(F.col("_before").isNull(), 1).otherwise(o).alias(f"_enter_{n}") for n, o in opens.items()]
    )
    upto = outer.rowsBetween(Window.unboundedPreceding, 0)
    below = outer.rowsBetween(Window.unboundedPreceding, -1)
    carries = linked.select(
        *ends,
        *[
            (F.sum(f"_enter_{n}").over(upto) + F.coalesce(F.sum(f"_within_{n}").over(below), F.lit(0))).alias(f"_carry_{n}")
            for n in tests
        ],
    )
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.select("*", *[F.sum(f"_opens_{n}").over(so_far).alias(f"_run_{n}") for n in tests]).join(carries, ends)
    return joined.select(*df.columns, *[(F.col(f"_run_{n}") + F.col(f"_carry_{n}")).alias(n) for n in tests])
