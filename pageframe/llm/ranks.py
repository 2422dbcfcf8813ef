"""Row numbers along an order, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.store import written


def numbered(df: DataFrame, group: str, order: list[str], name: str = "idx") -> DataFrame:
    """`df` with `name`, the place of a row in its group from 0, and `n`, the rows of the group.

    Rows are dealt to ranges of (group, order) and written; a row's number is its place in its range plus the rows of its
    group in earlier ranges. Equal rows are told apart by where they were read, so a crowd of them is spread over ranges
    too. A range is one task; the summary has a row per range and group that meet.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(F.col(group), *[F.col(c) for c in order], F.col("_tie")).withColumn("_range", F.spark_partition_id())
    kept = written(ranged, "ranked")
    counts = kept.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    starts = counts.select(group, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"), F.sum("_rows").over(whole).alias("n"))
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_tie")
    placed = kept.withColumn("_place", F.row_number().over(inside)).join(starts, [group, "_range"])
    return placed.select(*df.columns, (F.col("_start") + F.col("_place") - 1).alias(name), "n")
