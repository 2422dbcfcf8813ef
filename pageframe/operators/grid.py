"""Position joins as equi-joins on grid cells or bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageframe.functions.geometry import rects_overlap

CELL = 64.0
MOST_CELLS = 4096
_PAGE_CELL = -(1 << 62)
SMALL_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, most_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint after a count that stops early; larger sides keep the shuffle join.

    Call it on a narrow table that is cheap to compute or already written out.
    """
    if df.limit(most_rows + 1).count() <= most_rows:
        return F.broadcast(df)
    return df


def only_pages(df: DataFrame, pages: DataFrame, keys: Sequence[str] = ("source_key", "page_index")) -> DataFrame:
    """Rows on the given pages."""
    return df.join(pages.select(*keys).distinct(), list(keys), "left_semi")


def _cells(rect: Column, cell: float) -> Column:
    columns = F.sequence(F.floor(rect["x"] / cell), F.floor((rect["x"] + rect["w"]) / cell))
    rows = F.sequence(F.floor(rect["y"] / cell), F.floor((rect["y"] + rect["h"]) / cell))
    return F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: F.struct(c.alias("cx"), r.alias("cy")))))


def _cell_count(rect: Column, cell: float) -> Column:
    return (F.floor((rect["x"] + rect["w"]) / cell) - F.floor(rect["x"] / cell) + 1) * (
        F.floor((rect["y"] + rect["h"]) / cell) - F.floor(rect["y"] / cell) + 1
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_rect: str,
    right_rect: str,
    keys: Sequence[str] = ("source_key", "page_index"),
    cell: float = CELL,
    all_small: bool = False,
) -> DataFrame:
    """All pairs of rects with equal keys that overlap strictly, each side read once.

    Each rect is repeated in the cells it covers and joined by cell, so one
    crowded page spreads over many tasks. A pair that meets in several cells is
    kept only in the cell holding the lower left corner of the intersection,
    which needs no de-duplication shuffle. A rect that covers more than
    MOST_CELLS cells is not repeated; it meets the other side in one of two page
    cells, which hold only such rects on the left or on the right. `all_small`
    leaves the page cells out when the caller knows that no rect is so large.
    """
    keys = list(keys)
    lrect, rrect = F.col(left_rect), F.col(right_rect)
    place = lambda side: F.array(F.struct(F.lit(_PAGE_CELL).alias("cx"), F.lit(side).cast("bigint").alias("cy")))
    none = F.array().cast("array<struct<cx:bigint,cy:bigint>>")

    def spread(df: DataFrame, r: Column, with_small: Column, with_large: Column) -> DataFrame:
        small = _cell_count(r, cell) <= MOST_CELLS
        cells = F.concat(_cells(r, cell), none if all_small else with_small)
        placed = cells if all_small else F.when(small, cells).otherwise(with_large)
        return df.select("*", F.explode(placed).alias("_c")).select("*", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy")).drop("_c")

    # Page cell 0 holds large left rects, page cell 1 large right rects.
    lrows = spread(left, lrect, place(1), place(0))
    rrows = spread(right, rrect, place(0), F.concat(place(0), place(1)))
    home = (F.col("_cx") == F.floor(F.greatest(lrect["x"], rrect["x"]) / cell)) & (
        F.col("_cy") == F.floor(F.greatest(lrect["y"], rrect["y"]) / cell))
    pairs = lrows.join(rrows, [*keys, "_cx", "_cy"])
    return pairs.where(rects_overlap(lrect, rrect) & (home | (F.col("_cx") == _PAGE_CELL))).drop("_cx", "_cy")


def band_join(
    left: DataFrame,
    right: DataFrame,
    left_value: Column,
    right_value: Column,
    reach: float,
    keys: Sequence[str] = ("source_key", "page_index"),
) -> DataFrame:
    """Pairs with equal keys whose values differ by at most `reach`.

    Bands are `reach` wide; the right side is repeated in its own band and both
    neighbours, so every pair meets exactly once in the band of the left row.
    """
    keys = list(keys)
    lband = left.withColumn("_lv", left_value).withColumn("_band", F.floor(F.col("_lv") / reach))
    rband = right.withColumn("_rv", right_value).withColumn(
        "_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_rv") / reach) + d))
    )
    near = F.abs(F.col("_lv") - F.col("_rv")) <= reach
    return lband.join(rband, [*keys, "_band"]).where(near).drop("_band", "_lv", "_rv")


def values_within(
    rows: DataFrame, values: DataFrame, row_value: str, value: str, reach: float, keys: Sequence[str] = ("source_key", "page_index"),
) -> DataFrame:
    """Each row with every distinct value of `values` on its page that differs from its own by at most `reach`.

    Like band_join, but both sides meet in one window over a band, so rows that are dealt out by page stay where they are.
    """
    keys = list(keys)
    band = lambda c: F.floor(F.col(c) / reach)
    kept = [c for c in rows.columns if c not in keys]
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: band(value) + d))
    marks = values.select(*keys, value).distinct().select(*keys, near.alias("_band"), F.col(value).alias("_value"))
    asked = rows.select(*keys, band(row_value).alias("_band"), F.struct(*kept).alias("_row"))
    events = marks.unionByName(asked, allowMissingColumns=True)
    met = events.withColumn("_met", F.collect_set("_value").over(Window.partitionBy(*keys, "_band"))).where(F.col("_row").isNotNull())
    found = F.filter("_met", lambda v: F.abs(v - F.col("_row")[row_value]) <= reach)
    return met.select(*keys, *[F.col("_row")[c].alias(c) for c in kept], F.explode(found).alias(value))


def met_in_band(rows: DataFrame, marks: DataFrame, row_value: str, mark_value: str, reach: str, keys: Sequence[str] = ("source_key", "page_index")) -> DataFrame:
    """Pairs of a row and a mark of its page that may lie within the largest `reach` of the page's marks; the caller tests them exactly.

    Like band_join, but bands are as wide as the page's marks need, and both sides meet in windows of a page, so rows that
    are dealt out by page stay where they are. Columns of rows and marks have different names.
    """
    keys = list(keys)
    of_row, of_mark = ([c for c in df.columns if c not in keys] for df in (rows, marks))
    events = marks.select(*keys, F.struct(*of_mark).alias("_mark")).unionByName(
        rows.select(*keys, F.struct(*of_row).alias("_row")), allowMissingColumns=True)
    wide = events.dropna(subset=keys).withColumn("_reach", F.max(F.col("_mark")[reach]).over(Window.partitionBy(*keys))).where(F.col("_reach").isNotNull())
    band = F.floor(F.coalesce(F.col("_mark")[mark_value], F.col("_row")[row_value]) / F.col("_reach"))
    near = F.when(F.col("_row").isNotNull(), F.array(band)).otherwise(F.array(band - 1, band, band + 1))
    placed = wide.select(*keys, "_mark", "_row", F.explode(near).alias("_band"))
    met = placed.withColumn("_marks", F.collect_list("_mark").over(Window.partitionBy(*keys, "_band"))).where(F.col("_row").isNotNull())
    return met.select(*keys, "_row", F.explode("_marks").alias("_mark")).select(
        *keys, *[F.col("_row")[c].alias(c) for c in of_row], *[F.col("_mark")[c].alias(c) for c in of_mark])


def sort_prefix(keys: Sequence[str]) -> Column:
    """A number that tells most keys apart, to lead a window's keys: rows of a task are then sorted by it, and seldom by their names.

    The hash of the first keys comes before the last key, a whole number, so rows that are already in order stay near each other.
    """
    *page, last = keys
    return F.shiftleft(F.hash(*page).cast("long"), 32) + F.coalesce(F.pmod(F.col(last), F.lit(1 << 32)), F.lit(0)).cast("long")


def fetched(rows: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row with `columns` of the one row of `table` that has its keys, null without one.

    A left join on a unique key; both sides meet in one window, so rows that are dealt out by page, which a join on
    more keys than the page would deal out anew, stay where they are.
    """
    keys = list(keys)
    kept = [c for c in rows.columns if c not in keys]
    given = table.select(*keys, F.struct(*columns).alias("_got"))
    asked = rows.select(*keys, F.struct(*kept, F.lit(True).alias("_asks")).alias("_asker"))
    events = given.unionByName(asked, allowMissingColumns=True).withColumn(
        "_mix", sort_prefix(keys) if isinstance(rows.schema[keys[-1]].dataType, T.IntegralType) else F.xxhash64(*keys))
    met = events.withColumn("_found", F.max("_got").over(Window.partitionBy("_mix", *keys))).where(F.col("_asker").isNotNull())
    return met.select(*keys, *[F.col("_asker")[c].alias(c) for c in kept], *[F.col("_found")[c].alias(c) for c in columns])


def nearest_in_row(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    probe_x: str,
    point_x: str,
    point_id: str,
    width: float | None = None,
    kinds: tuple[str, Sequence[str], str] | None = None,
) -> DataFrame:
    """Each probe with its nearest points on either side along x, at most two rows per probe.

    Instead of all pairs of a row, both sides are sorted along x together. Points
    at one x are first reduced to the smallest id. A row is one window each way,
    which needs no join; with `width` rows are cut into blocks along x, and block
    summaries carry the neighbours across borders. Adds near_x and near_id.

    `kinds` names the points' column of kinds, all its values, and the probes' array of those a probe
    may take; a probe then has its nearest points of each kind, without being repeated for it.
    """
    keys = list(keys)
    kind, values, wanted = kinds or (None, [None], None)
    ends = [*keys, "_blk"] if width else keys
    kept = [c for c in probes.columns if c not in keys]
    of_kind = [F.col(kind).alias("_kind")] if kind else [F.lit(None).cast("string").alias("_kind")]
    single = points.select(*keys, F.col(point_x).alias("_x"), F.col(point_id).alias("_id"), *of_kind)
    single = single.groupBy(*keys, "_x", "_kind").agg(F.min("_id").alias("_id"))
    point = F.struct(F.col("_x").alias("x"), F.col("_id").alias("id"))
    right = single.select(*keys, "_x", "_kind", F.lit(0).alias("_side"), point.alias("_pt"))
    left = probes.select(*keys, F.col(probe_x).alias("_x"), F.lit(1).alias("_side"), F.struct(*kept).alias("_probe"))
    events = right.unionByName(left, allowMissingColumns=True)
    if width:
        events = events.withColumn("_blk", F.floor(F.col("_x") / width))
    upto = (Window.unboundedPreceding, 0)
    rising = Window.partitionBy(*ends).orderBy("_x", "_side").rowsBetween(*upto)
    falling = Window.partitionBy(*ends).orderBy(F.col("_x").desc(), F.col("_side").desc()).rowsBetween(*upto)
    of = lambda v: F.col("_pt") if kind is None else F.when(F.col("_kind") == v, F.col("_pt"))
    places = list(enumerate(values))
    placed = events.select("*", *[F.last(of(v), ignorenulls=True).over(rising).alias(f"_below{n}") for n, v in places])
    placed = placed.select("*", *[F.last(of(v), ignorenulls=True).over(falling).alias(f"_above{n}") for n, v in places])
    placed = placed.where(F.col("_side") == 1)
    if width:
        outer = Window.partitionBy(*keys).orderBy("_blk")
        summary = events.groupBy(*ends).agg(
            *[F.min(of(v)).alias(f"_lo{n}") for n, v in places], *[F.max(of(v)).alias(f"_hi{n}") for n, v in places])
        carries = summary.select(
            *ends,
            *[F.last(f"_hi{n}", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before{n}") for n, _ in places],
            *[F.first(f"_lo{n}", ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)).alias(f"_after{n}") for n, _ in places],
        )
        placed = placed.join(carries, ends, "left")
        placed = placed.select(keys + ["_probe"] + [F.coalesce(f"_below{n}", f"_before{n}").alias(f"_below{n}") for n, _ in places]
                               + [F.coalesce(f"_above{n}", f"_after{n}").alias(f"_above{n}") for n, _ in places])
    may = lambda v, c: F.col(c) if kind is None else F.when(F.array_contains(F.col("_probe")[wanted], v), F.col(c))
    near = F.array(*[may(v, f"{side}{n}") for n, v in places for side in ("_below", "_above")])
    found = placed.select(*keys, "_probe", F.explode(near).alias("_near"))
    return found.where(F.col("_near").isNotNull()).select(
        *keys, *[F.col("_probe")[c].alias(c) for c in kept], F.col("_near.x").alias("near_x"), F.col("_near.id").alias("near_id")
    )
