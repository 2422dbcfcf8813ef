"""Page order: slots, moving, inserting, assembling the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.operators.scan import with_previous, with_running


def slot_index(slots: DataFrame) -> DataFrame:
    """Position of every slot counted from 0, whatever gaps pos has."""
    return with_running(slots, ["doc"], "pos", {"_n": ("sum", F.lit(1))}).withColumn("index", F.col("_n") - 1).drop("_n")


def copy_cursor(slots: DataFrame) -> DataFrame:
    """How often each slot's source was used before it: its copy number."""
    used = with_running(slots.where(F.col("kind") == "page"), ["doc", "source_key"], "pos", {"_n": ("sum", F.lit(1))})
    return used.withColumn("copy_no", F.col("_n") - 1).drop("_n")


def is_reordered(slots: DataFrame) -> DataFrame:
    """Per document whether any primary page comes after a later one."""
    primary = slots.where((F.col("kind") == "page") & (F.col("source_key") == "primary"))
    before = with_previous(primary, ["doc"], "pos", {"_page": "source_page_index"})
    return before.groupBy("doc").agg(F.bool_or(F.coalesce(F.col("source_page_index") < F.col("_page"), F.lit(False))).alias("reordered"))


def keep_newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows per key; ranks by a block scan, so a key may be of any size."""
    numbered = with_running(rows, keys, order, {"_n": ("sum", F.lit(1))})
    total = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    return numbered.join(total, keys).where(F.col("_n") > F.col("_total") - n).drop("_n", "_total")


def move_slot(indexed: DataFrame, moves: DataFrame) -> DataFrame:
    """Positions after moving one slot per document; moves carry doc, from_index, to_index."""
    joined = indexed.join(moves, "doc", "left")
    i, a, b = F.col("index"), F.col("from_index"), F.col("to_index")
    moved = (
        F.when(a.isNull() | (a == b), i).when(i == a, b).when((a < b) & (i > a) & (i <= b), i - 1)
        .when((a > b) & (i >= b) & (i < a), i + 1).otherwise(i))
    return joined.withColumn("index", moved).drop("from_index", "to_index")


def insert_slots(indexed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert numbered slots (doc, at, n from 0) at a position clamped to the list."""
    size = indexed.groupBy("doc").agg(F.count("*").alias("_size"))
    block = fresh.groupBy("doc").agg(F.min("at").alias("_at"), F.count("*").alias("_count")).join(size, "doc", "left")
    block = block.withColumn("_at", F.greatest(F.lit(0), F.least(F.col("_at"), F.coalesce("_size", F.lit(0)))))
    old = indexed.join(block.drop("_size"), "doc", "left")
    old = old.withColumn("index", F.when(F.col("index") >= F.col("_at"), F.col("index") + F.col("_count")).otherwise(F.col("index"))).drop("_at", "_count")
    new = fresh.join(block.select("doc", "_at"), "doc").withColumn("index", F.col("_at") + F.col("n")).drop("_at", "at", "n")
    return old.unionByName(new, allowMissingColumns=True)


def delete_slots(slots: DataFrame, gone: DataFrame) -> DataFrame:
    return slot_index(slots.join(gone, ["doc", "slot_id"], "left_anti"))


def concat_slots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Slots of b after those of a, positions renumbered."""
    size = a.groupBy("doc").agg((F.max("pos") + 1).alias("_shift"))
    moved = b.join(size, "doc", "left").withColumn("pos", F.col("pos") + F.coalesce("_shift", F.lit(0))).drop("_shift")
    return slot_index(a.unionByName(moved))


def assemble_pages(slots: DataFrame, pages: DataFrame) -> DataFrame:
    """Output pages in slot order; blank slots have their own size, unknown sources are skipped."""
    known = slots.where(F.col("kind") == "page").join(
        pages.select("source_key", F.col("page_index").alias("source_page_index"), "pdf_width", "pdf_height"), ["source_key", "source_page_index"])
    blank = slots.where(F.col("kind") == "blank").withColumn("pdf_width", F.col("w")).withColumn("pdf_height", F.col("h"))
    columns = ["doc", "slot_id", "pos", "kind", "source_key", "source_page_index", "pdf_width", "pdf_height"]
    return slot_index(known.select(*columns).unionByName(blank.select(*columns))).withColumnRenamed("index", "output_page")


def first_of(value: Column, *rank: Column) -> Column:
    """Aggregate: the value of the row with the least rank (strict less-than, first wins)."""
    return F.min_by(value, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))


def longest(value: Column, text: Column, order: Column) -> Column:
    """Aggregate: the value of the longest text, the earlier one on ties."""
    return F.max_by(value, F.struct(F.length(text).alias("n"), (-order).alias("o")))
