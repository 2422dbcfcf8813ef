"""Rich text spans: merging neighbours, splitting into lines, uniform style."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.script import SPACE_CLASS
from pageframe.functions.text import let
from pageframe.operators.scan import islands, with_running

BLOCK = 1 << 16


def merge_spans(spans: DataFrame, keys: Sequence[str], order: str = "seq", block: int = BLOCK) -> DataFrame:
    """Drop empty spans and join neighbours of equal style; one row per merged span."""
    keys = list(keys)
    visible = spans.where(F.col("text") != "")
    same = lambda: ~F.col("_style").eqNullSafe(F.col("style"))
    numbered = islands(visible, keys, order, {"_style": "style"}, same, "island", block)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "")
    return numbered.groupBy(*keys, "island").agg(text.alias("text"), F.min_by("style", order).alias("style"))


def merged_in_row(spans: Column) -> Column:
    """merge_spans for spans that lie in one row, as an array of struct(text, style) in order; nothing is shuffled."""

    def joined(visible: Column) -> Column:
        opens = F.transform(visible, lambda s, i: F.when((i == 0) | ~s["style"].eqNullSafe(F.get(visible, i - 1)["style"]), i))

        def cut(begins: Column) -> Column:
            def piece(b: Column, n: Column) -> Column:
                size = F.coalesce(F.get(begins, n + 1), F.size(visible)) - b
                text = F.array_join(F.transform(F.slice(visible, b + 1, size), lambda s: s["text"]), "")
                return F.struct(text.alias("text"), F.get(visible, b)["style"].alias("style"))

            return F.transform(begins, piece)

        return let(F.filter(opens, lambda b: b.isNotNull()), cut)

    return let(F.filter(spans, lambda s: s["text"] != ""), joined)


def uniform_in_row(spans: Column) -> Column:
    """uniform_style for spans that lie in one row, as an array of struct(text, style)."""

    def agreed(visible: Column) -> Column:
        first = F.get(visible, F.lit(0))["style"]
        return F.when(F.forall(visible, lambda s: s["style"].eqNullSafe(first)), first)

    return let(F.filter(spans, lambda s: F.translate(s["text"], "\n", "") != ""), agreed)


def plain_text(spans: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "")
    return spans.groupBy(*keys).agg(text.alias("text"))


def uniform_style(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The style all visible spans share, null when they differ; spans of only line breaks do not count."""
    visible = spans.where(F.translate(F.col("text"), "\n", "") != "")
    key = F.coalesce(F.to_json("style"), F.lit(""))
    agreed = F.min(key) == F.max(key)
    return visible.groupBy(*keys).agg(F.when(agreed, F.max_by("style", key)).alias("style"))


def spans_by_line(spans: DataFrame, keys: Sequence[str], order: str = "seq", block: int = BLOCK) -> DataFrame:
    """Split spans at line breaks and trim leading white space of each line.

    Adds line_in_block and part; pieces that end up empty are left out.
    """
    keys = list(keys)
    breaks = F.size(F.split("text", "\n")) - 1
    counted = with_running(spans, keys, order, {"_lines": ("sum", breaks)}, block, exclusive=True)
    others = [c for c in spans.columns if c != "text"]
    pieces = counted.select(*others, F.coalesce("_lines", F.lit(0)).alias("_lines"), F.posexplode(F.split("text", "\n")).alias("part", "text"))
    pieces = pieces.where(F.col("text") != "").withColumn("line_in_block", (F.col("_lines") + F.col("part")).cast("long"))
    solid = F.when(F.col("text").rlike(f"[^{SPACE_CLASS}]"), F.struct(order, "part"))
    firsts = pieces.groupBy(*keys, "line_in_block").agg(F.min(solid).alias("_first"))
    joined = pieces.join(firsts, [*keys, "line_in_block"])
    leading = F.col("_first").isNull() | (F.struct(order, "part") <= F.col("_first"))
    trimmed = F.when(leading, F.regexp_replace("text", rf"\A[{SPACE_CLASS}]+", "")).otherwise(F.col("text"))
    return joined.withColumn("text", trimmed).where(F.col("text") != "").drop("_lines", "_first")
