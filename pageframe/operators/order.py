"""Character levels, visual order and line wrapping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageframe.functions.script import RTL_SCRIPT_CLASS, SPACE_CLASS
from pageframe.functions.text import CHAR_EM, wrap_tokens


def script_level(ch: Column, rtl_line: Column) -> Column:
    """Level by script: 1 for right-to-left characters, 2 for digits inside right-to-left lines, else 0 or 1 as the line."""
    base = F.when(rtl_line, 1).otherwise(0)
    return F.when(ch.rlike(f"[{RTL_SCRIPT_CLASS}]"), 1).when(rtl_line & ch.rlike("[0-9A-Za-z]"), 2).otherwise(base)


def script_segments(text: Column, rtl_line: Column) -> Column:
    """Maximal stretches of equal script_level of a text, as array of struct(level, text); one pass in the row."""
    cut = lambda cls: F.regexp_extract_all(text, F.lit(f"[{cls}]+|[^{cls}]+"), 0)
    parts = F.when(rtl_line, cut("0-9A-Za-z")).otherwise(cut(RTL_SCRIPT_CLASS))
    return F.transform(parts, lambda part: F.struct(script_level(F.substring(part, 1, 1), rtl_line).alias("level"), part.alias("text")))


def segment_by_level(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal stretches of equal level; chars carry pos, ch and level and one text is one key."""
    window = Window.partitionBy(*keys).orderBy("pos")
    opens = F.when(F.lag("level").over(window) == F.col("level"), 0).otherwise(1)
    numbered = chars.withColumn("_o", opens).withColumn("segment", F.sum("_o").over(window))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda s: s["ch"]), "")
    return numbered.groupBy(*keys, "segment").agg(F.min("level").alias("level"), text.alias("text"))


def _visual(levels) -> list[int] | None:
    if levels is None:
        return None
    order = list(range(len(levels)))
    odd = [v for v in levels if v % 2 == 1]
    if not odd:
        return order
    for floor in range(max(levels), min(odd) - 1, -1):
        start = 0
        while start < len(order):
            if levels[order[start]] < floor:
                start += 1
                continue
            end = start
            while end < len(order) and levels[order[end]] >= floor:
                end += 1
            order[start:end] = order[start:end][::-1]
            start = end
    return order


def visual_order(levels: Column) -> Column:
    """Positions in visual order for an array of levels (highest level down to the lowest odd one)."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([_visual(v) for v in batch], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(levels)


def wrap_lines(text: Column, width: Column, em: Column) -> Column:
    """Greedy wrapping: array of lines. White space never starts a line; a word wider than the box stands alone."""
    word = lambda t: F.struct(t.alias("t"), (F.length(t) * em * CHAR_EM).alias("w"), t.rlike(rf"\A[{SPACE_CLASS}]").alias("blank"))
    tokens = F.transform(wrap_tokens(text), word)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0.0).alias("used"))

    def step(s: Column, k: Column) -> Column:
        empty = s["cur"] == ""
        over = ~empty & (s["used"] + k["w"] > width)
        skip = k["blank"] & (empty | over)
        fresh = empty | over
        return F.struct(
            F.when(over, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"),
            F.when(skip, "").when(fresh, k["t"]).otherwise(F.concat(s["cur"], k["t"])).alias("cur"),
            F.when(skip, 0.0).when(fresh, k["w"]).otherwise(s["used"] + k["w"]).alias("used"))

    return F.aggregate(tokens, start, step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))
