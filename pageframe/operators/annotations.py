"""Annotations: reading, writing back, comparing, seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.geometry import annotation_bbox, js_round, normalise_rect
from pageframe.functions.text import annotation_da_font_size, annotation_id
from pageframe.operators.scan import with_running

# Default colours and pen.
HIGHLIGHT_COLOR, COMMENT_COLOR, INK_COLOR = (1.0, 0.92, 0.23), (1.0, 0.96, 0.62), (0.93, 0.27, 0.27)
PEN = 1.5
KINDS = {"Highlight": "highlight", "FreeText": "comment", "Ink": "ink"}


def _color(value: Column, fallback: Column) -> Column:
    return F.when(F.size(value) >= 3, F.slice(value, 1, 3)).otherwise(fallback)


def normalise_annotations(raw: DataFrame) -> DataFrame:
    """Raw annotation entries to the wide annotation table; other subtypes and broken entries are skipped.

    Raw rows carry source_key, page_index, annot_index, subtype, nm, rect_nums,
    quad_nums, ink_nums (array of number arrays), c, ic, contents, da, bs_w, border.
    """
    default = lambda c: F.array(*[F.lit(v) for v in c])
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("subtype")]
    quad_count = F.floor(F.size("quad_nums") / 8).cast("int")
    at = lambda base, i: F.get("quad_nums", base * 8 + i)
    quads = F.when(quad_count > 0, F.transform(F.sequence(F.lit(0), quad_count - 1), lambda q: F.struct(
        *[at(q, 2 * n + d).alias(f"{'xy'[d]}{n + 1}") for n in range(4) for d in range(2)])))
    pair_count = lambda s: F.floor(F.size(s) / 2).cast("int")
    long = F.filter("ink_nums", lambda s: pair_count(s) >= 2)
    strokes = F.transform(long, lambda s: F.transform(F.sequence(F.lit(0), pair_count(s) - 1), lambda i: F.struct(
        F.get(s, i * 2).alias("x"), F.get(s, i * 2 + 1).alias("y"))))
    rows = raw.withColumn("kind", kind).where(F.col("kind").isNotNull())
    is_kind = lambda k: F.col("kind") == k
    rows = rows.select(
        "source_key", "page_index", "annot_index", "kind",
        annotation_id(F.col("source_key"), F.col("page_index"), F.col("annot_index"), F.col("nm"), F.col("kind")).alias("id"),
        F.when(is_kind("highlight"), quads).alias("quads"), F.when(is_kind("ink"), strokes).alias("strokes"),
        F.when(is_kind("comment"), normalise_rect(F.col("rect_nums"))).alias("rect"),
        F.when(is_kind("highlight"), _color(F.col("c"), default(HIGHLIGHT_COLOR)))
        .when(is_kind("comment"), _color(F.col("ic"), _color(F.col("c"), default(COMMENT_COLOR))))
        .otherwise(_color(F.col("c"), default(INK_COLOR))).alias("color"),
        F.when(is_kind("comment"), F.coalesce("contents", F.lit(""))).when(is_kind("highlight"), F.col("contents")).alias("text"),
        F.when(is_kind("comment"), annotation_da_font_size(F.col("da"))).alias("font_size"),
        F.when(is_kind("ink"), F.coalesce(F.col("bs_w"), F.get("border", F.lit(2)), F.lit(PEN))).alias("thickness"),
    )
    whole = (is_kind("highlight") & F.col("quads").isNotNull()) | (is_kind("comment") & F.col("rect").isNotNull()) | (
        is_kind("ink") & (F.size("strokes") > 0))
    return rows.where(whole)


def annotation_rows(annots: DataFrame) -> DataFrame:
    """Back to flat entries: box, quad numbers, ink number lists."""
    quad = F.flatten(F.transform("quads", lambda q: F.array(*[q[f"{d}{n}"] for n in range(1, 5) for d in "xy"])))
    ink = F.transform("strokes", lambda s: F.flatten(F.transform(s, lambda p: F.array(p["x"], p["y"]))))
    return annots.withColumn("box", annotation_bbox(F.col("kind"), F.col("quads"), F.col("rect"), F.col("strokes"))).withColumn(
        "quad_nums", quad).withColumn("ink_nums", ink)


def _r3(value: Column) -> Column:
    return js_round(value * 1000) / 1000


def signature(annots_row_kind: Column) -> Column:
    """Text that is equal for annotations that agree to three decimals."""
    quads = F.transform("quads", lambda q: F.array(*[_r3(q[f"{d}{n}"]) for n in range(1, 5) for d in "xy"]))
    strokes = F.transform("strokes", lambda s: F.transform(s, lambda p: F.array(_r3(p["x"]), _r3(p["y"]))))
    color = F.transform("color", _r3)
    rect = F.array(*[_r3(F.col(f"rect.{n}")) for n in "xywh"])
    body = (
        F.when(annots_row_kind == "highlight", F.to_json(F.struct(quads.alias("q"), color.alias("c"), F.coalesce("text", F.lit("")).alias("t"))))
        .when(annots_row_kind == "comment", F.to_json(F.struct(rect.alias("r"), color.alias("c"), F.col("text").alias("t"), _r3(F.col("font_size")).alias("f"))))
        .otherwise(F.to_json(F.struct(strokes.alias("s"), color.alias("c"), _r3(F.col("thickness")).alias("w"))))
    )
    return F.concat_ws(":", annots_row_kind, body)


def subtract_annotations(current: DataFrame, baseline: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Current rows left after every baseline row took away one row of equal signature, earliest first.

    Both carry signature; current rows of unsupported kinds carry null and stay.
    Copies are numbered by a block scan, so one signature may be of any count.
    """
    counts = baseline.groupBy(*keys, "signature").agg(F.count("*").alias("_n"))
    known = current.where(F.col("signature").isNotNull())
    numbered = with_running(known, [*keys, "signature"], order, {"_k": ("sum", F.lit(1))})
    left = numbered.join(counts, [*keys, "signature"], "left").where(F.col("_k") > F.coalesce("_n", F.lit(0)))
    return left.select(*current.columns).unionByName(current.where(F.col("signature").isNull()))


def annotation_lists_equal(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key whether both lists have the same signatures in the same order.

    Rows are compared by their rank in the list, so no list is gathered.
    """
    def ranked(df: DataFrame, name: str) -> DataFrame:
        numbered = with_running(df, keys, order, {"_rank": ("sum", F.lit(1))})
        return numbered.select(*keys, "_rank", F.col("signature").alias(name))

    both = ranked(a, "_a").join(ranked(b, "_b"), [*keys, "_rank"], "full")
    return both.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("equal"))


def seed_slot_annotations(annots: DataFrame, slots: DataFrame) -> DataFrame:
    """A copy of each page's annotations for every slot of the same document that shows the page."""
    shown = slots.where(F.col("kind") == "page").select("doc", "slot_id", "source_key", F.col("source_page_index").alias("page_index"))
    return annots.join(shown, ["doc", "source_key", "page_index"])
