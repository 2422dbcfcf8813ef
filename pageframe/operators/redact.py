"""Redaction: what lies under a rect is removed, never covered only. When unsure, remove more."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageframe.functions.geometry import (
    box_of_strokes,
    EPS,
    box_of_rects,
    expand_rect,
    glyph_aabb,
    quad_rect,
    rect,
    rect_contains,
    rect_to_quad,
    rects_overlap,
)
from pageframe.operators.cmap import sized_shows
from pageframe.operators.content import glyph_positions
from pageframe.operators.grid import SMALL_ROWS, broadcast_if_small, only_pages, overlap_join
from pageframe.operators.scan import islands
from pageframe.session import cut_lineage

PAGE = ["source_key", "page_index"]
SHOW = [*PAGE, "op_index"]
MARK = "█"
FEW_SENTINELS = 256


def glyph_rows(shows: DataFrame, widths: DataFrame, fonts: DataFrame) -> DataFrame:
    """Glyphs and TJ numbers of shows in order, placed in text space.

    Shows carry segments (array of struct(bytes, spacer)), font, and text state
    (size, tc, tw, th, tm).
    """
    state = ["size", "tc", "tw", "th", "tm"]
    parts = shows.select(*SHOW, "font", *state, F.posexplode("segments").alias("seg", "part"))
    strings = parts.where(F.col("part.bytes").isNotNull()).select(*SHOW, "seg", "font", *state, F.col("part.bytes").alias("bytes"))
    sized = sized_shows(strings, widths, fonts).select(*SHOW, "seg", *state, "supported", "two_byte", F.posexplode("glyphs").alias("seq", "_g"))
    glyphs = sized.select(
        *SHOW, (F.col("seg").cast("long") * (1 << 32) + F.col("seq")).alias("seq"), "_g.gid", "_g.width", "supported", "two_byte",
        F.lit(None).cast("double").alias("spacer"), *state)
    numbers = parts.where(F.col("part.bytes").isNull()).select(
        *SHOW, (F.col("seg").cast("long") * (1 << 32)).alias("seq"), F.lit(None).cast("int").alias("gid"),
        F.lit(None).cast("double").alias("width"), F.lit(True).alias("supported"), F.lit(False).alias("two_byte"),
        F.col("part.spacer").alias("spacer"), *state)
    steps = glyphs.unionByName(numbers)
    steps = steps.withColumn("is_space", ~F.col("two_byte") & (F.col("gid") == 0x20))
    return glyph_positions(steps)


def mark_glyphs(glyphs: DataFrame, rects: DataFrame, rect_col: str = "red") -> DataFrame:
    """Add hit: whether a glyph's box overlaps any redaction of its page."""
    boxed = glyphs.where(F.col("spacer").isNull() & F.col("supported")).withColumn(
        "box", glyph_aabb(F.col("tm"), F.col("x0"), F.col("x1"), F.col("size")))
    hits = overlap_join(boxed.select(*SHOW, "seq", "box"), rects.select(*PAGE, rect_col), "box", rect_col)
    hit = hits.groupBy(*SHOW, "seq").agg(F.lit(True).alias("hit"))
    return glyphs.join(hit, [*SHOW, "seq"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def redact_glyphs(shows: DataFrame, marked: DataFrame, rects: DataFrame) -> DataFrame:
    """Plan per show: untouched, drop, rewrite, or unsupported.

    Shows of a redacted page whose glyphs cannot be placed are unsupported even
    when nothing overlaps; like drop they go as a whole.
    """
    glyph = F.col("spacer").isNull()
    per_show = marked.groupBy(*SHOW).agg(
        F.bool_or(glyph & F.col("hit")).alias("any_hit"), F.bool_or(glyph & ~F.col("hit")).alias("any_kept"),
        F.bool_and("supported").alias("supported"))
    pages = rects.select(*PAGE).distinct().withColumn("redacted_page", F.lit(True))
    planned = shows.join(per_show, SHOW, "left").join(pages, PAGE, "left")
    readable = F.col("font").isNotNull() & (F.col("size") > 0) & F.col("segments").isNotNull() & F.coalesce("supported", F.lit(True))
    kind = (
        F.when(F.col("redacted_page").isNull(), "untouched")
        .when(~F.coalesce(readable, F.lit(False)), "unsupported")
        .when(~F.coalesce("any_hit", F.lit(False)), "untouched")
        .when(~F.coalesce("any_kept", F.lit(False)), "drop")
        .otherwise("rewrite")
    )
    return planned.withColumn("plan", kind).drop("any_hit", "any_kept", "supported", "redacted_page")


def rewrite_shows(marked: DataFrame) -> DataFrame:
    """Rewritten operand of partly redacted shows: kept strings and the gaps that hold later glyphs in place.

    One row per show with items, an array of struct(hex, gap) in order.
    """
    gap = F.col("hit") | F.col("spacer").isNotNull()
    flagged = marked.withColumn("is_gap", gap)
    numbered = islands(flagged, SHOW, "seq", {"_was": "is_gap"}, lambda: F.col("_was") != F.col("is_gap"), "stretch")
    code = F.when(F.col("two_byte"), F.lpad(F.hex("gid"), 4, "0")).otherwise(F.lpad(F.hex("gid"), 2, "0"))
    stretch = numbered.groupBy(*SHOW, "stretch").agg(
        F.bool_or("is_gap").alias("is_gap"), F.sum("step").alias("moved"), F.max("size").alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", code.alias("c")))), lambda s: s["c"]), "").alias("hex"))
    kept = stretch.where(~F.col("is_gap") | (F.col("moved") != 0))
    item = F.struct(
        "stretch", F.when(~F.col("is_gap"), F.col("hex")).alias("hex"),
        F.when(F.col("is_gap"), -(F.col("moved") / F.col("size")) * 1000).alias("gap"))
    return kept.groupBy(*SHOW).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: F.struct(i["hex"], i["gap"])).alias("items"))


def cut_spans(text: Column, spans: Column, mark: str = MARK) -> Column:
    """Text with the characters of the spans (array of struct(start, len)) replaced one for one."""
    inside = lambda i: F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["len"]))
    marked = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(inside(i), mark).otherwise(c)), "")
    return F.when(F.size(spans) > 0, marked).otherwise(text)


def pattern_spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array of struct(start, len, text); one pass, no shuffle."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern)
    total = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, p: a + F.length(p))
    spans = F.transform(found, lambda m, i: F.struct(
        (total(gaps, i + 1) + total(found, i)).alias("start"), F.length(m).alias("len"), m.alias("text")))
    empty = F.array().cast("array<struct<start:int,len:int,text:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def redact_text(rows: DataFrame, text_col: str, spans_col: str, mark: str = MARK) -> DataFrame:
    """Cut spans from a text column; plan tells untouched, rewrite or drop (nothing left)."""
    covered = F.length(F.translate(F.col("redacted"), mark, "")) == 0
    cut = rows.withColumn("redacted", cut_spans(F.col(text_col), F.col(spans_col), mark))
    plan = F.when(F.size(spans_col) == 0, "untouched").when(covered, "drop").otherwise("rewrite")
    return cut.withColumn("plan", plan)


def leak_check(
    texts: DataFrame, text_col: str, sentinels: DataFrame, sentinel_col: str, keys: Sequence[str] = (), few: int = FEW_SENTINELS,
) -> DataFrame:
    """(text row, sentinel) pairs still readable; must be empty before a result is written.

    With keys, sentinels are only looked for in rows of the same key. Without,
    a few sentinels are tried on every text where it lies. More of them meet the
    texts on a leading gram of 1, 2, 4 or 8 characters, an equi-join whatever
    their number; only grams that some sentinel begins with are joined, and
    lists or grams that a count shows to be small are broadcast, so texts are
    repeated in a shuffle only where a gram was found among too many sentinels.
    """
    found = F.contains(F.col(text_col), F.col(sentinel_col))
    if keys:
        return texts.join(sentinels.select(*keys, sentinel_col).distinct(), list(keys)).where(found)
    n = F.length(sentinel_col)
    size = F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
    lists = cut_lineage(sentinels.where(n > 0).select(sentinel_col).distinct().withColumn("_q", size).withColumn(
        "_gram", F.col(sentinel_col).substr(F.lit(1), F.col("_q"))))
    if lists.limit(few + 1).count() <= few:
        return texts.join(F.broadcast(lists.select(sentinel_col)), found)
    sizes = [r["_q"] for r in lists.select("_q").distinct().collect()]  # at most four values
    def grams_of(q: int) -> Column:
        letters = F.col("_letters")
        gram = F.transform(F.sequence(F.lit(1), F.size(letters) - q + 1), lambda i: F.array_join(F.slice(letters, i, q), ""))
        rows = F.transform(F.array_distinct(gram), lambda g: F.struct(F.lit(q).alias("_q"), g.alias("_gram")))
        return F.when(F.size(letters) >= q, rows).otherwise(F.array().cast("array<struct<_q:int,_gram:string>>"))

    grams = [grams_of(q) for q in sizes]
    lettered = texts.withColumn("_letters", F.split(text_col, ""))
    exploded = lettered.select("*", F.explode(F.flatten(F.array(*grams))).alias("_g")).select("*", "_g._q", "_g._gram")
    exploded = exploded.drop("_g", "_letters")
    if lists.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return exploded.join(F.broadcast(lists), ["_q", "_gram"]).where(found).drop("_q", "_gram")
    starts = broadcast_if_small(lists.select("_q", "_gram").distinct())
    return exploded.join(starts, ["_q", "_gram"], "left_semi").join(lists, ["_q", "_gram"]).where(found).drop("_q", "_gram")


def redact_images(images: DataFrame, rects: DataFrame, rect_col: str = "red") -> DataFrame:
    """Action per image that a redaction touches: remove_do, remove_block or repaint.

    Images carry rect, subtype, q_index and plain_raster (an unmasked 8-bit
    Gray, RGB or CMYK raster).
    """
    pairs = overlap_join(images, rects.select(*PAGE, rect_col), "rect", rect_col)
    covered = F.bool_or(rect_contains(F.col(rect_col), F.col("rect")))
    keys = [*PAGE, "image_id"]
    judged = pairs.groupBy(*keys).agg(covered.alias("covered"), F.collect_list(rect_col).alias("cuts"))
    action = (
        F.when(F.col("q_index").isNull(), "remove_do")
        .when((F.col("subtype") != "Image") | F.col("covered"), "remove_block")
        .when(F.col("plain_raster"), "repaint")
        .otherwise("remove_block")
    )
    return images.join(judged, keys).withColumn("action", action)


def inline_image_ops(ops: DataFrame, rects: DataFrame) -> DataFrame:
    """Inline images on redacted pages; all of them go."""
    return only_pages(ops.where(F.col("op") == "BI"), rects).select(*PAGE, "op_index")


def _black_out(samples: bytes, width: int, height: int, components: int, windows) -> bytes | None:
    if samples is None or components not in (1, 3, 4) or len(samples) < width * height * components:
        return None
    if windows is None or not len(windows):
        return None
    pixels = np.frombuffer(samples, dtype=np.uint8).copy()
    view = pixels[: width * height * components].reshape(height, width, components)
    fill = np.array([0, 0, 0, 255] if components == 4 else [0] * components, dtype=np.uint8)
    for w in windows:
        x0, y0, x1, y1 = (int(w[n]) for n in ("x0", "y0", "x1", "y1"))
        view[y0:y1, x0:x1] = fill
    return pixels.tobytes()


def black_out(samples: Column, width: Column, height: Column, components: Column, windows: Column) -> Column:
    """Raster samples with pixel windows blackened; null when the raster cannot be repainted.

    Windows that are null, as of a rect off the image, are passed over; without any other the result is null.
    """

    def run(s: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_black_out(*row) for row in zip(s, w, h, c, b)], dtype=object)

    some = F.filter(windows, lambda w: w.isNotNull())
    return F.pandas_udf(run, T.BinaryType())(samples, width, height, components, some)


def redact_shapes(shapes: DataFrame, rects: DataFrame, rect_col: str = "red") -> DataFrame:
    """Shapes any redaction overlaps; shape_id is unique on a page.

    The join on the page alone leaves shapes that are dealt out by page where they are, and only those on a page with a
    redaction go on to the join by position, whose pairs hold the shape, so that shapes are made once.
    """
    pairs = overlap_join(only_pages(shapes, rects), rects.select(*PAGE, rect_col), "rect", rect_col)
    return pairs.drop(rect_col).dropDuplicates([*PAGE, "shape_id"])


def block_ops(blocks: DataFrame, start: str = "q_index", end: str = "end_index") -> DataFrame:
    """Operator indices of whole blocks."""
    return blocks.select(*PAGE, F.explode(F.sequence(F.col(start), F.col(end))).alias("op_index")).distinct()


def run_fallback(runs: DataFrame, rects: DataFrame, rect_col: str = "red") -> DataFrame:
    """Without font resources: every operator of a run whose box a redaction overlaps. Runs carry rect in points."""
    pairs = overlap_join(runs.select(*PAGE, "run_id", "rect", "op_indices"), rects.select(*PAGE, rect_col), "rect", rect_col)
    return pairs.select(*PAGE, F.explode("op_indices").alias("op_index")).distinct()


def cover_rects(rects: DataFrame, slots: DataFrame) -> DataFrame:
    """Opaque rects for the output: one per redaction of a document and slot of that document that shows its page."""
    shown = slots.where(F.col("kind") == "page").select(
        "doc", "slot_id", F.col("pos").alias("output_page"), "source_key", F.col("source_page_index").alias("page_index"))
    blank = slots.where(F.col("kind") == "blank").select(
        "doc", "slot_id", F.col("pos").alias("output_page"), "source_key", F.lit(0).alias("page_index"))
    return rects.join(shown.unionByName(blank), ["doc", *PAGE])


def _split(base: Column, cut: Column) -> Column:
    """Up to four pieces of a rect around a cut: left, right, below, above."""
    bx2, by2 = base["x"] + base["w"], base["y"] + base["h"]
    ix1, iy1 = F.greatest(base["x"], cut["x"]), F.greatest(base["y"], cut["y"])
    ix2, iy2 = F.least(bx2, cut["x"] + cut["w"]), F.least(by2, cut["y"] + cut["h"])
    piece = lambda x1, y1, x2, y2: rect(x1, y1, x2 - x1, y2 - y1)
    pieces = F.filter(
        F.array(
            piece(base["x"], base["y"], ix1, by2), piece(ix2, base["y"], bx2, by2),
            piece(ix1, base["y"], ix2, iy1), piece(ix1, iy2, ix2, by2),
        ),
        lambda p: (p["w"] > EPS) & (p["h"] > EPS),
    )
    apart = ~rects_overlap(base, cut) | (ix2 - ix1 <= EPS) | (iy2 - iy1 <= EPS)
    return F.when(apart, F.array(base)).otherwise(pieces)


def subtract_rects(base: Column, cuts: Column) -> Column:
    """Pieces of a rect outside every cut, as an array of rects."""
    return F.aggregate(cuts, F.array(base), lambda pieces, cut: F.flatten(F.transform(pieces, lambda p: _split(p, cut))))


def page_cuts(annots: DataFrame, rects: DataFrame, keys: Sequence[str], rect_col: str = "red", order: str = "red_id") -> DataFrame:
    """Per annotation the redactions that overlap its rect, in order, as column cuts."""
    pairs = overlap_join(annots.select(*PAGE, *keys, "rect"), rects.select(*PAGE, rect_col, order), "rect", rect_col)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, rect_col))), lambda s: s[rect_col])
    return pairs.groupBy(*PAGE, *keys).agg(ordered.alias("cuts"))


def redact_quads(quads: Column, cuts: Column) -> Column:
    """Highlight quads clipped by the cuts; quads without area vanish."""
    kept = F.filter(F.transform(quads, quad_rect), lambda r: r.isNotNull())
    pieces = F.flatten(F.transform(kept, lambda r: subtract_rects(r, cuts)))
    return F.transform(pieces, rect_to_quad)


def redact_markup(annots: DataFrame) -> DataFrame:
    """Markup annotations with cuts: clipped quads, new box, texts cleared; those left empty go.

    Rows without cuts stay as they are.
    """
    touched = F.size(F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))) > 0
    cut = annots.withColumn("_touched", touched).withColumn(
        "quads", F.when(F.col("_touched"), redact_quads(F.col("quads"), F.col("cuts"))).otherwise(F.col("quads")))
    left = cut.where(~F.col("_touched") | (F.size("quads") > 0))
    b = box_of_rects(F.transform("quads", quad_rect))
    with_box = left.withColumn("_box", b)
    shrunk = rect(F.col("_box.llx"), F.col("_box.lly"), F.col("_box.urx") - F.col("_box.llx"), F.col("_box.ury") - F.col("_box.lly"))
    return with_box.withColumn("rect", F.when(F.col("_touched"), shrunk).otherwise(F.col("rect"))).withColumn(
        "text", F.when(~F.col("_touched"), F.col("text"))).drop("_touched", "_box")


def _inside_interval(a: Column, b: Column, r: Column) -> Column:
    """Part of the segment a to b inside a rect as struct(t0, t1), null when it stays outside."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sides = (
        (-dx, a["x"] - r["x"]), (dx, r["x"] + r["w"] - a["x"]), (-dy, a["y"] - r["y"]), (dy, r["y"] + r["h"] - a["y"]))
    enter = [F.when(p < -EPS, q / p) for p, q in sides]
    leave = [F.when(p > EPS, q / p) for p, q in sides]
    missed = F.lit(False)
    for p, q in sides:
        missed = missed | ((F.abs(p) <= EPS) & (q < 0))
    t0, t1 = F.greatest(F.lit(0.0), *enter), F.least(F.lit(1.0), *leave)
    return F.when(~missed & (t1 - t0 > EPS), F.struct(t0.alias("t0"), t1.alias("t1")))


def _cut_interval(piece: Column, cut: Column) -> Column:
    a, b, c0, c1 = piece["t0"], piece["t1"], cut["t0"], cut["t1"]
    part = lambda lo, hi: F.struct(lo.alias("t0"), hi.alias("t1"))
    none = F.array().cast("array<struct<t0:double,t1:double>>")
    before = F.when(c0 > a + EPS, F.array(part(a, F.greatest(a, c0)))).otherwise(none)
    after = F.when(c1 < b - EPS, F.array(part(F.least(b, c1), b))).otherwise(none)
    apart = cut.isNull() | (c1 <= a + EPS) | (c0 >= b - EPS)
    return F.when(apart, F.array(piece)).otherwise(F.concat(before, after))


def redact_ink(annots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ink with cuts: each segment keeps its parts outside the cuts, grown by half the pen width.

    Changed ink becomes two-point strokes with its text cleared and its rect drawn anew around them; untouched ink
    stays; ink with nothing left or without strokes goes. Rows carry rect, strokes, thickness, text, cuts.
    """
    ids = [*PAGE, *keys]
    cuts = F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))
    pad = F.greatest(F.lit(0.0), F.coalesce("thickness", F.lit(0.0)) / 2)
    wide = annots.withColumn("_cuts", F.transform(cuts, lambda c: expand_rect(c, pad)))
    strokes = wide.where(F.size("_cuts") > 0).select(*ids, "_cuts", F.posexplode("strokes").alias("stroke_no", "stroke"))
    steps = F.when(F.size("stroke") > 1, F.sequence(F.lit(0), F.size("stroke") - 2)).otherwise(F.array().cast("array<int>"))
    segments = strokes.select(*ids, "_cuts", "stroke_no", F.explode(F.transform(steps, lambda i: F.struct(
        i.alias("i"), F.get("stroke", i).alias("a"), F.get("stroke", i + 1).alias("b")))).alias("s"))
    segments = segments.select(*ids, "stroke_no", "s.i", "s.a", "s.b", F.transform("_cuts", lambda c: _inside_interval(F.col("s.a"), F.col("s.b"), c)).alias("_holes"))
    whole = F.array(F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1")))
    visible = F.aggregate("_holes", whole, lambda ps, hole: F.flatten(F.transform(ps, lambda p: _cut_interval(p, hole))))
    segments = segments.withColumn("parts", visible)
    first = F.get("parts", F.lit(0))
    changed = (F.size("parts") != 1) | (first["t0"] > EPS) | (first["t1"] < 1 - EPS)
    along = lambda t: F.struct(
        (F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t).alias("x"), (F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t).alias("y"))
    pieces = F.filter(
        F.transform("parts", lambda p: F.array(along(p["t0"]), along(p["t1"]))),
        lambda s: F.hypot(s[1]["x"] - s[0]["x"], s[1]["y"] - s[0]["y"]) > EPS)
    segments = segments.select(*ids, "stroke_no", "i", changed.alias("changed"), pieces.alias("pieces"))
    kept = segments.groupBy(*ids).agg(
        F.bool_or("changed").alias("_changed"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stroke_no", "i", "pieces"))), lambda s: s["pieces"])).alias("_kept"))
    joined = annots.where("strokes IS NOT NULL").join(kept, ids, "left")
    now = F.coalesce("_changed", F.lit(False))
    left = joined.where(~now | (F.size("_kept") > 0))
    new_rect = pen_rect(F.col("_kept"), F.col("thickness"))
    return (
        left.withColumn("rect", F.when(now, new_rect).otherwise(F.col("rect")))
        .withColumn("text", F.when(~now, F.col("text")))
        .withColumn("strokes", F.when(now, F.col("_kept")).otherwise(F.col("strokes")))
        .withColumn("changed", now)
        .drop("_changed", "_kept")
    )


def pen_rect(strokes: Column, thickness: Column) -> Column:
    """Rect around strokes, grown by half the pen but one point at least; null without points."""
    b = box_of_strokes(strokes, F.greatest(F.lit(1.0), F.coalesce(thickness, F.lit(0.0)) / 2))
    return F.when(b.isNotNull(), rect(b["llx"], b["lly"], b["urx"] - b["llx"], b["ury"] - b["lly"]))


def ink_cuts(annots: DataFrame, rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ink rows with the redactions near their strokes as `cuts`. Their own rect is not asked: it may be null or wrong."""
    drawn = annots.withColumn("rect", pen_rect(F.col("strokes"), F.col("thickness"))).where("rect IS NOT NULL")
    return annots.join(page_cuts(drawn, rects, keys), [*PAGE, *keys], "left")


MARKUP = ("Highlight", "Underline", "StrikeOut", "Squiggly")


def rect_around(rects: Column) -> Column:
    """Rect around an array of rects, of which null ones do not count; null without any."""
    of_box = lambda b: F.when(b.isNotNull(), rect(b["llx"], b["lly"], b["urx"] - b["llx"], b["ury"] - b["lly"]))
    whole = F.transform(F.array(F.filter(rects, lambda r: r.isNotNull())), box_of_rects)
    return F.get(F.transform(whole, of_box), F.lit(0))


def redact_annotations(annots: DataFrame, rects: DataFrame) -> DataFrame:
    """Annotations after redaction: widgets stay, ink and markup are clipped, the rest goes on overlap.

    Annotations carry id, subtype, rect, quads, strokes, thickness, text. Markup is placed by its quads as well as by its
    rect, so that a missing or too small rect hides no text; what has neither stays, as nothing of it can be under a redaction.
    """
    drawn = F.coalesce(F.transform("quads", quad_rect), F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))
    around = rect_around(F.concat(F.array("rect"), drawn))
    placed = annots.withColumn("rect", F.when(F.col("subtype").isin(*MARKUP), around).otherwise(F.col("rect")))
    cuts = page_cuts(placed.where("rect IS NOT NULL"), rects, ["id"])
    joined = annots.join(cuts, [*PAGE, "id"], "left")
    touched = F.coalesce(F.size("cuts") > 0, F.lit(False))
    ink = F.col("subtype") == "Ink"
    markup = F.col("subtype").isin(*MARKUP) & touched
    inked = ink_cuts(annots.where(ink), rects, ["id"])
    plain = joined.where(~ink & ((F.col("subtype") == "Widget") | ~touched))
    columns = annots.columns
    return (
        plain.select(*columns)
        .unionByName(redact_markup(joined.where(~ink & markup)).select(*columns))
        .unionByName(redact_ink(inked, ["id"]).select(*columns))
    )


def redact_new_annotations(annots: DataFrame, rects: DataFrame) -> DataFrame:
    """Annotations of the annotation table (`normalise_annotations`) after redaction, before they are written.

    On a page with a redaction every highlight loses its text, and its quads their parts under redactions and those
    without area; one with no quad left goes. Ink is clipped; a comment goes if a redaction overlaps it. Rows carry id,
    kind, rect, quads, strokes, thickness, text; other kinds go like comments. Pages without redaction stay as they are.
    """
    columns = annots.columns
    marked = annots.join(rects.select(*PAGE).distinct().withColumn("_red", F.lit(True)), PAGE, "left")
    calm, red = marked.where("_red IS NULL"), marked.where("_red").drop("_red")
    highlight, ink = F.col("kind") == "highlight", F.col("kind") == "ink"
    lit = red.where(highlight).withColumn("_rect", F.col("rect")).withColumn("rect", rect_around(F.transform("quads", quad_rect)))
    cut = lit.join(page_cuts(lit.where("rect IS NOT NULL"), rects, ["id"]), [*PAGE, "id"], "left")
    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    clipped = cut.withColumn("quads", redact_quads(F.col("quads"), F.coalesce("cuts", none))).where(F.size("quads") > 0)
    clipped = clipped.withColumn("rect", F.col("_rect")).withColumn("text", F.lit(None).cast("string"))
    other = red.where(~highlight & ~ink)
    hit = page_cuts(other.where("rect IS NOT NULL"), rects, ["id"]).select(*PAGE, "id")
    inked = redact_ink(ink_cuts(red.where(ink), rects, ["id"]), ["id"])
    return (
        calm.select(*columns).unionByName(clipped.select(*columns)).unionByName(inked.select(*columns))
        .unionByName(other.join(hit, [*PAGE, "id"], "left_anti").select(*columns))
    )
