"""Plans over geometry scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.functions import geometry as g
from pageframe.plans.registry import plan
from pageframe.sources import bridge
from pageframe.sources.bridge import duck


def _flat(column, prefix: str, names: str) -> list:
    return [column[n].alias(f"{prefix}{n}") for n in names.split()]


def _images(spark, sf):
    df = bridge.view(spark, sf, "images")
    return df.withColumn("r", g.rect(F.col("ix"), F.col("iy"), F.col("iw"), F.col("ih")))


def _annots(spark, sf):
    df = bridge.view(spark, sf, "annotations")
    return df.withColumn("r", g.rect(F.col("ax"), F.col("ay"), F.col("aw"), F.col("ah")))


@plan("geo_1", duck("""
    SELECT source_key, image_id, ix * 2e0 AS "left", 1684e0 - (iy + ih) * 2e0 AS top, iw * 2e0 AS width,
           ih * 2e0 AS height, 1684e0 - (iy + ih) * 2e0 AS arr_top, iw * 2e0 AS arr_width FROM {images}"""))
def geo_1(spark, sf):
    df = _images(spark, sf)
    scale, view_h = F.lit(2.0), F.lit(1684.0)
    corners = F.array("ix", "iy", F.col("ix") + F.col("iw"), F.col("iy") + F.col("ih"))
    placed = g.pdf_to_viewport(F.col("r"), scale, view_h)
    arr = g.rect_array_to_viewport(corners, scale, view_h)
    return df.select("source_key", "image_id", *_flat(placed, "", "left top width height"),
                     arr["top"].alias("arr_top"), arr["width"].alias("arr_width"))


@plan("geo_5", duck("""
    WITH m AS (SELECT source_key, image_id, iw AS a, 2e0 AS b, CASE WHEN line_no % 6 = 0 THEN 0e0 ELSE 4e0 END AS c,
                      CASE WHEN line_no % 6 = 0 THEN 0e0 ELSE ih END AS d, ix AS e, iy AS f FROM {images}),
    i AS (SELECT *, a * d - b * c AS det FROM m)
    SELECT source_key, image_id, a * 2e0 AS pa, b * 4e0 AS pb, c * 2e0 AS pc, d * 4e0 AS pd, e * 2e0 + 10e0 AS pe,
           f * 4e0 + 20e0 AS pf, a * 3e0 + c * 5e0 + e AS px, b * 3e0 + d * 5e0 + f AS py,
           CASE WHEN abs(det) >= 1e-9 THEN d / det END AS ia, CASE WHEN abs(det) >= 1e-9 THEN (c * f - d * e) / det END AS ie
    FROM i"""))
def geo_5(spark, sf):
    flat = F.col("line_no") % 6 == 0
    m = g.matrix(F.col("iw"), 2, F.when(flat, 0.0).otherwise(4.0), F.when(flat, 0.0).otherwise(F.col("ih")),
                 F.col("ix"), F.col("iy"))
    df = _images(spark, sf).withColumn("m", m)
    product = g.mat_mul(F.col("m"), g.matrix(2, 0, 0, 4, 10, 20))
    point = g.mat_apply(F.col("m"), F.lit(3.0), F.lit(5.0))
    inverse = g.mat_inverse(F.col("m"))
    return df.select("source_key", "image_id", *_flat(product, "p", "a b c d e f"), *_flat(point, "p", "x y"),
                     *_flat(inverse, "i", "a e"))


@plan("geo_6", duck("""
    SELECT source_key, page_index, index, x AS "left", y - 12e0 AS top, width, 12e0 AS height FROM {items}"""))
def geo_6(spark, sf):
    df = bridge.items(spark, sf)
    bounds = g.item_bounds(F.col("x"), F.col("y"), -F.col("height"), F.col("width"))
    return df.select("source_key", "page_index", "index", *_flat(bounds, "", "left top width height"))


@plan("geo_7", duck("""
    WITH p AS (SELECT source_key, image_id, subtype, ix, iy, iw, ih, CASE WHEN line_no % 7 = 0 THEN 0e0 ELSE 1e0 END AS s,
                      CASE WHEN line_no % 8 = 3 THEN 0e0 ELSE 2e0 END AS t FROM {images}),
    q AS (SELECT *, CASE WHEN subtype = 'Form' THEN 42e0 ELSE 1e0 END AS bw, CASE WHEN subtype = 'Form' THEN 47e0 ELSE 1e0 END AS bh,
                 CASE WHEN subtype = 'Form' THEN t ELSE 1e0 END AS k FROM p)
    SELECT source_key, image_id, CASE WHEN ok THEN ix END AS x, CASE WHEN ok THEN iy END AS y, CASE WHEN ok THEN w END AS w,
           CASE WHEN ok THEN h END AS h
    FROM (SELECT *, s > 0 AND w >= 1e-6 AND h >= 1e-6 AS ok FROM (SELECT *, bw * k * s AS w, bh * k * s AS h FROM q))"""))
def geo_7(spark, sf):
    df = _images(spark, sf)
    form = F.col("subtype") == "Form"
    s = F.when(F.col("line_no") % 7 == 0, 0.0).otherwise(1.0)
    t = F.when(F.col("line_no") % 8 == 3, 0.0).otherwise(2.0)
    df = df.select(
        "source_key", "image_id", F.when(form, g.box(0, 0, 42, 47)).alias("bbox"),
        F.when(form, g.matrix(t, 0, 0, t, 0, 0)).alias("inner"),
        g.matrix(s, 0, 0, s, F.col("ix"), F.col("iy")).alias("ctm"))
    df = df.withColumn("p", g.transformed_aabb(F.col("bbox"), F.col("inner"), F.col("ctm")))
    placed = F.col("p")
    return df.select("source_key", "image_id", *_flat(placed, "", "x y w h"))


@plan("geo_8", duck("""
    SELECT source_key, page_index, index, x + 5e0 AS gx, y AS gy, width AS gw, 12e0 AS gh, y - 8e0 - width AS ry,
           x - 12e0 AS rx FROM {items}"""))
def geo_8(spark, sf):
    df = bridge.items(spark, sf)
    df = df.withColumn("m", g.matrix(1, 0, 0, 1, F.col("x"), F.col("y"))).withColumn(
        "n", g.matrix(0, -1, -1, 0, F.col("x"), F.col("y")))
    upright = g.glyph_aabb(F.col("m"), F.lit(5.0), F.col("width") + 5.0, F.lit(12.0))
    turned = g.glyph_aabb(F.col("n"), F.lit(8.0), F.col("width") + 8.0, F.lit(12.0))
    return df.select("source_key", "page_index", "index", *_flat(upright, "g", "x y w h"), *_flat(turned, "r", "y x"))


@plan("geo_9", duck("""
    WITH a AS (SELECT id, CASE WHEN line_no % 2 = 0 THEN ax + aw ELSE ax END AS p, ay AS q,
        CASE WHEN line_no % 2 = 0 THEN ax ELSE ax + aw END AS r,
        CASE WHEN line_no % 5 = 0 THEN ay WHEN line_no % 5 = 1 THEN ay + 5e-7 ELSE ay + ah END AS s,
        line_no % 11 = 0 AS short FROM {annotations})
    SELECT id, CASE WHEN NOT short THEN least(p, r) END AS llx, CASE WHEN NOT short THEN least(q, s) END AS lly,
           CASE WHEN NOT short THEN greatest(p, r) END AS urx, CASE WHEN NOT short THEN greatest(q, s) END AS ury,
           CASE WHEN NOT short AND abs(p - r) > 0 AND abs(q - s) > 0 THEN abs(p - r) END AS form_w,
           CASE WHEN NOT short AND abs(p - r) > 1e-6 AND abs(q - s) > 1e-6 THEN abs(p - r) END AS markup_w,
           CASE WHEN NOT short THEN least(p, r) END AS lenient_llx FROM a"""))
def geo_9(spark, sf):
    df = _annots(spark, sf)
    flip = F.col("line_no") % 2 == 0
    right = F.col("ax") + F.col("aw")
    top = F.when(F.col("line_no") % 5 == 0, F.col("ay")).when(F.col("line_no") % 5 == 1, F.col("ay") + 5e-7).otherwise(
        F.col("ay") + F.col("ah"))
    full = F.array(F.when(flip, right).otherwise(F.col("ax")), F.col("ay"),
                   F.when(flip, F.col("ax")).otherwise(right), top)
    df = df.withColumn("arr", F.when(F.col("line_no") % 11 == 0, F.slice(full, 1, 3)).otherwise(full))
    arr = F.col("arr")
    return df.select("id", *_flat(g.normalise_box(arr), "", "llx lly urx ury"), g.normalise_rect(arr)["w"].alias("form_w"),
                     g.normalise_rect(arr, g.EPS)["w"].alias("markup_w"),
                     g.normalise_box(arr, lenient=True)["llx"].alias("lenient_llx"))


@plan("geo_10", duck("""
    SELECT source_key, page_index, min(ax - pad) AS llx, min(ay - pad) AS lly, max(ax + aw + pad) AS urx,
           max(ay + ah + pad) AS ury, sum(ax * 4 + aw * 2) AS quad_x, sum(ay * 4 + ah * 2) AS quad_y, sum(aw) AS back_w
    FROM (SELECT *, CASE WHEN line_no % 4 = 0 THEN 3e0 ELSE 0e0 END AS pad FROM {annotations})
    GROUP BY source_key, page_index"""))
def geo_10(spark, sf):
    pad = F.when(F.col("line_no") % 4 == 0, 3.0).otherwise(0.0)
    df = _annots(spark, sf).withColumn("big", g.expand_rect(F.col("r"), pad)).withColumn("q", g.rect_to_quad(F.col("r")))
    q = F.col("q")
    totals = df.groupBy("source_key", "page_index").agg(
        F.min("big.x").alias("llx"), F.min("big.y").alias("lly"),
        F.max(F.col("big.x") + F.col("big.w")).alias("urx"), F.max(F.col("big.y") + F.col("big.h")).alias("ury"),
        F.sum(q["x1"] + q["x2"] + q["x3"] + q["x4"]).alias("quad_x"),
        F.sum(q["y1"] + q["y2"] + q["y3"] + q["y4"]).alias("quad_y"), F.sum(g.quad_rect(q)["w"]).alias("back_w"))
    return totals


@plan("geo_11", duck("""
    SELECT id, ax < 250e0 AND ax + aw > 60e0 AND ay < 600e0 AND ay + ah > 100e0 AS hit,
           ax < ax + aw + aw AND ax + aw > ax + aw AND ay < ay + ah AND ay + ah > ay AS edge FROM {annotations}"""))
def geo_11(spark, sf):
    df = _annots(spark, sf)
    beside = g.rect(F.col("ax") + F.col("aw"), F.col("ay"), F.col("aw"), F.col("ah"))
    return df.select("id", g.rects_overlap(F.col("r"), g.rect(60, 100, 190, 500)).alias("hit"),
                     g.rects_overlap(F.col("r"), beside).alias("edge"))


@plan("geo_12", duck("""
    SELECT id, 60e0 <= ax + 0.001e0 AND 100e0 <= ay + 0.001e0 AND 1060e0 >= ax + aw - 0.001e0 AND 600e0 >= ay + ah - 0.001e0
           AS inside, true AS slack FROM {annotations}"""))
def geo_12(spark, sf):
    df = _annots(spark, sf)
    near = g.rect(F.col("ax") + 0.0005, F.col("ay"), F.col("aw") - 0.001, F.col("ah"))
    return df.select("id", g.rect_contains(g.rect(60, 100, 1000, 500), F.col("r")).alias("inside"),
                     g.rect_contains(near, F.col("r")).alias("slack"))


_MARKUP = """
    SELECT source_key, run_id, "left" / 2e0 AS llx, (1684e0 - (baseline_y + height * {b})) / 2e0 AS lly,
           ("left" + width) / 2e0 AS urx, (1684e0 - (baseline_y - height * {a})) / 2e0 AS ury FROM {{runs}}"""


def _markup(spark, sf, extent):
    df = bridge.view(spark, sf, "runs")
    b = g.line_markup_box(F.col("left"), F.col("width"), F.col("baseline_y"), F.col("height"), F.lit(2.0), F.lit(1684.0), extent)
    return df.withColumn("b", b)


@plan("geo_13", duck(_MARKUP.format(a="0.9e0", b="0.4e0")))
def geo_13(spark, sf):
    return _markup(spark, sf, g.HIGHLIGHT_EXTENT).select("source_key", "run_id", *_flat(F.col("b"), "", "llx lly urx ury"))


@plan("geo_14", duck("""
    SELECT id, CASE line_no % 4 WHEN 2 THEN CASE WHEN line_no % 3 = 0 THEN 0e0 ELSE ax - 1e0 END ELSE ax END AS llx,
      CASE line_no % 4 WHEN 2 THEN CASE WHEN line_no % 3 = 0 THEN 0e0 ELSE ay - 1e0 END ELSE ay END AS lly,
      CASE line_no % 4 WHEN 2 THEN CASE WHEN line_no % 3 = 0 THEN 0e0 ELSE ax + aw + 1e0 END ELSE ax + aw END AS urx,
      CASE line_no % 4 WHEN 2 THEN CASE WHEN line_no % 3 = 0 THEN 0e0 ELSE ay + ah + 1e0 END ELSE ay + ah END AS ury
    FROM {annotations} WHERE subtype <> 'Widget'"""))
def geo_14(spark, sf):
    df = _annots(spark, sf).where("subtype <> 'Widget'")
    kind = F.when(F.col("subtype") == "Highlight", "highlight").when(F.col("subtype") == "FreeText", "comment").otherwise("ink")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    far = pt(F.col("ax") + F.col("aw"), F.col("ay") + F.col("ah"))
    stroke = F.array(F.array(pt(F.col("ax"), F.col("ay")), far))
    strokes = F.when(F.col("line_no") % 3 == 0, F.filter(stroke, lambda s: F.lit(False))).otherwise(stroke)
    b = g.annotation_bbox(kind, F.array(g.rect_to_quad(F.col("r"))), F.col("r"), strokes)
    return df.select("id", *_flat(b, "", "llx lly urx ury"))


@plan("geo_15", duck("""
    WITH p AS (SELECT source_key, image_id, (60e0 - ix) / iw AS u0, (700e0 - ix) / iw AS u1, (200e0 - iy) / ih AS v0,
                      (790e0 - iy) / ih AS v1 FROM {images}),
    c AS (SELECT source_key, image_id, greatest(0e0, least(1e0, u0)) AS u0, greatest(0e0, least(1e0, u1)) AS u1,
                 greatest(0e0, least(1e0, v0)) AS v0, greatest(0e0, least(1e0, v1)) AS v1 FROM p)
    SELECT source_key, image_id, CASE WHEN u1 > u0 AND v1 > v0 THEN CAST(floor(u0 * 64) AS INT) END AS x0,
           CASE WHEN u1 > u0 AND v1 > v0 THEN CAST(floor((1 - v1) * 32) AS INT) END AS y0,
           CASE WHEN u1 > u0 AND v1 > v0 THEN CAST(least(64, ceil(u1 * 64)) AS INT) END AS x1,
           CASE WHEN u1 > u0 AND v1 > v0 THEN CAST(least(32, ceil((1 - v0) * 32)) AS INT) END AS y1 FROM c"""))
def geo_15(spark, sf):
    df = _images(spark, sf)
    ctm = g.matrix(F.col("iw"), 0, 0, F.col("ih"), F.col("ix"), F.col("iy"))
    df = df.withColumn("ctm", ctm).withColumn("cut", g.rect(60, 200, 640, 590))
    df = df.withColumn("win", g.redaction_pixel_bounds(F.col("cut"), F.col("ctm"), F.lit(64), F.lit(32)))
    window = F.col("win")
    return df.select("source_key", "image_id", *_flat(window, "", "x0 y0 x1 y1"))


@plan("geo_17", duck("""
    WITH p AS (SELECT *, (line_no % 7) * 4e0 AS dx, CASE WHEN line_no % 2 = 0 THEN 8e0 END AS dy, 64e0 AS dw, iw * 0e0 AS w0 FROM {images})
    SELECT source_key, image_id, (iw + dw / 2e0) / iw AS sx, 1e0 AS sy,
           ix + dx / 2e0 - ix * ((iw + dw / 2e0) / iw) AS e, iy - coalesce(dy, 0e0) / 2e0 - iy AS f FROM p"""))
def geo_17(spark, sf):
    df = _images(spark, sf)
    dy = F.when(F.col("line_no") % 2 == 0, 8.0)
    m = g.image_move_matrix(F.col("r"), (F.col("line_no") % 7) * 4.0, dy, F.lit(64.0), F.lit(None).cast("double"), F.lit(2.0))
    return df.select("source_key", "image_id", m["a"].alias("sx"), m["d"].alias("sy"), m["e"].alias("e"), m["f"].alias("f"))


@plan("geo_24", duck(f"""
    WITH h AS ({_MARKUP.format(a="0.9e0", b="0.4e0")}), d AS ({_MARKUP.format(a="1e0", b="0.5e0")})
    SELECT h.source_key, h.run_id, h.llx AS x1, h.ury AS y1, h.urx AS x4, h.lly AS y4, d.llx AS x, d.lly AS y,
           d.urx - d.llx AS w, d.ury - d.lly AS h
    FROM h JOIN d ON h.source_key = d.source_key AND h.run_id = d.run_id"""))
def geo_24(spark, sf):
    df = bridge.view(spark, sf, "runs")
    args = [F.col(c) for c in ("left", "width", "baseline_y", "height")] + [F.lit(2.0), F.lit(1684.0)]
    quad = g.rect_to_quad(g.box_rect(g.line_markup_box(*args, g.HIGHLIGHT_EXTENT)))
    red = g.box_rect(g.line_markup_box(*args, g.REDACTION_EXTENT))
    return df.select("source_key", "run_id", *_flat(quad, "", "x1 y1 x4 y4"), *_flat(red, "", "x y w h"))
