"""Redaction plans: text, glyphs, images, vectors, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.functions.geometry import matrix, rect, rect_to_quad, redaction_pixel_bounds
from pageframe.operators import content as ct
from pageframe.operators import redact as rd
from pageframe.operators.cmap import decode_both, decode_glyphs, explode_widths, font_fallback_chunks, gap_report, packed_codes, recover_rtl_text, repair_cmap_gaps, sized_shows
from pageframe.operators.grid import overlap_join
from pageframe.plans.registry import plan
from pageframe.session import cut_lineage
from pageframe.sources import bridge
from pageframe.sources.bridge import PII_PATTERN, duck
from pageframe.sources.layout import line_items

PAGE = ["source_key", "page_index"]
_P = PII_PATTERN


def _redacted_pages(spark, sf):
    """Redaction rects, written out once, and the lines of their pages.

    Few pages carry personal data, so pages are chosen before lines are cut into tokens.
    """
    reds = cut_lineage(bridge.redactions(spark, sf))
    lines = bridge.lines(spark, sf)
    pages = reds.select(*PAGE).distinct()
    return reds, lines.join(pages, PAGE, "left_semi")


def _report(rows):
    found = rows.withColumn("spans", rd.pattern_spans(F.col("line"), _P))
    cut = rd.redact_text(found, "line", "spans")
    leaks = F.size(F.filter("spans", lambda s: F.contains(F.col("redacted"), s["text"])))
    return cut.withColumn("leaks", leaks).withColumn("cut_chars", F.aggregate("spans", F.lit(0), lambda a, s: a + s["len"]))


@plan("red_report", duck(f"""
    WITH l AS (SELECT lang, source, line, regexp_extract_all(line, '{_P}') AS spans, string_split_regex(line, '{_P}') AS gaps FROM {{lines}}),
    c AS (SELECT *, list_sum(list_transform(spans, lambda s: length(s))) AS cut,
          list_aggregate(list_transform(gaps, lambda g, i: concat(g, coalesce(repeat('█', length(spans[i])), ''))), 'string_agg', '') AS redacted FROM l)
    SELECT lang, source, count(*) AS lines, count(*) FILTER (len(spans) = 0) AS untouched,
           count(*) FILTER (len(spans) > 0 AND cut < length(line)) AS rewritten, count(*) FILTER (len(spans) > 0 AND cut = length(line)) AS dropped,
           coalesce(CAST(sum(cut) AS BIGINT), 0) AS cut_chars, CAST(sum(len(list_filter(spans, lambda s: contains(redacted, s)))) AS BIGINT) AS leaks FROM c GROUP BY lang, source"""))
def red_report(spark, sf):
    """Lines by plan, characters cut and leaks per language and source; one pass, one small shuffle."""
    done = _report(bridge.lines(spark, sf))
    return done.groupBy("lang", "source").agg(
        F.count("*").alias("lines"), F.count_if(F.col("plan") == "untouched").alias("untouched"),
        F.count_if(F.col("plan") == "rewrite").alias("rewritten"), F.count_if(F.col("plan") == "drop").alias("dropped"),
        F.sum("cut_chars").alias("cut_chars"), F.sum("leaks").alias("leaks"))


@plan("red_3", duck(f"""
    WITH l AS (SELECT doc_id, line_no, line, regexp_extract_all(line, '{_P}') AS spans, string_split_regex(line, '{_P}') AS gaps FROM {{lines}})
    SELECT doc_id, line_no, CASE WHEN len(spans) = 0 THEN 'untouched' WHEN list_sum(list_transform(spans, lambda s: length(s))) = length(line) THEN 'drop' ELSE 'rewrite' END AS plan,
           list_aggregate(list_transform(gaps, lambda g, i: concat(g, coalesce(repeat('█', length(spans[i])), ''))), 'string_agg', '') AS redacted FROM l"""))
def red_3(spark, sf):
    return _report(bridge.lines(spark, sf)).select("doc_id", "line_no", "plan", "redacted")


@plan("red_14", duck(f"""
    WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '{_P}')) AS sentinel FROM {{lines}}),
    r AS (SELECT doc_id, line_no, line FROM {{lines}} WHERE line_no % 7 = 0)
    SELECT r.doc_id, r.line_no, s.sentinel FROM r JOIN s ON r.doc_id = s.doc_id WHERE contains(r.line, s.sentinel)"""))
def red_14(spark, sf):
    """Every seventh line is left unredacted on purpose, so the check has something to find."""
    rows = _report(bridge.lines(spark, sf, F.col("text").rlike(_P)))
    sentinels = rows.select("doc_id", F.explode("spans.text").alias("sentinel"))
    text = F.when(F.col("line_no") % 7 == 0, F.col("line")).otherwise(F.col("redacted"))
    texts = rows.select("doc_id", "line_no", text.alias("text"))
    return rd.leak_check(texts, "text", sentinels, "sentinel", ["doc_id"]).select("doc_id", "line_no", "sentinel")


@plan("red_14_grams", duck("""
    WITH s AS (SELECT DISTINCT lower(p_name) AS sentinel FROM part WHERE length(p_name) > 2 UNION SELECT 'and' UNION SELECT 'thntblere')
    SELECT doc_id, line_no, sentinel FROM {lines}, s WHERE contains(lower(line), sentinel)"""))
def red_14_grams(spark, sf):
    """Sentinels of all kinds of lengths against every line, met on grams."""
    names = bridge.table(spark, sf, "part").select(F.lower("p_name").alias("sentinel")).where(F.length("sentinel") > 2)
    more = spark.createDataFrame([("and",), ("thntblere",)], "sentinel string")
    texts = bridge.lines(spark, sf).select("doc_id", "line_no", F.lower("line").alias("text"))
    return rd.leak_check(texts, "text", names.unionByName(more), "sentinel").select("doc_id", "line_no", "sentinel")


@plan("join_1", duck("""
    SELECT i.source_key, i.page_index, i.index, r.red_id FROM {items} i JOIN {redactions} r ON i.source_key = r.source_key AND i.page_index = r.page_index
    WHERE i.x < r.rx + r.rw AND i.x + i.width > r.rx AND i.y < r.ry + r.rh AND i.y + i.height > r.ry"""))
def join_1(spark, sf):
    reds, lines = _redacted_pages(spark, sf)
    items = line_items(lines).withColumn("rect", rect(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    pairs = overlap_join(items.select(*PAGE, "index", "rect"), reds.select(*PAGE, "red_id", "red"), "rect", "red")
    return pairs.select(*PAGE, "index", "red_id")


def _shows(spark, sf):
    """Each token of a redacted page as a show in a 12 point one-byte font, every seventh in a font that cannot be read."""
    reds, lines = _redacted_pages(spark, sf)
    items = line_items(lines)
    bad = (F.col("tok_no") % 7 == 6) & (F.col("doc_id") % 5 == 0)
    shows = items.select(
        *PAGE, F.col("index").alias("op_index"), "str", F.when(bad, "F9").otherwise("F1").alias("font"), F.lit(12.0).alias("size"),
        F.lit(0.0).alias("tc"), F.lit(0.0).alias("tw"), F.lit(1.0).alias("th"), matrix(1, 0, 0, 1, F.col("x"), F.col("y")).alias("tm"),
        F.array(F.struct(F.encode("str", "ISO-8859-1").alias("bytes"), F.lit(None).cast("double").alias("spacer"))).alias("segments"))
    docs = reds.select("source_key").distinct()
    fonts = docs.select("source_key", F.explode(F.array(
        F.struct(F.lit("F1").alias("font"), F.lit("TrueType").alias("subtype"), F.lit("WinAnsiEncoding").alias("encoding"), F.lit(True).alias("has_widths"), F.lit(500.0).alias("default_width")),
        F.struct(F.lit("F9").alias("font"), F.lit("Type3").alias("subtype"), F.lit("WinAnsiEncoding").alias("encoding"), F.lit(False).alias("has_widths"), F.lit(None).cast("double").alias("default_width")))).alias("f")).select("source_key", "f.*")
    widths = docs.select("source_key", F.lit("F1").alias("font"), F.explode(F.sequence(F.lit(33), F.lit(126))).alias("gid"), F.lit(500.0).alias("width"))
    return reds, cut_lineage(shows), fonts, widths


_GLYPHS = """
    pg AS (SELECT DISTINCT source_key, page_index FROM {redactions}),
    sh AS (SELECT i.*, i.tok_no % 7 = 6 AND i.doc_id % 5 = 0 AS bad FROM {items} i JOIN pg USING (source_key, page_index)),
    ch AS (SELECT source_key, page_index, index, bad, x, y, k, substr(str, CAST(k AS INT), 1) AS c FROM (SELECT *, unnest(generate_series(1, length(str))) AS k FROM sh)),
    gl AS (SELECT c.*, NOT bad AND EXISTS (SELECT 1 FROM {redactions} r WHERE r.source_key = c.source_key AND r.page_index = c.page_index
              AND c.x + (k - 1) * 6 < r.rx + r.rw AND c.x + k * 6 > r.rx AND c.y < r.ry + r.rh AND c.y + 12 > r.ry) AS hit FROM ch c)"""


@plan("red_1", duck(f"""WITH {_GLYPHS}
    SELECT source_key, page_index, index AS op_index, CASE WHEN any_value(bad) THEN 'unsupported' WHEN NOT bool_or(hit) THEN 'untouched' WHEN bool_and(hit) THEN 'drop' ELSE 'rewrite' END AS plan
    FROM gl GROUP BY source_key, page_index, index"""))
def red_1(spark, sf):
    reds, shows, fonts, widths = _shows(spark, sf)
    marked = rd.mark_glyphs(rd.glyph_rows(shows, widths, fonts), reds)
    return rd.redact_glyphs(shows, marked, reds).select(*PAGE, "op_index", "plan")


@plan("red_2", duck(f"""WITH {_GLYPHS},
    g2 AS (SELECT *, CASE WHEN lag(hit) OVER w IS DISTINCT FROM hit THEN 1 ELSE 0 END AS o FROM gl WHERE NOT bad WINDOW w AS (PARTITION BY source_key, page_index, index ORDER BY k)),
    g3 AS (SELECT *, sum(o) OVER (PARTITION BY source_key, page_index, index ORDER BY k) AS st FROM g2),
    st AS (SELECT source_key, page_index, index, st, bool_or(hit) AS hit, CASE WHEN bool_or(hit) THEN CAST(CAST(-count(*) * 500 AS BIGINT) AS VARCHAR)
           ELSE string_agg(printf('%02X', CASE WHEN unicode(c) < 256 THEN unicode(c) ELSE 63 END), '' ORDER BY k) END AS part FROM g3 GROUP BY ALL)
    SELECT source_key, page_index, index AS op_index, string_agg(part, ' ' ORDER BY st) AS items FROM st GROUP BY source_key, page_index, index HAVING bool_or(hit) AND NOT bool_and(hit)"""))
def red_2(spark, sf):
    reds, shows, fonts, widths = _shows(spark, sf)
    marked = cut_lineage(rd.mark_glyphs(rd.glyph_rows(shows, widths, fonts), reds))
    partly = rd.redact_glyphs(shows, marked, reds).where(F.col("plan") == "rewrite").select(*PAGE, "op_index")
    rewritten = rd.rewrite_shows(marked.join(partly, [*PAGE, "op_index"], "left_semi"))
    text = F.array_join(F.transform("items", lambda i: F.coalesce(i["hex"], F.round(i["gap"]).cast("long").cast("string"))), " ")
    return rewritten.select(*PAGE, "op_index", text.alias("items"))


@plan("win_11", duck(f"""WITH {_GLYPHS}
    SELECT source_key, page_index, index AS op_index, max(k) AS glyphs, max(k) * 6e0 AS last_x1, CAST(sum((k - 1) * 6) AS DOUBLE) AS sum_x0 FROM gl WHERE NOT bad GROUP BY ALL"""))
def win_11(spark, sf):
    _, shows, fonts, widths = _shows(spark, sf)
    placed = rd.glyph_rows(shows, widths, fonts).where("supported")
    return placed.groupBy(*PAGE, "op_index").agg(F.count("*").alias("glyphs"), F.max("x1").alias("last_x1"), F.sum("x0").alias("sum_x0"))


def _images(spark, sf):
    df = bridge.view(spark, sf, "images")
    return df.withColumn("rect", rect(F.col("ix"), F.col("iy"), F.col("iw"), F.col("ih")))


@plan("red_4", duck("""
    WITH h AS (SELECT i.source_key, i.page_index, i.image_id, bool_or(rx <= ix + 0.001e0 AND ry <= iy + 0.001e0 AND rx + rw >= ix + iw - 0.001e0 AND ry + rh >= iy + ih - 0.001e0) AS covered, count(*) AS cuts
        FROM {images} i JOIN {redactions} r ON i.source_key = r.source_key AND i.page_index = r.page_index WHERE ix < rx + rw AND ix + iw > rx AND iy < ry + rh AND iy + ih > ry GROUP BY ALL)
    SELECT i.source_key, i.page_index, i.image_id, CASE WHEN q_index IS NULL THEN 'remove_do' WHEN subtype <> 'Image' OR covered THEN 'remove_block' WHEN plain_raster THEN 'repaint' ELSE 'remove_block' END AS action, cuts
    FROM {images} i JOIN h ON i.source_key = h.source_key AND i.page_index = h.page_index AND i.image_id = h.image_id"""))
def red_4(spark, sf):
    done = rd.redact_images(_images(spark, sf), bridge.redactions(spark, sf))
    return done.select(*PAGE, "image_id", "action", F.size("cuts").cast("long").alias("cuts"))


@plan("red_5", duck("""
    SELECT source_key, image_id, 32 * 2 * 3 AS n, 3 * CAST(sum(CASE WHEN px >= x0 AND px < x1 AND py >= y0 AND py < y1 THEN 0 ELSE 200 END) AS BIGINT) AS total
    FROM (SELECT *, unnest(generate_series(0, 63)) % 32 AS px, unnest(generate_series(0, 63)) // 32 AS py FROM (
        SELECT source_key, image_id, line_no % 16 AS x0, line_no % 16 + 9 AS x1, line_no % 2 AS y0, 2 AS y1 FROM {images} WHERE plain_raster)) GROUP BY ALL"""))
def red_5(spark, sf):
    """A 32 x 2 RGB raster per image, one window of it blackened."""
    df = _images(spark, sf).where("plain_raster")
    cut = rect(F.col("ix") + (F.col("line_no") % 16) * F.col("iw") / 32, F.col("iy") + 0.0, F.col("iw") * 9 / 32,
               F.when(F.col("line_no") % 2 == 0, F.col("ih")).otherwise(F.col("ih") / 2))
    df = df.withColumn("ctm", matrix(F.col("iw"), 0, 0, F.col("ih"), F.col("ix"), F.col("iy"))).withColumn("cut", cut)
    df = df.withColumn("win", redaction_pixel_bounds(F.col("cut"), F.col("ctm"), F.lit(32), F.lit(2)))
    samples = F.unhex(F.repeat(F.lit("C8"), 192))
    done = df.withColumn("out", rd.black_out(samples, F.lit(32), F.lit(2), F.lit(3), F.array("win")))
    hexed = F.hex("out")
    lit = F.length(F.regexp_replace(hexed, "00", "")) / 2
    return done.select("source_key", "image_id", F.length("out").alias("n"), (lit * 200).cast("long").alias("total"))


@plan("red_6", duck("""
    WITH h AS (SELECT DISTINCT s.source_key, s.page_index, s.q_index, s.end_index FROM {shapes} s JOIN {redactions} r ON s.source_key = r.source_key AND s.page_index = r.page_index
        WHERE sx < rx + rw AND sx + sw > rx AND sy < ry + rh AND sy + sh > ry)
    SELECT source_key, page_index, unnest(generate_series(q_index, end_index)) AS op_index FROM h"""))
def red_6(spark, sf):
    df = bridge.view(spark, sf, "shapes").withColumn("rect", rect(F.col("sx"), F.col("sy"), F.col("sw"), F.col("sh")))
    reds = cut_lineage(bridge.redactions(spark, sf))
    return rd.block_ops(rd.redact_shapes(df, reds))


def _user_ops(spark, sf):
    """Operator table with operands composed from the event value."""
    df = bridge.view(spark, sf, "ops")
    k, v, op = F.col("k").cast("double"), F.col("dx"), F.col("op")
    two = F.array(k, v)
    nums = (
        F.when(op == "cm", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), k, v)).when(op == "Tm", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), v, k))
        .when(op.isin("Td", "TD", "m", "l"), two).when(op == "re", F.array(k, v, v, k)).when(op.isin("w", "Tc", "TL"), F.array(k)).when(op == "Tf", F.array(v))
        .otherwise(F.array().cast("array<double>")))
    name = F.when(op == "Tf", F.concat(F.lit("F"), F.col("k"))).when(op == "Do", F.concat(F.lit("Im"), F.col("k") % 6))
    return df.select(*PAGE, "op_index", "op", nums.alias("nums"), name.alias("name"))


@plan("win_9", duck("""
    WITH l AS (SELECT source_key, page_index, op_index, op, sum(CASE op WHEN 'q' THEN 1 ELSE -1 END) OVER (PARTITION BY source_key, page_index ORDER BY op_index) AS after FROM {ops} WHERE op IN ('q', 'Q')),
    k AS (SELECT *, CASE op WHEN 'q' THEN after ELSE after + 1 END AS lvl FROM l),
    n AS (SELECT *, lead(op) OVER w AS nop, lead(op_index) OVER w AS nidx FROM k WINDOW w AS (PARTITION BY source_key, page_index, lvl ORDER BY op_index))
    SELECT source_key, page_index, op_index AS q_index, CASE WHEN nop = 'Q' THEN nidx END AS end_index FROM n WHERE op = 'q'"""))
def win_9(spark, sf):
    return ct.match_blocks(_user_ops(spark, sf))


_WALK = """
    o AS (SELECT *, row_number() OVER (PARTITION BY source_key, page_index ORDER BY op_index) AS pos FROM {ops}),
    w AS (SELECT source_key, page_index, 0 AS pos, CAST(NULL AS VARCHAR) AS op, CAST(-1 AS BIGINT) AS op_index,
            {'mx': 0e0, 'my': 0e0, 'lx': 1e0, 'ex': 0e0, 'ey': 0e0, 'font': CAST(NULL AS VARCHAR), 'size': 0e0, 'tc': 0e0, 'tl': 0e0, 'q': CAST(NULL AS BIGINT), 'cm': CAST(NULL AS BIGINT)} AS s,
            [{'mx': 0e0, 'my': 0e0, 'lx': 1e0, 'ex': 0e0, 'ey': 0e0, 'font': CAST(NULL AS VARCHAR), 'size': 0e0, 'tc': 0e0, 'tl': 0e0, 'q': CAST(NULL AS BIGINT), 'cm': CAST(NULL AS BIGINT)}][2:] AS saved
          FROM (SELECT DISTINCT source_key, page_index FROM {ops})
        UNION ALL
        SELECT o.source_key, o.page_index, o.pos, o.op, o.op_index,
            CASE o.op WHEN 'Q' THEN CASE WHEN len(w.saved) > 0 THEN w.saved[len(w.saved)] ELSE w.s END
            ELSE {'mx': CASE o.op WHEN 'cm' THEN w.s.mx + o.k ELSE w.s.mx END, 'my': CASE o.op WHEN 'cm' THEN w.s.my + o.dx ELSE w.s.my END, 'lx': 1e0,
              'ex': CASE o.op WHEN 'BT' THEN 0e0 WHEN 'Tm' THEN o.dx WHEN 'Td' THEN w.s.ex + o.k WHEN 'TD' THEN w.s.ex + o.k ELSE w.s.ex END,
              'ey': CASE o.op WHEN 'BT' THEN 0e0 WHEN 'Tm' THEN CAST(o.k AS DOUBLE) WHEN 'Td' THEN w.s.ey + o.dx WHEN 'TD' THEN w.s.ey + o.dx WHEN 'T*' THEN w.s.ey - w.s.tl ELSE w.s.ey END,
              'font': CASE o.op WHEN 'Tf' THEN concat('F', o.k) ELSE w.s.font END, 'size': CASE o.op WHEN 'Tf' THEN o.dx ELSE w.s.size END,
              'tc': CASE o.op WHEN 'Tc' THEN CAST(o.k AS DOUBLE) ELSE w.s.tc END, 'tl': CASE o.op WHEN 'TL' THEN CAST(o.k AS DOUBLE) WHEN 'TD' THEN -o.dx ELSE w.s.tl END,
              'q': CASE o.op WHEN 'q' THEN o.op_index ELSE w.s.q END, 'cm': CASE o.op WHEN 'q' THEN NULL WHEN 'cm' THEN CASE WHEN w.s.q IS NOT NULL THEN coalesce(w.s.cm, o.op_index) END ELSE w.s.cm END} END,
            CASE o.op WHEN 'q' THEN list_append(w.saved, w.s) WHEN 'Q' THEN w.saved[:len(w.saved) - 1] ELSE w.saved END
        FROM w JOIN o ON o.source_key = w.source_key AND o.page_index = w.page_index AND o.pos = w.pos + 1)"""


def _raw(text: str) -> str:
    """Query text whose braces are DuckDB struct literals; only {ops} is a view."""
    return duck(text)


@plan("win_10", _raw(f"WITH RECURSIVE {_WALK} SELECT source_key, page_index, op_index, op, s.ex AS tx, s.ey AS ty, s.font AS font, s.size AS size, s.tc AS tc, s.tl AS tl FROM w WHERE op IN ('Tj', 'TJ')"))
def win_10(spark, sf):
    states = ct.text_state(_user_ops(spark, sf))
    return states.select(*PAGE, "op_index", "op", F.get("tm", F.lit(4)).alias("tx"), F.get("tm", F.lit(5)).alias("ty"), "font", "size", "tc", "tl")


_POINTS = """
    b AS (SELECT w.*, o.k, o.dx, CASE o.op WHEN 're' THEN least(o.k, o.k + o.dx) ELSE o.k END AS u0, CASE o.op WHEN 're' THEN greatest(o.k, o.k + o.dx) ELSE o.k END AS u1,
                 CASE o.op WHEN 're' THEN least(o.dx, o.dx + o.k) ELSE o.dx END AS v0, CASE o.op WHEN 're' THEN greatest(o.dx, o.dx + o.k) ELSE o.dx END AS v1
          FROM w JOIN o ON o.source_key = w.source_key AND o.page_index = w.page_index AND o.pos = w.pos)"""
_MEMBERS = """
    p AS (SELECT *, coalesce(sum(CASE WHEN op IN ('S', 'f', 'n', 'Q') THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, page_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS path,
                 coalesce(last_value(CASE WHEN op = 'w' THEN k END IGNORE NULLS) OVER (PARTITION BY source_key, page_index ORDER BY pos), 1) AS lw FROM b),
    g AS (SELECT source_key, page_index, path, min(u0 + s.mx) FILTER (op IN ('m', 'l', 're')) AS x0, min(v0 + s.my) FILTER (op IN ('m', 'l', 're')) AS y0, max(u1 + s.mx) FILTER (op IN ('m', 'l', 're')) AS x1,
                 max(v1 + s.my) FILTER (op IN ('m', 'l', 're')) AS y1, max(op_index) FILTER (op IN ('S', 'f')) AS paint_index, max(lw) FILTER (op IN ('S', 'f')) AS lw FROM p GROUP BY ALL)"""


@plan("win_12", duck("""
    WITH RECURSIVE """ + _WALK + """,
""" + _POINTS + ", " + _MEMBERS + """
    SELECT source_key, page_index, paint_index, x0 - greatest(1, lw / 2) AS x, y0 - greatest(1, lw / 2) AS y, x1 - x0 + greatest(1, lw / 2) * 2 AS w, y1 - y0 + greatest(1, lw / 2) * 2 AS h
    FROM g WHERE paint_index IS NOT NULL AND x0 IS NOT NULL"""))
def win_12(spark, sf):
    paths = ct.path_bboxes(ct.path_members(_user_ops(spark, sf)))
    return paths.select(*PAGE, "paint_index", "rect.x", "rect.y", "rect.w", "rect.h")


@plan("win_13_images", duck("WITH RECURSIVE " + _WALK + """,
    d AS (SELECT w.source_key, w.page_index, w.op_index, w.s, o.k % 6 AS im FROM w JOIN o ON o.source_key = w.source_key AND o.page_index = w.page_index AND o.pos = w.pos WHERE w.op = 'Do' AND o.k % 6 <> 5)
    SELECT source_key, page_index, concat('p', page_index + 1, '-i', row_number() OVER (PARTITION BY source_key, page_index ORDER BY op_index) - 1) AS image_id, concat('Im', im) AS name,
           op_index AS do_index, s.q AS q_index, s.cm AS cm_index, s.mx AS x, s.my AS y, CASE WHEN im = 4 THEN 42e0 ELSE 1e0 END AS w, CASE WHEN im = 4 THEN 47e0 ELSE 1e0 END AS h FROM d"""))
def win_13_images(spark, sf):
    ops = _user_ops(spark, sf)
    pages = ops.select(*PAGE).distinct()
    n = F.explode(F.sequence(F.lit(0), F.lit(5)))
    named = pages.select(*PAGE, n.alias("n"))
    box = F.struct(F.lit(0.0).alias("llx"), F.lit(0.0).alias("lly"), F.lit(42.0).alias("urx"), F.lit(47.0).alias("ury"))
    xobjects = named.select(*PAGE, F.concat(F.lit("Im"), "n").alias("name"), F.when(F.col("n") == 4, "Form").when(F.col("n") == 5, "Unknown").otherwise("Image").alias("subtype"),
                            box.alias("bbox"), matrix(1, 0, 0, 1, 0, 0).alias("matrix"))
    placed = ct.image_placements(ops, xobjects)
    return placed.select(*PAGE, "image_id", "name", "do_index", "q_index", "cm_index", "rect.x", "rect.y", "rect.w", "rect.h")


@plan("win_13_shapes", duck("WITH RECURSIVE " + _WALK + ", " + _POINTS + """,
    x AS (SELECT *, len(saved) AS dep, s.q AS q, last_value(CASE WHEN op = 'q' AND len(saved) = 1 THEN op_index END IGNORE NULLS) OVER (PARTITION BY source_key, page_index ORDER BY pos) AS outer_q FROM b),
    y AS (SELECT *, coalesce(sum(CASE WHEN op IN ('S', 'f', 'n') THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, page_index, q ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS path FROM x WHERE dep > 0),
    a AS (SELECT source_key, page_index, outer_q, q, path, min(u0 + s.mx) FILTER (op IN ('m', 'l', 're')) AS x0, min(v0 + s.my) FILTER (op IN ('m', 'l', 're')) AS y0, max(u1 + s.mx) FILTER (op IN ('m', 'l', 're')) AS x1,
                 max(v1 + s.my) FILTER (op IN ('m', 'l', 're')) AS y1, bool_or(op IN ('S', 'f')) AS paint, bool_or(op IN ('BT', 'Do')) AS other FROM y GROUP BY source_key, page_index, outer_q, q, path),
    k AS (SELECT source_key, page_index, outer_q, min(x0) FILTER (paint) AS x0, min(y0) FILTER (paint) AS y0, max(x1) FILTER (paint) AS x1, max(y1) FILTER (paint) AS y1, bool_or(paint) AS paint, bool_or(other) AS other FROM a GROUP BY ALL),
    e AS (SELECT source_key, page_index, outer_q, min(op_index) AS end_index FROM x WHERE op = 'Q' AND dep = 0 AND outer_q IS NOT NULL GROUP BY ALL),
    z AS (SELECT k.*, end_index, x1 - x0 AS bw, y1 - y0 AS bh FROM k JOIN e USING (source_key, page_index, outer_q) WHERE paint AND NOT other AND x0 IS NOT NULL)
    SELECT source_key, page_index, concat('p', page_index + 1, '-s', row_number() OVER (PARTITION BY source_key, page_index ORDER BY end_index) - 1) AS shape_id, outer_q AS q_index, end_index,
        CASE WHEN bw > 0.01 THEN x0 WHEN bh > 0.01 THEN x0 - 0.5e0 ELSE (x0 + x1) / 2 - 1 END AS x, CASE WHEN bh > 0.01 THEN y0 WHEN bw > 0.01 THEN y0 - 0.5e0 ELSE (y0 + y1) / 2 - 1 END AS y,
        CASE WHEN bw > 0.01 THEN bw WHEN bh > 0.01 THEN 1e0 ELSE 2e0 END AS w, CASE WHEN bh > 0.01 THEN bh WHEN bw > 0.01 THEN 1e0 ELSE 2e0 END AS h FROM z"""))
def win_13_shapes(spark, sf):
    shapes = ct.shape_blocks(_user_ops(spark, sf))
    return shapes.select(*PAGE, "shape_id", "q_index", "end_index", "rect.x", "rect.y", "rect.w", "rect.h")


@plan("red_6_paths", duck("WITH RECURSIVE " + _WALK + ", " + _POINTS + ", " + _MEMBERS + """,
    h AS (SELECT source_key, page_index, path FROM g WHERE paint_index IS NOT NULL AND x0 IS NOT NULL AND x0 - greatest(1, lw / 2) < 4000 AND x1 + greatest(1, lw / 2) > 0
          AND y0 - greatest(1, lw / 2) < 50 AND y1 + greatest(1, lw / 2) > 20)
    SELECT p.source_key, p.page_index, p.op_index FROM p JOIN h USING (source_key, page_index, path) WHERE p.op IN ('m', 'l', 're', 'S', 'f')"""))
def red_6_paths(spark, sf):
    """Painted paths under a band across every page."""
    members = cut_lineage(ct.path_members(_user_ops(spark, sf)))
    paths = ct.path_bboxes(members)
    band = paths.select(*PAGE).distinct().select(*PAGE, rect(0, 20, 4000, 30).alias("red"))
    hit = overlap_join(paths, band, "rect", "red")
    return ct.path_ops(members, hit.select(*PAGE, "path_no").distinct())


@plan("red_7", duck("""
    WITH r AS (SELECT i.source_key, i.page_index, i.image_id, ix, iy, iw, ih, rx, ry, rw, rh, count(*) OVER (PARTITION BY i.source_key, i.page_index, i.image_id) AS n
        FROM {images} i JOIN {redactions} r ON i.source_key = r.source_key AND i.page_index = r.page_index WHERE ix < rx + rw AND ix + iw > rx AND iy < ry + rh AND iy + ih > ry),
    a AS (SELECT *, (least(ix + iw, rx + rw) - greatest(ix, rx)) * (least(iy + ih, ry + rh) - greatest(iy, ry)) AS lost FROM r)
    SELECT source_key, page_index, image_id, any_value(iw * ih) - sum(lost) AS area, any_value(n) AS cuts FROM a GROUP BY source_key, page_index, image_id"""))
def red_7(spark, sf):
    """Redactions never overlap each other here, so pieces and cuts add up to the image."""
    images, reds = _images(spark, sf), bridge.redactions(spark, sf)
    cuts = rd.page_cuts(images, reds, ["image_id"])
    done = images.join(cuts, [*PAGE, "image_id"]).withColumn("pieces", rd.subtract_rects(F.col("rect"), F.col("cuts")))
    area = F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["w"] * p["h"])
    return done.select(*PAGE, "image_id", area.alias("area"), F.size("cuts").cast("long").alias("cuts"))


def _annots(spark, sf):
    df = bridge.view(spark, sf, "annotations")
    r = rect(F.col("ax"), F.col("ay"), F.col("aw"), F.col("ah"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mid = F.col("ay") + 7.0
    stroke = F.array(pt(F.col("ax"), mid), pt(F.col("ax") + F.col("aw"), mid))
    df = df.withColumn("rect", r)
    return df.select(*PAGE, "id", "subtype", "rect", F.array(rect_to_quad(F.col("rect"))).alias("quads"), F.array(stroke).alias("strokes"),
                     F.lit(2.0).alias("thickness"), F.col("contents").alias("text"))


_CUTS = """
    c AS (SELECT a.id, a.subtype, a.ax, a.ay, a.aw, a.ah, r.red_id, greatest(rx, ax) AS l, least(rx + rw, ax + aw) AS h, greatest(rx - 1, ax) AS il, least(rx + rw + 1, ax + aw) AS ihi FROM {annotations} a JOIN {redactions} r
        ON a.source_key = r.source_key AND a.page_index = r.page_index WHERE ax < rx + rw AND ax + aw > rx AND ay < ry + rh AND ay + ah > ry)"""


@plan("red_8", duck(f"""WITH {_CUTS},
    k AS (SELECT id, sum((h - l) * 10) AS lost, any_value(aw * ah) AS area FROM c WHERE subtype = 'Highlight' GROUP BY id)
    SELECT a.id, coalesce(k.area - k.lost, a.aw * a.ah) AS area, CASE WHEN k.id IS NULL THEN contents END AS text
    FROM {{annotations}} a LEFT JOIN k ON a.id = k.id WHERE a.subtype = 'Highlight' AND coalesce(k.area - k.lost, 1) > 1e-6"""))
def red_8(spark, sf):
    annots, reds = _annots(spark, sf).where("subtype = 'Highlight'"), bridge.redactions(spark, sf)
    done = rd.redact_markup(annots.join(rd.page_cuts(annots, reds, ["id"]), [*PAGE, "id"], "left"))
    area = F.aggregate("quads", F.lit(0.0), lambda a, q: a + (q["x2"] - q["x1"]) * (q["y1"] - q["y3"]))
    return done.select("id", area.alias("area"), "text")


@plan("red_9", duck(f"""WITH {_CUTS},
    k AS (SELECT id, sum(ihi - il) AS lost, any_value(aw) AS w FROM c WHERE subtype = 'Ink' GROUP BY id)
    SELECT a.id, coalesce(k.w - k.lost, a.aw) AS pen, k.id IS NOT NULL AS changed, CASE WHEN k.id IS NULL THEN contents END AS text FROM {{annotations}} a LEFT JOIN k ON a.id = k.id WHERE a.subtype = 'Ink' AND coalesce(k.w - k.lost, 1) > 1e-6"""))
def red_9(spark, sf):
    annots, reds = _annots(spark, sf).where("subtype = 'Ink'"), bridge.redactions(spark, sf)
    done = rd.redact_ink(rd.ink_cuts(annots.withColumn("rect", F.lit(None).cast(annots.schema["rect"].dataType)), reds, ["id"]), ["id"])
    pen = F.aggregate("strokes", F.lit(0.0), lambda a, s: a + F.hypot(s[1]["x"] - s[0]["x"], s[1]["y"] - s[0]["y"]))
    return done.select("id", F.round(pen, 6).alias("pen"), "changed", "text")


@plan("red_10", duck(f"""WITH {_CUTS}, hit AS (SELECT id, sum(h - l) AS lost, sum(ihi - il) AS ink FROM c GROUP BY id)
    SELECT a.id, a.subtype, CASE WHEN hit.id IS NOT NULL AND a.subtype IN ('Highlight', 'Ink') THEN NULL ELSE contents END AS text FROM {{annotations}} a LEFT JOIN hit ON a.id = hit.id
    WHERE a.subtype = 'Widget' OR hit.id IS NULL OR (a.subtype = 'Ink' AND a.aw - hit.ink > 1e-6) OR a.subtype = 'Highlight'"""))
def red_10(spark, sf):
    """Every other highlight comes without a rect and is found by its quads."""
    annots = _annots(spark, sf)
    annots = annots.withColumn("rect", F.when((F.col("subtype") != "Highlight") | (F.crc32("id") % 2 == 0), F.col("rect")))
    done = rd.redact_annotations(annots, bridge.redactions(spark, sf))
    return done.select("id", "subtype", "text")


@plan("red_10_new", duck(f"""WITH {_CUTS}, hit AS (SELECT id, sum((h - l) * 10) AS lost, sum(ihi - il) AS ink FROM c GROUP BY id), red AS (SELECT DISTINCT source_key, page_index FROM {{redactions}}),
    k AS (SELECT a.*, red.page_index IS NOT NULL AS red, hit.id IS NOT NULL AS hit, coalesce(lost, 0) AS lost, coalesce(ink, 0) AS ink FROM {{annotations}} a LEFT JOIN hit ON a.id = hit.id
        LEFT JOIN red ON red.source_key = a.source_key AND red.page_index = a.page_index)
    SELECT id, CASE WHEN subtype = 'Highlight' THEN round(aw * ah - lost, 6) WHEN subtype = 'Ink' THEN round(aw - ink, 6) END AS left_over, CASE WHEN (subtype = 'Highlight' AND red) OR (subtype = 'Ink' AND hit) THEN NULL ELSE contents END AS text
    FROM k WHERE CASE subtype WHEN 'Highlight' THEN aw * ah - lost > 1e-6 WHEN 'Ink' THEN aw - ink > 1e-6 ELSE NOT hit END"""))
def red_10_new(spark, sf):
    """The annotations as an editor has them: highlights and ink without a rect."""
    kind = F.when(F.col("subtype") == "Highlight", "highlight").when(F.col("subtype") == "Ink", "ink").otherwise("comment")
    annots = _annots(spark, sf).withColumn("kind", kind).withColumn("rect", F.when(F.col("kind") == "comment", F.col("rect")))
    done = rd.redact_new_annotations(annots, bridge.redactions(spark, sf))
    area = F.aggregate("quads", F.lit(0.0), lambda a, q: a + (q["x2"] - q["x1"]) * (q["y1"] - q["y3"]))
    pen = F.aggregate("strokes", F.lit(0.0), lambda a, s: a + F.hypot(s[1]["x"] - s[0]["x"], s[1]["y"] - s[0]["y"]))
    return done.select("id", F.when(F.col("kind") == "highlight", F.round(area, 6)).when(F.col("kind") == "ink", F.round(pen, 6)).alias("left_over"), "text")


@plan("red_12", duck("""
    SELECT DISTINCT r.source_key, r.page_index, CAST(unnest([r.line_no % 50, r.line_no % 50 + 100]) AS INT) AS op_index FROM {runs} r JOIN {redactions} d ON r.source_key = d.source_key AND r.page_index = d.page_index
    WHERE r."left" / 2 < rx + rw AND (r."left" + r.width) / 2 > rx AND (1684 - r.top - 36) / 2 < ry + rh AND (1684 - r.top) / 2 > ry"""))
def red_12(spark, sf):
    runs = bridge.view(spark, sf, "runs")
    box = rect(F.col("left") / 2, (F.lit(1684.0) - F.col("top") - F.col("box_height")) / 2, F.col("width") / 2, F.col("box_height") / 2)
    n = (F.col("line_no") % 50).cast("int")
    return rd.run_fallback(runs.select(*PAGE, "run_id", box.alias("rect"), F.array(n, n + 100).alias("op_indices")), bridge.redactions(spark, sf))


@plan("red_13", duck("""
    WITH s AS (SELECT doc, slot_id, pos, kind, source_key, source_page_index AS pg FROM {slots}),
    r AS (SELECT conv_id AS doc, concat('redact-', conv_id, '-', turn) AS red_id, CASE WHEN turn % 2 = 0 THEN 'primary' ELSE concat('ext:', conv_id % 7) END AS source_key, CAST((turn * 3) % 5 AS INT) AS pg, turn * 10e0 AS x FROM conversations)
    SELECT r.red_id, s.slot_id, s.pos AS output_page, r.x FROM r JOIN s ON r.doc = s.doc AND r.source_key = s.source_key AND r.pg = s.pg"""))
def red_13(spark, sf):
    turns = bridge.table(spark, sf, "conversations")
    reds = turns.select(F.col("conv_id").alias("doc"), F.concat_ws("-", F.lit("redact"), "conv_id", "turn").alias("red_id"),
                        F.when(F.col("turn") % 2 == 0, "primary").otherwise(F.concat(F.lit("ext:"), F.col("conv_id") % 7)).alias("source_key"),
                        ((F.col("turn") * 3) % 5).cast("int").alias("page_index"), (F.col("turn") * 10.0).alias("x"))
    return rd.cover_rects(reds, bridge.view(spark, sf, "slots")).select("red_id", "slot_id", "output_page", "x")


def _cmap(spark, sf):
    parts = bridge.table(spark, sf, "part")
    cid = F.floor(F.col("p_partkey") / 40).cast("int")
    font = (F.col("p_partkey") % 40).cast("int")
    step = F.pmod(F.col("p_partkey") * 7 + F.floor(F.col("p_partkey") / 40), F.lit(9))
    cp = F.when((step == 0) | (step == 4), 32).when(step == 8, 65 + cid % 26).otherwise(1958 + cid % 11)
    return parts.select(font.alias("font"), cid.alias("cid"), cp.cast("int").alias("cp")).where((F.col("font") + F.col("cid")) % 13 != 0)


_CMAP = """
    cm AS (SELECT * FROM (SELECT CAST(p_partkey % 40 AS INT) AS font, CAST(p_partkey // 40 AS INT) AS cid,
        CAST(CASE (p_partkey * 7 + p_partkey // 40) % 9 WHEN 0 THEN 32 WHEN 4 THEN 32 WHEN 8 THEN 65 + (p_partkey // 40) % 26 ELSE 1958 + (p_partkey // 40) % 11 END AS INT) AS cp FROM part) WHERE (font + cid) % 13 <> 0)"""
_NEIGHBOURS = """
    nb AS (SELECT c.font, c.cid, c.cp, p.cp AS prev_cp, n.cp AS next_cp FROM cm c LEFT JOIN cm p ON p.font = c.font AND p.cid = c.cid - 1 LEFT JOIN cm n ON n.font = c.font AND n.cid = c.cid + 1)"""


@plan("win_6", f"""WITH RECURSIVE {_CMAP}, {_NEIGHBOURS},
    o AS (SELECT *, row_number() OVER (PARTITION BY font ORDER BY cid) AS pos FROM nb),
    r AS (SELECT font, cid, cp, pos, CAST(CASE WHEN cp <> 32 THEN cp WHEN next_cp BETWEEN 1959 AND 1968 THEN next_cp - 1 ELSE cp END AS INT) AS fixed FROM o WHERE pos = 1
          UNION ALL SELECT o.font, o.cid, o.cp, o.pos, CAST(CASE WHEN o.cp <> 32 THEN o.cp WHEN r.cid = o.cid - 1 AND r.fixed BETWEEN 1958 AND 1967 THEN r.fixed + 1
              WHEN o.next_cp BETWEEN 1959 AND 1968 THEN o.next_cp - 1 ELSE o.cp END AS INT) FROM r JOIN o ON o.font = r.font AND o.pos = r.pos + 1)
    SELECT font, cid, fixed AS cp FROM r""")
def win_6(spark, sf):
    return repair_cmap_gaps(_cmap(spark, sf), ["font"])


@plan("qa_2", f"WITH {_CMAP}, {_NEIGHBOURS} SELECT font, cid, prev_cp, next_cp FROM nb WHERE cp = 32")
def qa_2(spark, sf):
    return gap_report(_cmap(spark, sf), ["font"])


def _coded(spark, sf):
    """Tokens as shows: two-byte Thaana codes for half of the documents, one byte otherwise, where other letters become a mark.

    Lines are dealt out by font, so the tokens made of them lie where their font's map goes.
    """
    wide = F.col("doc_id") % 2 == 0
    df = line_items(bridge.dealt(bridge.lines(spark, sf).withColumn("font", F.when(wide, "F2").otherwise("F1")), "source_key", "font"))
    odd = F.when(F.col("tok_no") % 9 == 8, F.encode(F.lit("x"), "US-ASCII")).otherwise(F.unhex(F.lit("")))
    two = F.concat(F.encode(F.translate("str", "abcdefghij", "ކއެރތޔުިޮޕ"), "UTF-16BE"), odd)
    return df.select(*PAGE, F.col("index").alias("op_index"), "str", "font",
                     F.when(wide, "Identity-H").otherwise("WinAnsiEncoding").alias("encoding"),
                     F.when(wide, two).otherwise(F.encode(F.regexp_replace("str", "[^\\x{0000}-\\x{00FF}]", "?"), "ISO-8859-1")).alias("bytes"), "doc_id", "tok_no")


def _code_map(spark, sf):
    """Per font: codes map to themselves apart from a missing letter."""
    docs = bridge.table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source_key"), "doc_id")
    wide = F.col("doc_id") % 2 == 0
    codes = F.when(wide, F.concat(F.sequence(F.lit(33), F.lit(255)), F.sequence(F.lit(0x780), F.lit(0x7BF)))).otherwise(F.sequence(F.lit(33), F.lit(255)))
    known = F.transform(F.filter(codes, lambda c: c != 122), lambda c: F.struct(c.alias("cid"), c.alias("cp")))
    return docs.select("source_key", F.when(wide, "F2").otherwise("F1").alias("font"), packed_codes(known).alias("packed"))


_T = "translate(str, 'abcdefghij', 'ކއެރތޔުިޮޕ')"
_KNOWN = r"[^!-y{-ÿ\x{0780}-\x{07BF}]"


@plan("join_17", duck(f"""
    WITH d AS (SELECT source_key, page_index, index, CASE WHEN doc_id % 2 = 0 THEN {_T} ELSE regexp_replace(str, '[^\\x{{0000}}-\\x{{00FF}}]', '?', 'g') END AS t, doc_id % 2 = 0 AND tok_no % 9 = 8 AS odd FROM {{items}})
    SELECT source_key, page_index, index AS op_index, CASE WHEN NOT odd AND NOT regexp_matches(t, '{_KNOWN}') THEN t END AS decoded, regexp_replace(t, '{_KNOWN}', '', 'g') AS lenient FROM d"""))
def join_17(spark, sf):
    return decode_both(_coded(spark, sf), _code_map(spark, sf), map_keys=["source_key", "font"])


@plan("join_18", duck(f"""
    WITH d AS (SELECT source_key, page_index, index, {_T} AS t FROM {{items}} WHERE doc_id % 2 = 0 AND tok_no % 9 <> 8)
    SELECT source_key, page_index, index AS op_index, array_to_string(list_reverse(regexp_extract_all(t, '(?s).')), '') AS decoded FROM d WHERE NOT regexp_matches(t, '{_KNOWN}') AND regexp_matches(t, '[\\x{{0590}}-\\x{{08FF}}]')"""))
def join_18(spark, sf):
    decoded = decode_glyphs(_coded(spark, sf), _code_map(spark, sf), True, map_keys=["source_key", "font"])
    return recover_rtl_text(decoded)


@plan("join_19", duck("""
    SELECT source_key, page_index, index AS op_index, doc_id % 3 <> 2 AS supported, CASE WHEN doc_id % 3 <> 2 THEN length(str) ELSE 1 END AS n,
           CASE WHEN doc_id % 3 <> 2 THEN CAST(list_sum(list_transform(string_split(str, ''), lambda c: CASE WHEN unicode(c) BETWEEN 97 AND 109 THEN unicode(c) + 400 WHEN unicode(c) BETWEEN 110 AND 122 THEN 700 ELSE CASE WHEN doc_id % 3 = 0 THEN 250 ELSE 0 END END)) AS DOUBLE) END AS total FROM {items}"""))
def join_19(spark, sf):
    """Lines are dealt out by font, as in _coded, and shows are measured and summed in their row."""
    font = F.concat(F.lit("F"), F.col("doc_id") % 3)
    df = line_items(bridge.dealt(bridge.lines(spark, sf).withColumn("font", font), "source_key", "font"))
    shows = df.select(*PAGE, F.col("index").alias("op_index"), "font", F.encode("str", "ISO-8859-1").alias("bytes"))
    docs = bridge.table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source_key"), (F.col("doc_id") % 3).alias("k"))
    fonts = docs.select("source_key", F.concat(F.lit("F"), "k").alias("font"), F.when(F.col("k") == 2, "Type3").otherwise("TrueType").alias("subtype"),
                        F.lit("WinAnsiEncoding").alias("encoding"), F.lit(True).alias("has_widths"), F.when(F.col("k") == 0, 250.0).alias("default_width"))
    entry = F.array(
        F.struct(F.lit(0).alias("position"), F.lit(97).alias("first_code"), F.lit(None).cast("int").alias("last_code"), F.lit(None).cast("double").alias("width"),
                 F.transform(F.sequence(F.lit(97), F.lit(109)), lambda c: c.cast("double") + 400.0).alias("widths")),
        F.struct(F.lit(1).alias("position"), F.lit(110).alias("first_code"), F.lit(122).alias("last_code"), F.lit(700.0).alias("width"), F.lit(None).cast("array<double>").alias("widths")))
    entries = docs.select("source_key", F.concat(F.lit("F"), "k").alias("font"), F.explode(entry).alias("e")).select("source_key", "font", "e.*")
    sized = sized_shows(shows, explode_widths(entries, ["source_key", "font"]), fonts)
    total = F.aggregate("glyphs", F.lit(0.0), lambda a, g: a + g["width"])
    return sized.select(*PAGE, "op_index", "supported", F.size("glyphs").cast("long").alias("n"), total.alias("total"))


@plan("join_20", duck(r"""
    WITH t AS (SELECT doc_id, line_no, unnest(string_split(line, '')) AS ch, generate_subscripts(string_split(line, ''), 1) AS pos FROM {lines}),
    f AS (SELECT *, CASE WHEN regexp_matches(ch, '[a-zA-Z]') THEN 'primary' ELSE 'fallback' END AS font FROM t WHERE ch <> ''),
    o AS (SELECT *, CASE WHEN lag(font) OVER w = font THEN 0 ELSE 1 END AS n FROM f WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS chunk FROM o)
    SELECT doc_id, line_no, CAST(chunk AS BIGINT) AS chunk, any_value(font) AS font, string_agg(ch, '' ORDER BY pos) AS text FROM c GROUP BY doc_id, line_no, chunk"""))
def join_20(spark, sf):
    letters = bridge.table(spark, sf, "region").select(F.explode(F.split(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")).alias("ch"))
    rows = bridge.lines(spark, sf).select("doc_id", "line_no", "line")
    return font_fallback_chunks(rows, letters, ["doc_id", "line_no"], "line")
