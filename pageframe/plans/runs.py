"""Plans from items to runs, paragraphs and fonts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.functions import script as sc
from pageframe.functions.geometry import js_round, rect
from pageframe.operators import blocks as bl
from pageframe.operators import runs as rn
from pageframe.plans.registry import plan
from pageframe.sources import bridge
from pageframe.sources.bridge import duck

def _view_items(spark, sf):
    df = bridge.view(spark, sf, "view_items")
    null = F.lit(None).cast("double")
    return df.withColumn("gap_left", null).withColumn("gap_right", null).withColumn("op_indices", F.array("index", F.lit(3)))


def _grouped(spark, sf):
    return rn.group_runs(_view_items(spark, sf))


def _ordered(spark, sf):
    return rn.insert_word_gaps(rn.order_run_items(_grouped(spark, sf)))


_SCRIPT = f"CASE WHEN regexp_matches(str, '[{sc.RTL_SCRIPT_CLASS}]') THEN 'rtl' WHEN regexp_matches(str, '[!-~]') THEN 'ltr' ELSE 'unknown' END"
_GROUPED = rf"""
    i0 AS (SELECT *, {_SCRIPT} AS script, CASE WHEN width = 0 THEN height * 0.3e0 ELSE width END AS w FROM {{view_items}}),
    i1 AS (SELECT *, x + w AS "right", regexp_matches(str, '{sc.LIST_MARKER}') AS marker FROM i0),
    i2 AS (SELECT *, lag(y) OVER p AS py, lag(x) OVER p AS pl, lag("right") OVER p AS pr, lag(script) OVER p AS ps FROM i1
           WINDOW p AS (PARTITION BY source_key, page_index ORDER BY index)),
    i3 AS (SELECT *, coalesce(abs(y - py) >= 24 * 0.3e0, true) AS hard,
           CASE WHEN pr >= x AND "right" >= pl THEN 0 ELSE least(abs(x - pr), abs(pl - "right")) END AS gap FROM i2),
    i4 AS (SELECT *, sum(CAST(hard AS INT)) OVER p AS ln, sum(CASE WHEN hard OR gap >= 36 AND NOT (script <> ps AND gap < 48) THEN 1 ELSE 0 END) OVER p AS seg
           FROM i3 WINDOW p AS (PARTITION BY source_key, page_index ORDER BY index)),
    s1 AS (SELECT source_key, page_index, ln, seg, arg_min(marker, index) AS m, arg_min(script, index) AS sc, count(*) AS n FROM i4 GROUP BY ALL),
    s2 AS (SELECT *, m AND (n > 1 OR coalesce(lead(sc) OVER l = 'rtl', false)) AS eats FROM s1 WINDOW l AS (PARTITION BY source_key, page_index, ln ORDER BY seg)),
    s3 AS (SELECT *, coalesce(bool_or(eats) OVER (PARTITION BY source_key, page_index, ln ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS eaten FROM s2),
    s4 AS (SELECT source_key, page_index, seg, sum(CASE WHEN eaten THEN 0 ELSE 1 END) OVER (PARTITION BY source_key, page_index ORDER BY seg) - 1 AS run_no FROM s3),
    grouped AS (SELECT i4.*, CAST(s4.run_no AS INT) AS run_no FROM i4 JOIN s4 USING (source_key, page_index, seg))"""
_ORDERED = rf"""{_GROUPED},
    g1 AS (SELECT *, bool_or(regexp_matches(str, '[{sc.RTL_RUN_CLASS}]')) OVER (PARTITION BY source_key, page_index, run_no) AS rtl FROM grouped),
    g2 AS (SELECT *, row_number() OVER (PARTITION BY source_key, page_index, run_no ORDER BY CASE WHEN rtl THEN -"right" ELSE x END, -width, index) AS pos FROM g1),
    g3 AS (SELECT *, lag(x) OVER p AS ql, lag("right") OVER p AS qr, lag(script) OVER p AS qs, lag(marker) OVER p AS qm FROM g2
           WINDOW p AS (PARTITION BY source_key, page_index, run_no ORDER BY pos)),
    ordered AS (SELECT *, CAST(CASE WHEN pos = 1 THEN 0 WHEN pos = 2 AND qs = 'ltr' AND script = 'rtl' AND qm
        THEN greatest(1, floor(least(abs(x - qr), abs(ql - "right")) / 6 + 0.5e0)) ELSE 1 END AS INT) AS sp FROM g3)"""


@plan("win_1", duck(f"WITH {_GROUPED} SELECT source_key, page_index, index, run_no FROM grouped"))
def win_1(spark, sf):
    return _grouped(spark, sf).select("source_key", "page_index", "index", "run_no")


@plan("win_2", duck(f"WITH {_ORDERED} SELECT source_key, page_index, run_no, rtl, string_agg(index, ',' ORDER BY pos) AS ids FROM ordered GROUP BY ALL"))
def win_2(spark, sf):
    runs = rn.order_run_items(_grouped(spark, sf))
    ids = F.array_join(F.transform("parts", lambda p: p["index"].cast("string")), ",")
    return runs.select("source_key", "page_index", "run_no", "rtl", ids.alias("ids"))


_TEXT = f"regexp_replace(string_agg(concat(repeat(' ', sp), str), '' ORDER BY pos), '[{sc.SPACE_CLASS}]+([{sc.MARK_CLASS}])', '\\1', 'g')"


@plan("win_3", duck(f"WITH {_ORDERED} SELECT source_key, page_index, run_no, {_TEXT} AS text, CAST(sum(sp) AS BIGINT) AS gaps FROM ordered GROUP BY source_key, page_index, run_no"))
def win_3(spark, sf):
    rows = rn.build_run_rows(_ordered(spark, sf))
    gaps = F.aggregate("spaces", F.lit(0), lambda a, n: a + n).cast("long")
    return rows.select("source_key", "page_index", "run_no", "text", gaps.alias("gaps"))


@plan("win_4", duck(f"""WITH {_ORDERED},
    c AS (SELECT source_key, page_index, run_no, pos, k, sp, substr(str, CAST(k AS INT), 1) AS ch, st + (en - st) * ((k - 1) / length(str)) AS bef, st + (en - st) * (k / length(str)) AS aft
          FROM (SELECT *, CASE WHEN script = 'rtl' THEN "right" ELSE x END AS st, CASE WHEN script = 'rtl' THEN x ELSE "right" END AS en,
                unnest(generate_series(1, length(str))) AS k FROM ordered)),
    e AS (SELECT source_key, page_index, run_no, pos, any_value(sp) AS sp, arg_min(bef, k) AS st, arg_max(aft, k) AS en, arg_min(ch, k) AS c0 FROM c GROUP BY ALL),
    s AS (SELECT *, lag(en) OVER (PARTITION BY source_key, page_index, run_no ORDER BY pos) AS prev_end FROM e),
    u AS (SELECT source_key, page_index, run_no, pos, k, bef, aft FROM c
          UNION ALL SELECT source_key, page_index, run_no, pos, 0, prev_end + (st - prev_end) * ((g - 1) / sp), prev_end + (st - prev_end) * (g / sp)
          FROM (SELECT *, unnest(generate_series(1, sp)) AS g FROM s WHERE prev_end IS NOT NULL) WHERE prev_end IS NOT NULL AND NOT regexp_matches(c0, '[{sc.MARK_CLASS}]'))
    SELECT source_key, page_index, run_no, count(*) AS n, CAST(sum(floor(bef)) AS BIGINT) AS before_sum, CAST(sum(floor(aft)) AS BIGINT) AS after_sum FROM u GROUP BY ALL"""))
def win_4(spark, sf):
    chars = rn.char_edges(_ordered(spark, sf))
    return chars.groupBy("source_key", "page_index", "run_no").agg(
        F.count("*").alias("n"), F.sum(F.floor("before")).alias("before_sum"), F.sum(F.floor("after")).alias("after_sum"))


@plan("agg_1", duck(f"""WITH {_ORDERED}
    SELECT source_key, page_index, concat('p', page_index + 1, '-r', run_no) AS run_id, {_TEXT} AS text, min(x) AS "left",
           greatest(max("right") - min(x), 4) AS width, max(height) AS height, arg_max(y, pos) AS baseline_y,
           string_agg(index, ',' ORDER BY pos) AS item_ids, count(*) + CASE WHEN bool_or(index = 3) THEN 0 ELSE 1 END AS n_ops,
           arg_max(y, pos) - 28.8e0 AS top, 24e0 + 4.8e0 + 2.4e0 AS box_height
    FROM ordered GROUP BY source_key, page_index, run_no"""))
def agg_1(spark, sf):
    rows = rn.build_run_rows(_ordered(spark, sf))
    ids = F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",")
    return rows.select("source_key", "page_index", "run_id", "text", "left", "width", "height", "baseline_y", ids.alias("item_ids"),
                       F.size("op_indices").cast("long").alias("n_ops"), F.round("top", 6).alias("top"), F.round("box_height", 6).alias("box_height"))


_CELLS = """
    cells AS (SELECT DISTINCT a.source_key, a.page_index, a.run_id FROM {para_runs} a JOIN {para_runs} b
        ON a.source_key = b.source_key AND a.page_index = b.page_index AND a.run_id <> b.run_id
        AND abs(a.baseline_y - b.baseline_y) <= 36 * 0.35e0
        AND least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left") < least(a.width, b.width) * 0.8e0)"""
_PARAS = rf"""{_CELLS},
    n AS (SELECT p.*, c.run_id IS NOT NULL AS cell, regexp_matches(text, '{sc.LIST_MARKER_BESIDE_LETTER}') AS is_list,
                 row_number() OVER (PARTITION BY p.source_key, p.page_index ORDER BY run_no) AS pos
          FROM {{para_runs}} p LEFT JOIN cells c ON p.source_key = c.source_key AND p.page_index = c.page_index AND p.run_id = c.run_id),
    r AS (SELECT source_key, page_index, pos, run_no, run_no AS head, "left" AS f_left, is_list AS f_list, font_family AS f_font, bold AS f_bold,
                 font_family, bold, cell, baseline_y FROM n WHERE pos = 1
          UNION ALL
          SELECT n.source_key, n.page_index, n.pos, n.run_no, CASE WHEN j THEN r.head ELSE n.run_no END, CASE WHEN j THEN r.f_left ELSE n."left" END,
                 CASE WHEN j THEN r.f_list ELSE n.is_list END, CASE WHEN j THEN r.f_font ELSE n.font_family END, CASE WHEN j THEN r.f_bold ELSE n.bold END,
                 n.font_family, n.bold, n.cell, n.baseline_y
          FROM r JOIN n ON r.source_key = n.source_key AND r.page_index = n.page_index AND n.pos = r.pos + 1,
          LATERAL (SELECT r.font_family = n.font_family AND r.bold = n.bold AND r.f_font = n.font_family AND r.f_bold = n.bold AND NOT r.cell AND NOT n.cell
                   AND abs(n.baseline_y - r.baseline_y) BETWEEN 36 * 0.65e0 AND 36 * 1.8e0
                   AND abs(n."left" - r.f_left) <= 36 * CASE WHEN r.f_list THEN 8e0 ELSE 1.25e0 END AS j))"""


def _para(spark, sf):
    return bridge.view(spark, sf, "para_runs").withColumn("op_indices", F.array(F.col("run_no") * 2, F.lit(7)))


@plan("join_10", duck(f"WITH {_CELLS} SELECT * FROM cells"))
def join_10(spark, sf):
    return bl.same_row_neighbours(_para(spark, sf))


@plan("win_5", duck(f"WITH RECURSIVE {_PARAS} SELECT source_key, page_index, run_no, head AS block_head FROM r"))
def win_5(spark, sf):
    return bl.group_paragraphs(_para(spark, sf)).select("source_key", "page_index", "run_no", "block_head")


@plan("agg_2", duck(f"""WITH RECURSIVE {_PARAS},
    b AS (SELECT r.source_key, r.page_index, r.head, n.* EXCLUDE (source_key, page_index) FROM r JOIN n ON r.source_key = n.source_key AND r.page_index = n.page_index AND r.run_no = n.run_no),
    a AS (SELECT source_key, page_index, head, count(*) AS k, min("left") AS "left", max("left" + width) AS "right", min(top) AS top, max(top + box_height) AS bottom,
          arg_min(run_id, run_no) AS first_id, bool_and(underline) AS underline, bool_and(strikethrough) AS strikethrough, arg_min(baseline_y, run_no) AS baseline_y,
          string_agg(run_id, ',' ORDER BY run_no) AS run_ids, arg_min("left", run_no) AS first_left, arg_min(font_family, run_no) AS font_family, arg_min(bold, run_no) AS bold FROM b GROUP BY ALL),
    t AS (SELECT b.source_key, b.page_index, b.head, string_agg(concat(repeat(' ', CAST(greatest(0, floor((b."left" - first_left) / (height * 0.25e0) + 0.5e0)) AS INT)), text), chr(10) ORDER BY run_no) AS text,
          string_agg(concat(CAST(b."left" - a."left" AS BIGINT), ':', CAST(b.top - a.top AS BIGINT), ':', CAST(b.width AS BIGINT)), ',' ORDER BY run_no) AS layouts FROM b JOIN a USING (source_key, page_index, head) GROUP BY ALL)
    SELECT source_key, page_index, CASE WHEN k > 1 THEN concat('p', page_index + 1, '-b', row_number() OVER (PARTITION BY source_key, page_index ORDER BY head) - 1) ELSE first_id END AS block_id,
           k > 1 AS is_paragraph, "left", top, CASE WHEN k > 1 THEN greatest("right" - "left", 4) ELSE "right" - "left" END AS width, bottom - top AS height, underline, strikethrough, baseline_y, run_ids,
           text, CASE WHEN k > 1 THEN layouts END AS layouts, font_family, bold
    FROM a JOIN t USING (source_key, page_index, head)"""))
def agg_2(spark, sf):
    made = bl.make_blocks(bl.group_paragraphs(_para(spark, sf)))
    spots = F.transform("line_layouts", lambda x: F.concat_ws(":", *[x[c].cast("bigint").cast("string") for c in ("left", "top", "width")]))
    layouts = F.when(F.col("line_layouts").isNotNull(), F.array_join(spots, ","))
    return made.select("source_key", "page_index", "block_id", "is_paragraph", "left", "top", "width", "height", "underline",
                       "strikethrough", "baseline_y", F.array_join("run_ids", ",").alias("run_ids"), "text", layouts.alias("layouts"), "font_family", "bold")


@plan("agg_3", duck("""
    WITH d AS (SELECT source_key, page_index, abs(baseline_y - lag(baseline_y) OVER (PARTITION BY source_key, page_index ORDER BY run_no)) AS d FROM {para_runs})
    SELECT source_key, page_index, list_sort(list(d) FILTER (d IS NOT NULL))[CAST(floor(count(d) / 2) AS INT) + 1] AS step FROM d GROUP BY ALL"""))
def agg_3(spark, sf):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("run_no", "baseline_y"))), lambda s: s["baseline_y"])
    pages = _para(spark, sf).groupBy("source_key", "page_index").agg(lines.alias("b"))
    return pages.select("source_key", "page_index", bl.median_step(F.col("b")).alias("step"))


@plan("agg_4", duck(rf"""
    WITH n AS (SELECT source_key, page_index, run_no, text, CASE WHEN line_no % 6 = 5 THEN 400e0 ELSE 1000e0 + line_no % 3 * 5e0 END AS w, height, 100e0 + line_no % 2 * 10e0 AS l,
                      line_no // 6 AS blk FROM {{para_runs}}),
    c AS (SELECT *, count(*) OVER b AS k, row_number() OVER (PARTITION BY source_key, page_index, blk ORDER BY run_no) - 1 AS i,
          first_value(regexp_matches(text, '{sc.LIST_MARKER_BESIDE_LETTER}')) OVER (PARTITION BY source_key, page_index, blk ORDER BY run_no) AS fl FROM n WINDOW b AS (PARTITION BY source_key, page_index, blk)),
    d AS (SELECT *, i < k - 1 AND i >= CASE WHEN fl AND k - 1 > 2 THEN 1 ELSE 0 END AS body FROM c),
    e AS (SELECT source_key, page_index, blk, count(*) FILTER (body) >= 2 AND max(l) FILTER (body) - min(l) FILTER (body) <= 18 AND max(l + w) FILTER (body) - min(l + w) FILTER (body) <= 18 AND any_value(k) >= 3 AS ok FROM d GROUP BY ALL)
    SELECT source_key, page_index, run_no, coalesce(body AND ok, false) AS justified FROM d JOIN e USING (source_key, page_index, blk)"""))
def agg_4(spark, sf):
    df = _para(spark, sf)
    line = F.struct("run_no", "text", (F.lit(100.0) + F.col("line_no") % 2 * 10.0).alias("left"),
                    F.when(F.col("line_no") % 6 == 5, 400.0).otherwise(F.lit(1000.0) + F.col("line_no") % 3 * 5.0).alias("width"), "height")
    grouped = df.groupBy("source_key", "page_index", F.floor(F.col("line_no") / 6).alias("blk")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    flags = grouped.withColumn("j", bl.justified_flags(F.col("lines")))
    z = flags.select("source_key", "page_index", F.explode(F.arrays_zip(F.transform("lines", lambda x: x["run_no"]).alias("run_no"), F.col("j").alias("justified"))).alias("z"))
    return z.select("source_key", "page_index", "z.run_no", "z.justified")


def _pdf_items(spark, sf):
    return bridge.items(spark, sf).select("source_key", "page_index", "index", "str", F.col("x").alias("item_x"), F.col("y").alias("item_y"), "width", "height")


@plan("join_2", duck("""
    SELECT s.source_key, s.page_index, s.op_index, arg_min(i.index, (abs(i.x - s.x) + abs(i.y - s.y) * 50) * 1000000000 + i.index) AS item_index
    FROM {shows} s JOIN {items} i ON s.source_key = i.source_key AND s.page_index = i.page_index AND abs(i.y - s.y) <= 6
         AND i.y BETWEEN s.y - 2 AND s.y AND i.x BETWEEN s.x - 400 AND s.x + 400
    GROUP BY ALL"""))
def join_2(spark, sf):
    shows = bridge.view(spark, sf, "shows").select("source_key", "page_index", "op_index", "x", "y")
    return rn.nearest_item_for_show(shows, _pdf_items(spark, sf))


_CLAIMS = """
    dec AS (SELECT source_key, page_index, op_index, floor(x / 40) * 40 AS x, y, concat(str, '!') AS decoded FROM {shows}),
    claims AS (SELECT i.source_key, i.page_index, i.index, arg_min(d.op_index, abs(d.x - i.x) * 1000000000 + d.op_index) AS op_index
        FROM {items} i JOIN dec d ON i.source_key = d.source_key AND i.page_index = d.page_index AND d.y = i.y + 1
        WHERE regexp_matches(i.str, '[!-~]') OR NOT regexp_matches(i.str, '[!-~]') GROUP BY ALL)"""


def _decoded(spark, sf):
    """All shows, drawn from tab stops: several stand at one place, so some are shared and some are claimed by nobody."""
    df = bridge.view(spark, sf, "shows")
    return df.select("source_key", "page_index", "op_index", (F.floor(F.col("x") / 40) * 40.0).alias("x"), "y", F.concat("str", F.lit("!")).alias("decoded"))





@plan("join_3", duck(f"WITH {_CLAIMS} SELECT * FROM claims"))
def join_3(spark, sf):
    return rn.nearest_show_for_item(_pdf_items(spark, sf), _decoded(spark, sf))


@plan("join_4", duck(f"""WITH {_CLAIMS},
    m AS (SELECT d.source_key, d.page_index, d.op_index, d.decoded, d.x, d.y, arg_max(i.index, length(i.str) * 1000000000 - i.index) AS main, min(i.x) AS l, max(i.x + i.width) AS r
          FROM claims c JOIN dec d USING (source_key, page_index, op_index) JOIN {{items}} i USING (source_key, page_index, index) GROUP BY ALL)
    SELECT i.source_key, i.page_index, i.index, CASE WHEN m.main = i.index THEN m.decoded WHEN m.main IS NOT NULL THEN '' ELSE i.str END AS str,
           CASE WHEN m.main = i.index THEN m.l ELSE i.x END AS item_x, CASE WHEN m.main = i.index THEN greatest(m.r - m.l, i.width) ELSE i.width END AS width, 12e0 AS height, c.op_index AS claimed_by
    FROM {{items}} i LEFT JOIN claims c USING (source_key, page_index, index) LEFT JOIN m ON m.source_key = i.source_key AND m.page_index = i.page_index AND m.op_index = c.op_index
    UNION ALL SELECT d.source_key, d.page_index, CAST(d.op_index + 100000000 AS INT), d.decoded, d.x, 0e0, 12e0, d.op_index
    FROM dec d WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.source_key = d.source_key AND c.page_index = d.page_index AND c.op_index = d.op_index)"""))
def join_4(spark, sf):
    items, decoded = _pdf_items(spark, sf), _decoded(spark, sf)
    claims = rn.nearest_show_for_item(items, decoded)
    return rn.claim_shows(items, decoded, claims).select("source_key", "page_index", "index", "str", "item_x", "width", "height", "claimed_by")


@plan("join_5", duck("""
    WITH r AS (SELECT source_key, page_index, run_id, "left" / 2 AS px, (1684 - baseline_y) / 2 AS py, CAST(line_no % 50 AS INT) * 1000000 AS own, line_no FROM {runs}),
    p AS (SELECT r.*, s.op_index, s.base_font, s.bold, s.op_index = r.own OR s.op_index = r.own + 2 AS owned, length(encode(s.str)) AS n, abs(s.x - r.px) + abs(s.y - r.py) * 10 AS dist
          FROM r JOIN {shows} s ON r.source_key = s.source_key AND r.page_index = s.page_index AND s.y = r.py + 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY source_key, page_index, run_id ORDER BY CASE WHEN owned THEN 0 ELSE 1 END, CASE WHEN owned THEN -octet_length(encode('')) - n ELSE 0 END, dist, op_index) AS k FROM p)
    SELECT r.source_key, r.page_index, r.run_id, b.op_index AS show_op, b.base_font, coalesce(b.bold, false) AS bold
    FROM r LEFT JOIN b ON r.source_key = b.source_key AND r.page_index = b.page_index AND r.run_id = b.run_id AND b.k = 1""".replace("length(encode(s.str))", "octet_length(encode(s.str))")))
def join_5(spark, sf):
    runs = bridge.view(spark, sf, "runs").withColumn("own", (F.col("line_no") % 50 * 1_000_000).cast("int"))
    runs = runs.select("source_key", "page_index", "run_id", "text", (F.col("left") / 2).alias("pdf_x"),
                       ((F.lit(1684.0) - F.col("baseline_y")) / 2).alias("pdf_y"), F.array("own", F.col("own") + 2).alias("op_indices"))
    shows = bridge.view(spark, sf, "shows").withColumn("bytes", F.encode("str", "UTF-8"))
    best = rn.attach_font(runs, shows, F.col("base_font").contains("Faruma"))
    return best.select("source_key", "page_index", "run_id", "show_op", "base_font", "bold")


def _shapes(spark, sf):
    df = bridge.view(spark, sf, "shapes")
    return df.select("source_key", "page_index", "shape_id", F.col("q_index").alias("shape_no"), "q_index", "end_index",
                     rect(F.col("sx"), F.col("sy"), F.col("sw"), F.col("sh")).alias("rect"))


def _pdf_runs(spark, sf):
    df = bridge.view(spark, sf, "runs")
    return df.select("source_key", "page_index", "run_id", (F.col("line_no") % 50).alias("run_no"), F.lit(50.0).alias("pdf_left"),
                     (F.col("width") / 2).alias("pdf_width"), ((F.lit(1684.0) - F.col("baseline_y")) / 2).alias("pdf_baseline"), (F.col("height") / 2).alias("size"))


@plan("join_6", duck("""
    WITH o AS (SELECT source_key, page_index, line_no, shape_id, q_index, CASE WHEN tok_no % 2 = 0 THEN 'underline' ELSE 'strike' END AS kind
               FROM {shapes} WHERE sw >= 2 AND sh <= 2.5e0)
    SELECT source_key, page_index, arg_min(shape_id, q_index) AS shape_id, concat('p', page_index + 1, '-r', line_no % 50) AS run_id, kind
    FROM o GROUP BY source_key, page_index, line_no, kind"""))
def join_6(spark, sf):
    """Every rule lies in one line, so the first of each kind in order wins its run."""
    return rn.pair_decorations(_shapes(spark, sf), _pdf_runs(spark, sf)).select("source_key", "page_index", "shape_id", "run_id", "kind")


@plan("join_7", duck("""
    WITH b AS (SELECT source_key, page_index, floor((1684 - baseline_y) / 2 + 0.5e0) AS y0, 200e0 AS x_min, 260e0 AS x_max, 12e0 AS slack FROM {runs} WHERE line_no % 3 = 0)
    SELECT DISTINCT s.source_key, s.page_index, s.op_index FROM {shows} s JOIN b ON s.source_key = b.source_key AND s.page_index = b.page_index
        AND abs(floor(s.y + 0.5e0) - b.y0) <= 1 AND s.x >= b.x_min - b.slack AND s.x <= b.x_max + b.slack"""))
def join_7(spark, sf):
    runs = bridge.view(spark, sf, "runs").where("line_no % 3 = 0")
    boxes = runs.select("source_key", "page_index", js_round((F.lit(1684.0) - F.col("baseline_y")) / 2).alias("y0"),
                        F.lit(200.0).alias("x_min"), F.lit(260.0).alias("x_max"), F.greatest(F.lit(8.0), F.col("height") / 2).alias("slack"))
    return rn.baseline_capture(bridge.view(spark, sf, "shows"), boxes).select("source_key", "page_index", "op_index")


@plan("join_7_fallback", duck("""
    WITH r AS (SELECT source_key, page_index, run_id, 50e0 + line_no % 5 * 20e0 AS px, (1684 - baseline_y) / 2 AS py, 90e0 AS pw, 12e0 AS size FROM {runs} WHERE line_no % 2 = 0)
    SELECT r.source_key, r.page_index, r.run_id, s.op_index FROM r JOIN {shows} s ON s.source_key = r.source_key AND s.page_index = r.page_index
        AND abs(s.y - r.py) <= 4.8e0 AND s.x >= r.px - 3.6e0 AND s.x <= r.px + r.pw + 3.6e0"""))
def join_7_fallback(spark, sf):
    runs = bridge.view(spark, sf, "runs").where("line_no % 2 = 0")
    runs = runs.select("source_key", "page_index", "run_id", (F.lit(50.0) + F.col("line_no") % 5 * 20.0).alias("pdf_x"),
                       ((F.lit(1684.0) - F.col("baseline_y")) / 2).alias("pdf_y"), F.lit(90.0).alias("pdf_width"), (F.col("height") / 2).alias("size"))
    return rn.fallback_capture(bridge.view(spark, sf, "shows"), runs)
