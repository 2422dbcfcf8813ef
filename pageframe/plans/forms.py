"""Plans over form trees, object graphs and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.functions.geometry import rect
from pageframe.operators import annotations as an
from pageframe.operators import forms as fm
from pageframe.operators import graph as gr
from pageframe.plans.registry import plan
from pageframe.session import cut_lineage
from pageframe.sources import bridge
from pageframe.sources.bridge import duck

_PATHS = """
    up AS (SELECT source_key AS sk, node_id AS n, node_id AS a, 0 AS d FROM {form_nodes}
        UNION ALL SELECT up.sk, up.n, f.parent_id, up.d + 1 FROM up JOIN {form_nodes} f ON f.source_key = up.sk AND f.node_id = up.a WHERE f.parent_id IS NOT NULL),
    anc AS (SELECT up.sk, up.n, up.a, up.d, f.name, f.ft, f.ff, f.v, f.is_widget FROM up JOIN {form_nodes} f ON f.source_key = up.sk AND f.node_id = up.a),
    inh AS (SELECT sk AS source_key, n AS node_id, arg_min(ft, d) FILTER (ft IS NOT NULL) AS ft, arg_min(a, d) FILTER (ft IS NOT NULL) AS ft_owner, arg_min(ff, d) FILTER (ff IS NOT NULL) AS ff,
                   arg_min(v, d) FILTER (v IS NOT NULL) AS v, coalesce(string_agg(name, '.' ORDER BY d DESC), '') AS full_name, arg_max(a, d) AS top FROM anc GROUP BY sk, n),
    isf AS (SELECT DISTINCT up.sk AS source_key, a AS node_id FROM up JOIN {form_nodes} f ON f.source_key = up.sk AND f.node_id = up.n WHERE f.name IS NOT NULL),
    term AS (SELECT f.source_key, f.node_id FROM {form_nodes} f WHERE ((f.source_key, f.node_id) IN (SELECT (source_key, node_id) FROM isf) OR f.parent_id IS NULL)
        AND NOT EXISTS (SELECT 1 FROM {form_nodes} k JOIN isf ON isf.source_key = k.source_key AND isf.node_id = k.node_id WHERE k.source_key = f.source_key AND k.parent_id = f.node_id)),
    fld AS (SELECT i.*, CASE WHEN ft = 'Tx' THEN 'text' WHEN ft = 'Btn' AND (coalesce(ff, 0) & 65536) <> 0 THEN NULL WHEN ft = 'Btn' AND (coalesce(ff, 0) & 32768) <> 0 THEN 'radio'
        WHEN ft = 'Btn' THEN 'checkbox' WHEN ft = 'Ch' THEN 'choice' WHEN ft = 'Sig' THEN 'signature' END AS kind FROM inh i JOIN term USING (source_key, node_id) WHERE full_name <> '')"""


def _nodes(spark, sf):
    return bridge.view(spark, sf, "form_nodes")


@plan("grf_1", duck("""
    WITH RECURSIVE r AS (SELECT concat('O', o_orderkey) AS node FROM orders WHERE o_orderstatus = 'P' UNION SELECT e.dst FROM r JOIN {edges} e ON e.src = r.node) SELECT node FROM r"""))
def grf_1(spark, sf):
    edges = bridge.view(spark, sf, "edges")
    roots = bridge.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("O"), "o_orderkey").alias("node"))
    return gr.reachable(edges, roots)


@plan("grf_1_unreachable", duck("""
    WITH RECURSIVE r AS (SELECT concat('O', o_orderkey) AS node FROM orders WHERE o_orderstatus = 'P' UNION SELECT e.dst FROM r JOIN {edges} e ON e.src = r.node)
    SELECT DISTINCT n AS node FROM (SELECT src AS n FROM {edges} UNION ALL SELECT dst FROM {edges}) WHERE n NOT IN (SELECT node FROM r)"""))
def grf_1_unreachable(spark, sf):
    edges = bridge.view(spark, sf, "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    roots = bridge.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("O"), "o_orderkey").alias("node"))
    return gr.unreachable(nodes, edges, roots)


@plan("grf_2", duck(f"WITH RECURSIVE {_PATHS} SELECT source_key, node_id, ft, ft_owner, ff, v FROM inh"))
def grf_2(spark, sf):
    return gr.inherit(_nodes(spark, sf), ["ft", "ff", "v"]).select("source_key", "node_id", "ft", "ft_owner", "ff", "v")


@plan("grf_3", duck(f"WITH RECURSIVE {_PATHS} SELECT source_key, node_id, full_name FROM inh"))
def grf_3(spark, sf):
    return gr.qualified_name(_nodes(spark, sf))


@plan("grf_4", duck(f"WITH RECURSIVE {_PATHS} SELECT source_key, node_id, full_name FROM inh JOIN term USING (source_key, node_id) WHERE full_name <> ''"))
def grf_4(spark, sf):
    return gr.terminal_fields(_nodes(spark, sf)).select("source_key", "node_id", "full_name")


@plan("grf_5", duck(f"WITH RECURSIVE {_PATHS} SELECT source_key, node_id, top FROM inh"))
def grf_5(spark, sf):
    return gr.top_ancestor(_nodes(spark, sf))


@plan("grf_6", duck(f"""WITH RECURSIVE {_PATHS},
    s AS (SELECT DISTINCT sk, n FROM up WHERE (sk = 'form' AND a LIKE 'N1%') OR a LIKE 'C%7')
    SELECT f.source_key, f.node_id, CASE WHEN s.n IS NULL THEN f.v END AS v, s.n IS NOT NULL AS scrubbed FROM {{form_nodes}} f LEFT JOIN s ON s.sk = f.source_key AND s.n = f.node_id"""))
def grf_6(spark, sf):
    nodes = _nodes(spark, sf)
    roots = nodes.where((F.col("node_id").like("N1%") & (F.col("source_key") == "form")) | F.col("node_id").like("C%7"))
    return gr.scrub_tree(nodes, roots).select("source_key", "node_id", "v", "scrubbed")


@plan("frm_1", duck(f"""WITH RECURSIVE {_PATHS}
    SELECT source_key, node_id, full_name, kind, (coalesce(ff, 0) & 1) <> 0 AS read_only, (coalesce(ff, 0) & 2) <> 0 AS required, CASE WHEN kind = 'text' THEN (coalesce(ff, 0) & 4096) <> 0 END AS multiline,
           CASE WHEN kind = 'choice' THEN (coalesce(ff, 0) & 131072) <> 0 END AS combo, CASE WHEN kind = 'choice' THEN (coalesce(ff, 0) & 2097152) <> 0 END AS multi_select FROM fld WHERE kind IS NOT NULL"""))
def frm_1(spark, sf):
    return fm.flatten_fields(_nodes(spark, sf)).select("source_key", "node_id", "full_name", "kind", "read_only", "required", "multiline", "combo", "multi_select")


@plan("frm_2", duck(f"""WITH RECURSIVE {_PATHS}
    SELECT source_key, node_id, CASE WHEN kind = 'text' THEN coalesce(v, '') END AS text, CASE WHEN kind = 'checkbox' THEN coalesce(v, 'Off') <> 'Off' END AS checked, CASE WHEN kind = 'radio' AND v <> 'Off' THEN v END AS radio,
           CASE WHEN kind = 'choice' THEN coalesce(v, '') END AS chosen FROM fld WHERE kind IS NOT NULL"""))
def frm_2(spark, sf):
    fields = fm.flatten_fields(_nodes(spark, sf)).withColumn("val", fm.field_values(F.col("kind"), F.col("v")))
    return fields.select("source_key", "node_id", "val.text", "val.checked", "val.radio", F.array_join("val.chosen", ",").alias("chosen"))


@plan("frm_3", """
    WITH o AS (SELECT p_partkey, p_brand, p_type, p_partkey % 3 AS k FROM part)
    SELECT p_partkey AS field, 0 AS position, p_brand AS value, p_brand AS label FROM o
    UNION ALL SELECT p_partkey, 1, p_type, CASE WHEN k = 0 THEN p_type ELSE concat('Label ', p_type) END FROM o""")
def frm_3(spark, sf):
    parts = bridge.table(spark, sf, "part")
    label = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("Label "), "p_type"))
    rows = parts.select(F.col("p_partkey").alias("field"), F.array(F.array("p_brand"), F.array(F.col("p_type"), label), F.array().cast("array<string>")).alias("options"))
    return fm.choice_options(rows, ["field"])


@plan("frm_4", """
    SELECT o_orderkey AS widget, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'On' END AS on_state, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'On' ELSE 'Yes' END AS box_state
    FROM orders WHERE o_orderkey % 4 < 2""")
def frm_4(spark, sf):
    k = F.col("o_orderkey") % 4
    states = F.when(k == 0, F.array(F.lit("Off"), F.col("o_orderpriority"), F.lit("On"))).when(k == 1, F.array(F.lit(""), F.lit("On"))).when(
        k == 2, F.array(F.lit("Off"))).otherwise(F.array().cast("array<string>"))
    rows = bridge.table(spark, sf, "orders").select(F.col("o_orderkey").alias("widget"), states.alias("states"))
    return fm.radio_options(rows).select("widget", "on_state", fm.checkbox_on_state(F.col("states")).alias("box_state"))


@plan("frm_5", """
    WITH f AS (SELECT c_custkey AS n, c_custkey % 4 AS k, c_name, c_mktsegment, c_custkey % 3 AS c FROM customer)
    SELECT n, CASE k WHEN 0 THEN CASE WHEN c = 0 THEN 'ދިވެހި' ELSE c_name END WHEN 1 THEN CASE WHEN c = 0 THEN 'On' ELSE 'Off' END WHEN 2 THEN CASE WHEN c = 0 THEN 'Off' ELSE c_mktsegment END
        ELSE CASE c WHEN 0 THEN NULL WHEN 1 THEN 'BUILDING' ELSE concat('MACHINERY', chr(10), 'BUILDING') END END AS v,
        CASE WHEN k = 0 THEN CASE WHEN c = 0 THEN 2 ELSE 0 END END AS q, CASE WHEN k = 3 THEN CASE c WHEN 1 THEN '0' WHEN 2 THEN '0,2' END END AS indices FROM f""")
def frm_5(spark, sf):
    c = F.col("c_custkey") % 3
    k = F.col("c_custkey") % 4
    none = F.array().cast("array<string>")
    chosen = F.when(k == 2, F.when(c == 0, none).otherwise(F.array("c_mktsegment"))).otherwise(
        F.when(c == 0, none).when(c == 1, F.array(F.lit("BUILDING"))).otherwise(F.array(F.lit("MACHINERY"), F.lit("BUILDING"))))
    rows = bridge.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("n"), F.element_at(F.array(F.lit("text"), F.lit("checkbox"), F.lit("radio"), F.lit("choice")), (k + 1).cast("int")).alias("kind"),
        F.when(c == 0, "ދިވެހި").otherwise(F.col("c_name")).alias("text"), (c == 0).alias("checked"), chosen.alias("chosen"), F.lit("On").alias("on_state"),
        F.array(F.lit("BUILDING"), F.lit("FURNITURE"), F.lit("MACHINERY")).alias("options"))
    done = fm.apply_fills(rows)
    return done.select("n", "v", "q", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


@plan("join_15", duck(f"""WITH RECURSIVE {_PATHS},
    fills AS (SELECT concat(r_name, '.', n_name, '.', c_name) AS full_name, CASE c_custkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'choice' ELSE 'radio' END AS kind, c_custkey
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT f.c_custkey, fld.node_id FROM fills f LEFT JOIN fld ON fld.source_key = 'form' AND fld.full_name = f.full_name AND fld.ft = CASE f.kind WHEN 'text' THEN 'Tx' WHEN 'choice' THEN 'Ch' ELSE 'Btn' END"""))
def join_15(spark, sf):
    """Fills by name, matched and unmatched together."""
    nodes = _nodes(spark, sf)
    keys = ["source_key", "node_id"]
    fields = gr.terminal_fields(nodes).select(*keys, "full_name").join(gr.inherit(nodes, ["ft"]).select(*keys, "ft"), keys)
    cust, nat, reg = (bridge.table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = cust.join(nat, cust.c_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
    kinds = F.array(F.lit("text"), F.lit("checkbox"), F.lit("choice"), F.lit("radio"))
    fills = joined.select(F.lit("form").alias("source_key"), F.concat_ws(".", "r_name", "n_name", "c_name").alias("full_name"),
                          F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("kind"), "c_custkey")
    matched, rest = fm.match_form_fills(fills, fields)
    return matched.select("c_custkey", "node_id").unionByName(rest.select("c_custkey", F.lit(None).cast("string").alias("node_id")))


@plan("join_16", """
    SELECT 'form' AS source_key, concat('O', o_orderkey) AS node_id, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE CAST(o_orderkey % 40 AS INT) END AS page_index FROM orders
    UNION ALL SELECT 'copy', concat('C', c_custkey), CASE WHEN c_custkey % 10 = 0 THEN 7 ELSE -1 END FROM customer WHERE c_custkey % 5 = 0""")
def join_16(spark, sf):
    widgets = _nodes(spark, sf).where("is_widget").select("source_key", "node_id", "page_index")
    annots = bridge.table(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(
        F.lit("form").alias("source_key"), F.concat(F.lit("O"), "o_orderkey").alias("node_id"), (F.col("o_orderkey") % 40).cast("int").alias("page_index"))
    listed = bridge.table(spark, sf, "customer").where("c_custkey % 10 = 0")
    annots = annots.unionByName(listed.select(F.lit("copy").alias("source_key"), F.concat(F.lit("C"), "c_custkey").alias("node_id"), F.lit(7).alias("page_index")))
    return fm.widget_pages(widgets, annots)


@plan("red_11", duck(f"""WITH RECURSIVE {_PATHS},
    t AS (SELECT DISTINCT i.source_key, i.top FROM {{form_nodes}} w JOIN inh i ON i.source_key = w.source_key AND i.node_id = w.node_id WHERE w.source_key = 'form' AND w.is_widget AND w.page_index = 3 AND w.x < 60 AND w.x + 40 > 20 AND w.y < 700 AND w.y + 20 > 10 AND i.top IN ('R1', 'R3'))
    SELECT concat(f.source_key, '/', i.top) AS source_key, f.node_id, CASE WHEN t.top IS NULL THEN f.v END AS v, t.top IS NOT NULL AND (f.is_widget OR f.node_id = t.top) AS removed
    FROM {{form_nodes}} f JOIN inh i ON i.source_key = f.source_key AND i.node_id = f.node_id LEFT JOIN t ON t.source_key = i.source_key AND t.top = i.top"""))
def red_11(spark, sf):
    """Two of the top fields lie under the rect: each region of each form is a source of its own."""
    nodes = _nodes(spark, sf)
    tops = cut_lineage(gr.top_ancestor(nodes))
    own = F.concat_ws("/", "source_key", "top")
    placed = nodes.join(tops, ["source_key", "node_id"]).withColumn("source_key", own).drop("top")
    placed = placed.withColumn("rect", F.when(F.col("is_widget"), rect(F.col("x"), F.col("y"), 40.0, 20.0)))
    reds = tops.where("top in ('R1', 'R3') AND source_key = 'form'").select(own.alias("source_key")).distinct().select(
        "source_key", F.lit(3).alias("page_index"), rect(20.0, 10.0, 40.0, 690.0).alias("red"))
    return fm.redact_fields(placed, reds).select("source_key", "node_id", "v", "removed")


def _raw_annots(spark, sf):
    df = bridge.view(spark, sf, "annotations")
    x, y, w, h = (F.col(c) for c in ("ax", "ay", "aw", "ah"))
    nothing = F.lit(None).cast("array<double>")
    quads = F.array(x, y + h, x + w, y + h, x, y, x + w, y, F.lit(9.0))
    color = F.when(F.col("line_no") % 3 == 0, F.array(F.lit(0.5), F.lit(0.25), F.lit(1.0))).when(F.col("line_no") % 3 == 1, F.array(F.lit(0.5)))
    return df.select(
        "source_key", "page_index", F.col("line_no").alias("annot_index"), "subtype", F.lit(None).cast("string").alias("nm"),
        F.when(F.col("line_no") % 8 == 1, F.array(x, y)).otherwise(F.array(x + w, y, x, y + h)).alias("rect_nums"), quads.alias("quad_nums"),
        F.array(F.array(x, y, x + w, y), F.array(x, y)).alias("ink_nums"), color.alias("c"), nothing.alias("ic"), F.col("contents"),
        F.when(F.col("line_no") % 8 == 5, "/Helv 9 Tf 0 g").alias("da"), F.when(F.col("line_no") % 8 == 2, 4.0).alias("bs_w"),
        F.when(F.col("line_no") % 16 == 6, F.array(F.lit(0.0), F.lit(0.0), F.lit(3.0))).alias("border"))


_NORMAL = """
    na AS (SELECT source_key, page_index, line_no, CASE line_no % 4 WHEN 0 THEN 'highlight' WHEN 1 THEN 'comment' ELSE 'ink' END AS kind, ax, ay, aw, ah, contents,
        CASE WHEN line_no % 3 = 0 THEN 0.5e0 ELSE CASE line_no % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 ELSE 0.93e0 END END AS red FROM {annotations} WHERE line_no % 4 <> 3 AND NOT line_no % 8 = 1)"""


@plan("ann_1", duck(f"""WITH {_NORMAL}
    SELECT concat(source_key, ':source-annot:', page_index, ':', line_no, ':', kind, '-', line_no) AS id, kind, red, CASE kind WHEN 'highlight' THEN contents WHEN 'comment' THEN contents END AS text,
           CASE WHEN kind = 'comment' THEN CASE WHEN line_no % 8 = 5 THEN 9e0 ELSE 12e0 END END AS font_size, CASE WHEN kind = 'ink' THEN CASE WHEN line_no % 8 = 2 THEN 4e0 WHEN line_no % 16 = 6 THEN 3e0 ELSE 1.5e0 END END AS thickness,
           CASE WHEN kind = 'highlight' THEN ax + aw END AS x2, CASE WHEN kind = 'comment' THEN aw END AS w, CASE WHEN kind = 'ink' THEN 1 END AS n_strokes FROM na"""))
def ann_1(spark, sf):
    df = an.normalise_annotations(_raw_annots(spark, sf))
    return df.select("id", "kind", F.get("color", F.lit(0)).alias("red"), "text", "font_size", "thickness", F.get("quads", F.lit(0))["x2"].alias("x2"), "rect.w",
                     F.when(F.col("kind") == "ink", F.size("strokes")).alias("n_strokes"))


@plan("ann_2", duck(f"""WITH {_NORMAL}
    SELECT source_key, page_index, line_no AS annot_index, ax - CASE kind WHEN 'ink' THEN 1 ELSE 0 END AS llx, ay + CASE kind WHEN 'ink' THEN 1 ELSE ah END AS ury, CASE kind WHEN 'highlight' THEN ax * 4 + ay * 4 + aw * 2 + ah * 2 END AS quad_sum,
           CASE kind WHEN 'ink' THEN 4 END AS ink_n FROM na"""))
def ann_2(spark, sf):
    df = an.annotation_rows(an.normalise_annotations(_raw_annots(spark, sf)))
    total = F.aggregate("quad_nums", F.lit(0.0), lambda a, v: a + v)
    return df.select("source_key", "page_index", "annot_index", "box.llx", "box.ury", total.alias("quad_sum"), F.size(F.get("ink_nums", F.lit(0))).alias("_n"), "kind").select(
        "source_key", "page_index", "annot_index", "llx", "ury", "quad_sum", F.when(F.col("kind") == "ink", F.col("_n")).alias("ink_n"))


@plan("ann_3", duck("""
    WITH a AS (SELECT doc_id AS doc, line_no AS id, CASE WHEN doc_id % 2 = 0 THEN 'primary' ELSE concat('ext:', doc_id % 7) END AS source_key, CAST(line_no % 5 AS INT) AS pg FROM {annotations})
    SELECT a.doc, a.id, s.slot_id, count(*) AS n FROM a JOIN {slots} s ON s.kind = 'page' AND s.doc = a.doc AND s.source_key = a.source_key AND s.source_page_index = a.pg GROUP BY ALL"""))
def ann_3(spark, sf):
    df = bridge.view(spark, sf, "annotations")
    annots = df.select(F.col("doc_id").alias("doc"), F.col("line_no").alias("id"), F.when(F.col("doc_id") % 2 == 0, "primary").otherwise(F.concat(F.lit("ext:"), F.col("doc_id") % 7)).alias("source_key"),
                       (F.col("line_no") % 5).cast("int").alias("page_index"))
    return an.seed_slot_annotations(annots, bridge.view(spark, sf, "slots")).groupBy("doc", "id", "slot_id").agg(F.count("*").alias("n"))


def _signed(spark, sf, shift: float):
    """Annotations of many documents laid on one page per source, so that equal ones meet."""
    df = an.normalise_annotations(_raw_annots(spark, sf))
    moved = df.withColumn("thickness", F.col("thickness") + shift)
    signed = moved.withColumn("signature", an.signature(F.col("kind")))
    doc = F.element_at(F.split("source_key", "/"), 2).cast("long")
    return signed.select(F.element_at(F.split("source_key", "/"), 1).alias("source"), (doc * 100000 + F.col("annot_index")).alias("ord"), "kind", "signature", doc.alias("doc"))


_SIGNED = f"""{_NORMAL},
    sg AS (SELECT split_part(source_key, '/', 1) AS source, CAST(split_part(source_key, '/', 2) AS BIGINT) AS doc, CAST(split_part(source_key, '/', 2) AS BIGINT) * 100000 + line_no AS ord, kind, line_no,
        concat_ws('|', kind, CAST(red AS VARCHAR), CASE kind WHEN 'highlight' THEN concat_ws(',', ax, ay, aw, contents) WHEN 'comment' THEN concat_ws(',', ax, ay, aw, contents, CASE WHEN line_no % 8 = 5 THEN 9 ELSE 12 END)
            ELSE concat_ws(',', ax, ay, aw, CASE WHEN line_no % 8 = 2 THEN 4e0 WHEN line_no % 16 = 6 THEN 3e0 ELSE 1.5e0 END) END) AS sig FROM na)"""


@plan("set_1", duck(f"""WITH {_SIGNED},
    k AS (SELECT *, row_number() OVER (PARTITION BY source, sig ORDER BY ord) AS rn FROM sg), b AS (SELECT source, sig, count(*) AS n FROM sg WHERE doc % 4 = 0 GROUP BY ALL)
    SELECT k.source, k.ord, k.kind FROM k LEFT JOIN b USING (source, sig) WHERE rn > coalesce(n, 0)"""))
def set_1(spark, sf):
    current = _signed(spark, sf, 0.0)
    baseline = _signed(spark, sf, 0.0001).where("doc % 4 = 0")
    return an.subtract_annotations(current, baseline, ["source"], "ord").select("source", "ord", "kind")


@plan("set_2", duck(f"""WITH {_SIGNED},
    a AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn, sig FROM sg), b AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn, sig FROM sg WHERE NOT (source = 'src3' AND doc % 7 = 0))
    SELECT source, bool_and(coalesce(a.sig = b.sig, false)) AS equal FROM a FULL JOIN b USING (source, rn) GROUP BY source"""))
def set_2(spark, sf):
    a = _signed(spark, sf, 0.0)
    b = _signed(spark, sf, 0.0001).where("not (source = 'src3' and doc % 7 = 0)")
    return an.annotation_lists_equal(a, b, ["source"], "ord")
