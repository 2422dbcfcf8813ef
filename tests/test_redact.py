"""Annotation, form and edit goldens and properties."""

import random

import pytest
from pyspark.sql import functions as F

from pageframe.functions.geometry import normalise_box, normalise_rect, rect, rect_contains, rect_to_quad, rects_overlap
from pageframe.operators import edits as ed
from pageframe.operators import forms as fm
from pageframe.operators import graph as gr
from pageframe.operators import redact as rd
from pageframe.operators.cmap import repair_cmap_gaps


def lit_rect(*v):
    return rect(*v)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rect_goldens(spark):
    assert value(spark, rects_overlap(lit_rect(10, 20, 40, 30), lit_rect(45, 35, 20, 20))) is True
    assert value(spark, rects_overlap(lit_rect(10, 20, 40, 30), lit_rect(50, 20, 10, 30))) is False
    flip = F.array(*[F.lit(float(v)) for v in (100, 200, 50, 180)])
    assert tuple(value(spark, normalise_box(flip))) == (50.0, 180.0, 100.0, 200.0)
    flat = F.array(*[F.lit(float(v)) for v in (100, 200, 100, 180)])
    assert value(spark, normalise_rect(flat)) is None and value(spark, normalise_box(flat)) is not None
    assert value(spark, rect_contains(lit_rect(10.0005, 20.0005, 29.999, 39.999), lit_rect(10, 20, 30, 40))) is True


def test_subtract_area_property(spark):
    random.seed(9)
    rows = []
    for i in range(40):
        cuts = [(float(random.randint(-5, 30)), float(random.randint(-5, 30)), float(random.randint(1, 20)), float(random.randint(1, 20))) for _ in range(3)]
        rows.append((i, cuts))
    df = spark.createDataFrame(rows, "i int, cuts array<struct<x:double,y:double,w:double,h:double>>")
    for r in df.select("cuts", rd.subtract_rects(lit_rect(0, 0, 30, 30), F.col("cuts")).alias("p")).collect():
        free = sum(not any(c.x <= x < c.x + c.w and c.y <= y < c.y + c.h for c in r.cuts) for x in range(30) for y in range(30))
        assert abs(sum(p.w * p.h for p in r.p) - free) < 1e-9


ANNOT = "id string, subtype string, x double, y double, w double, h double, thickness double, text string"


def _annots(spark, rows):
    df = spark.createDataFrame(rows, ANNOT).withColumn("source_key", F.lit("s")).withColumn("page_index", F.lit(0)).withColumn("rect", rect(*map(F.col, "xywh")))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    stroke = F.array(pt(F.col("x"), F.col("y")), pt(F.col("x") + F.col("w"), F.col("y")))
    return df.select("source_key", "page_index", "id", "subtype", "rect", F.array(rect_to_quad(F.col("rect"))).alias("quads"), F.array(stroke).alias("strokes"), "thickness", "text")


def _cut(spark, *v):
    return spark.createDataFrame([("s", 0, "a")], "source_key string, page_index int, red_id string").withColumn("red", rect(*v))


def test_annotation_goldens(spark):
    high = rd.redact_annotations(_annots(spark, [("h", "Highlight", 10.0, 10.0, 40.0, 20.0, 1.0, "note")]), _cut(spark, 25, 0, 10, 40)).first()
    assert sorted((q.x1, q.x2) for q in high.quads) == [(10.0, 25.0), (35.0, 50.0)] and high.text is None
    both = _annots(spark, [("a", "FreeText", 10.0, 10.0, 30.0, 20.0, 1.0, "x"), ("b", "FreeText", 80.0, 80.0, 30.0, 20.0, 1.0, "y")])
    assert [r.id for r in rd.redact_annotations(both, _cut(spark, 15, 15, 10, 10)).collect()] == ["b"]
    ink = rd.redact_annotations(_annots(spark, [("i", "Ink", 0.0, 10.0, 100.0, 0.0, 0.0, None)]), _cut(spark, 40, 0, 20, 20)).first()
    assert sorted((s[0].x, s[1].x) for s in ink.strokes) == [(0.0, 40.0), (60.0, 100.0)]


def test_redacted_ink_keeps_no_text_and_is_cut_by_its_strokes(spark):
    rows = [("i", "Ink", 0.0, 10.0, 100.0, 0.0, 4.0, "SECRET"), ("far", "Ink", 0.0, 200.0, 100.0, 0.0, 4.0, "stays")]
    annots = _annots(spark, rows)
    missing = annots.withColumn("rect", F.lit(None).cast(annots.schema["rect"].dataType))
    beside = annots.withColumn("rect", lit_rect(500, 500, 5, 5))
    for df in (annots, missing, beside):
        got = {r.id: r for r in rd.redact_annotations(df, _cut(spark, 60, 0, 40, 20)).collect()}
        assert got["i"].text is None and tuple(got["i"].rect) == pytest.approx((-2.0, 8.0, 62.0, 4.0))
        assert got["far"].text == "stays"


def test_covers_stay_in_their_document(spark):
    reds = spark.createDataFrame([(1, "primary", 0, "r")], "doc long, source_key string, page_index int, red_id string")
    slots = spark.createDataFrame([(d, f"s{d}", 0, "page", "primary", 0) for d in (1, 2)], "doc long, slot_id string, pos int, kind string, source_key string, source_page_index int")
    assert [r.slot_id for r in rd.cover_rects(reds, slots).collect()] == ["s1"]


NODES = "node_id string, parent_id string, name string, ft string, ff int, v string, is_widget boolean, page_index int, x double, y double, w double, h double"


def test_field_redaction_takes_siblings(spark):
    rows = [("f", None, "secret", "Tx", None, "key", False, -1, 0.0, 0.0, 0.0, 0.0), ("w1", "f", None, None, None, None, True, 0, 10.0, 10.0, 40.0, 20.0),
            ("w2", "f", None, None, None, None, True, 1, 10.0, 10.0, 40.0, 20.0), ("p", None, "public", "Tx", None, "open", True, 0, 100.0, 100.0, 50.0, 30.0)]
    nodes = spark.createDataFrame(rows, NODES).withColumn("source_key", F.lit("s")).withColumn("rect", F.when(F.col("is_widget"), rect(*map(F.col, "xywh"))))
    got = {r.node_id: (r.v, r.removed) for r in rd_fields(nodes, _cut(spark, 15, 15, 10, 10)).collect()}
    assert got == {"f": (None, True), "w1": (None, True), "w2": (None, True), "p": ("open", False)}
    kinds = {r.full_name: r.kind for r in fm.flatten_fields(nodes).collect()}
    assert kinds == {"secret": "text", "public": "text"}


def rd_fields(nodes, rects):
    return fm.redact_fields(nodes, rects)


def test_reachable_with_cycle_is_stable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    once = gr.reachable(edges, spark.createDataFrame([("a",)], "node string"))
    assert sorted(r.node for r in once.collect()) == ["a", "b", "c"]
    assert sorted(r.node for r in gr.reachable(edges, once).collect()) == ["a", "b", "c"]


def test_cmap_repair_equals_sequential_rule(spark):
    random.seed(4)
    rows = [(f, c, random.choice([0x20, 0x20, 65, *range(0x7A6, 0x7B1)])) for f in range(40) for c in range(30) if random.random() < 0.9]
    got = {(r.font, r.cid): r.cp for r in repair_cmap_gaps(spark.createDataFrame(rows, "font int, cid int, cp int"), ["font"]).collect()}
    table = {(f, c): p for f, c, p in rows}
    fili = lambda p: p is not None and 0x7A6 <= p <= 0x7B0
    for f, c in sorted(table):
        if table[f, c] != 0x20:
            continue
        before, after = table.get((f, c - 1)), table.get((f, c + 1))
        if fili(before) and before < 0x7B0:
            table[f, c] = before + 1
        elif fili(after) and after > 0x7A6:
            table[f, c] = after - 1
    assert got == table


def test_history_burst(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [("d", i, start + timedelta(milliseconds=ms), k) for i, (ms, k) in enumerate([(0, "a"), (400, "a"), (800, "a"), (1400, "a"), (1500, None), (1600, None), (1700, "b"), (1800, "a")])]
    got = ed.coalesce_history(spark.createDataFrame(rows, "doc string, seq long, ts timestamp, key string")).orderBy("entry").collect()
    assert [(r.first_seq, r.calls) for r in got] == [(0, 3), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]


def test_leak_check_grams_equal_contains(spark):
    texts = spark.createDataFrame([(0, "alpha beta"), (1, "x"), (2, "secret-token here")], "i int, text string")
    words = ["a", "be", "secret-token", "x", "beta", "nothing", "ere"]
    found = rd.leak_check(texts, "text", spark.createDataFrame([(w,) for w in words], "sentinel string"), "sentinel")
    got = sorted((r.i, r.sentinel) for r in found.collect())
    assert got == sorted((r[0], w) for r in texts.collect() for w in words if w in r[1])


def test_pattern_spans_redact_whole_text(spark):
    df = spark.createDataFrame([("mail a.b@c.org and 10.0.0.1 end",), ("none",)], "t string")
    rows = rd.redact_text(df.withColumn("s", rd.pattern_spans(F.col("t"), r"[a-z.]+@[a-z.]+|[0-9]+(?:\.[0-9]+){3}")), "t", "s").collect()
    assert rows[0].redacted == "mail █████████ and ████████ end" and rows[0].plan == "rewrite"
    assert rows[1].redacted == "none" and rows[1].plan == "untouched"


def test_redacted_shapes_are_made_once(spark, tmp_path):
    from pageframe.functions.geometry import rect as box

    rows = [("s", p, f"s{n}", 10.0 * n) for p in range(3) for n in range(4)]
    spark.createDataFrame(rows, "source_key string, page_index int, shape_id string, x double").write.parquet(f"{tmp_path}/shapes")
    shapes = spark.read.parquet(f"{tmp_path}/shapes").withColumn("rect", box(F.col("x"), F.lit(0.0), F.lit(300.0), F.lit(5.0)))
    reds = spark.createDataFrame([("s", 1, 25.0), ("s", 1, 305.0), ("s", 9, 0.0)], "source_key string, page_index int, at double")
    hit = rd.redact_shapes(shapes, reds.select("source_key", "page_index", box(F.col("at"), F.lit(1.0), F.lit(3.0), F.lit(1.0)).alias("red")))
    assert hit._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert hit.columns == shapes.columns
    assert sorted((r.page_index, r.shape_id) for r in hit.collect()) == [(1, "s0"), (1, "s1"), (1, "s2"), (1, "s3")]
