"""Content state walk, blocks, paths, shapes, glyph redaction goldens."""

import random

from pyspark.sql import functions as F

from pageframe.functions.geometry import matrix, rect
from pageframe.operators import content as ct
from pageframe.operators import redact as rd

OPS = "source_key string, page_index int, op_index long, op string, nums array<double>, name string"


def ops(spark, rows, page=0):
    return spark.createDataFrame([("s", page, i, op, [float(v) for v in nums], name) for i, (op, nums, name) in enumerate(rows)], OPS)


def _random_ops(n):
    sizes = {"cm": 6, "Tm": 6, "Td": 2, "TD": 2, "Tc": 1, "TL": 1, "Tz": 1, "Tf": 1, '"': 2}
    out = []
    for _ in range(n):
        op = random.choice(["q", "Q", "Q", "cm", "BT", "Tf", "Tc", "TL", "TD", "Td", "T*", "Tm", "Tj", "'", '"', "Tz"])
        out.append((op, [random.randint(1, 3) for _ in range(sizes.get(op, 0))], random.choice(["F1", "F2"]) if op == "Tf" else None))
    return out


def test_chunked_walk_equals_one_walk(spark):
    random.seed(2)
    df = ops(spark, _random_ops(90))
    order = lambda d: [tuple(str(v) for v in r) for r in d.orderBy("op_index").collect()]
    assert order(ct.op_state(df, chunk=7)) == order(ct.op_state(df))


def test_state_stack(spark):
    df = ops(spark, [("BT", [], None), ("q", [], None), ("Tm", [1, 0, 0, 1, 20, 30], None), ("Tj", [], None), ("Q", [], None), ("Tm", [1, 0, 0, 1, 40, 50], None), ("Tj", [], None)])
    got = [(r.tm[4], r.tm[5]) for r in ct.text_state(df).orderBy("op_index").collect()]
    assert got == [(20.0, 30.0), (40.0, 50.0)]


def test_vector_goldens(spark):
    df = ops(spark, [("q", [], None), ("w", [2], None), ("re", [10, 10, 30, 20], None), ("S", [], None), ("Q", [], None), ("re", [100, 100, 10, 10], None), ("f", [], None)])
    members = ct.path_members(df)
    from pageframe.operators.grid import overlap_join

    cut = spark.createDataFrame([("s", 0)], "source_key string, page_index int").withColumn("red", rect(15, 15, 5, 5))
    hit = overlap_join(ct.path_bboxes(members), cut, "rect", "red")
    assert sorted(r.op_index for r in ct.path_ops(members, hit.select("source_key", "page_index", "path_no")).collect()) == [2, 3]
    shape = ct.shape_blocks(df).collect()
    assert len(shape) == 1 and (shape[0].q_index, shape[0].end_index) == (0, 4)


def test_horizontal_rule_shape_grows(spark):
    df = ops(spark, [("q", [], None), ("m", [10, 50], None), ("l", [90, 50], None), ("S", [], None), ("Q", [], None), ("q", [], None), ("re", [0, 0, 5, 5], None), ("n", [], None), ("Q", [], None)])
    got = ct.shape_blocks(df).collect()
    assert [(tuple(r.rect), r.shape_id) for r in got] == [((10.0, 49.5, 80.0, 1.0), "p1-s0")]


def _redact(spark, content, widths, two_byte, cut, font_type="TrueType", encoding="WinAnsiEncoding"):
    shows = spark.createDataFrame([("s", 0, 3, "F1", 10.0, 0.0, 0.0, 1.0, content)], "source_key string, page_index int, op_index long, font string, size double, tc double, tw double, th double, b binary")
    shows = shows.withColumn("tm", matrix(1, 0, 0, 1, 100, 200)).withColumn("segments", F.array(F.struct(F.col("b").alias("bytes"), F.lit(None).cast("double").alias("spacer"))))
    fonts = spark.createDataFrame([("s", "F1", font_type, encoding, True, 0.0)], "source_key string, font string, subtype string, encoding string, has_widths boolean, default_width double")
    wide = spark.createDataFrame([("s", "F1", g, float(w)) for g, w in widths.items()], "source_key string, font string, gid int, width double")
    reds = spark.createDataFrame([("s", 0)], "source_key string, page_index int").withColumn("red", rect(*cut))
    marked = rd.mark_glyphs(rd.glyph_rows(shows, wide, fonts), reds)
    plan = rd.redact_glyphs(shows, marked, reds).first().plan
    items = [(i.hex, None if i.gap is None else round(i.gap)) for i in rd.rewrite_shows(marked).first()["items"]] if plan == "rewrite" else None
    return plan, items


def test_glyph_goldens(spark):
    flat = {g: 600 for g in range(65, 69)}
    assert _redact(spark, b"ABCD", flat, False, (106.1, 199, 11.8, 12)) == ("rewrite", [("41", None), (None, -1200), ("44", None)])
    assert _redact(spark, b"AB", flat, False, (99, 199, 20, 12)) == ("drop", None)
    assert _redact(spark, b"AB", flat, False, (500, 500, 1, 1)) == ("untouched", None)
    assert _redact(spark, b"AB", flat, False, (500, 500, 1, 1), "Type0", "Custom") == ("unsupported", None)
    wide = {1: 500, 2: 700, 3: 600}
    assert _redact(spark, bytes([0, 1, 0, 2, 0, 3]), wide, True, (105.1, 199, 6.8, 12), "Type0", "Identity-H") == ("rewrite", [("0001", None), (None, -700), ("0003", None)])


def test_black_out():
    pixels = bytes(range(10, 22))
    out = rd._black_out(pixels, 2, 2, 3, [{"x0": 0, "y0": 1, "x1": 1, "y1": 2}])
    assert out == pixels[:6] + b"\0\0\0" + pixels[9:]
    assert rd._black_out(pixels, 2, 2, 2, [{}]) is None


def test_many_short_pages_take_no_call_each(spark):
    rows = [("s", page, page * 10 + i, op, nums, None) for page in range(300) for i, (op, nums) in enumerate([("q", []), ("cm", [1.0, 0.0, 0.0, 1.0, float(page), 0.0]), ("Q", [])])]
    df = spark.createDataFrame(rows, "source_key string, page_index int, op_index long, op string, nums array<double>, name string")
    state = ct.op_state(df)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    moved = {r.page_index: r.ctm[4] for r in state.where("op_index % 10 = 1").collect()}
    assert moved == {page: float(page) for page in range(300)}
    assert {r.ctm[4] for r in state.where("op_index % 10 = 2").collect()} == {0.0}
