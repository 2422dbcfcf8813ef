"""Runs and paragraphs: goldens and the sequential rules as brute force."""

import random
import re

from pyspark.sql import functions as F

from pageframe.operators import blocks as bl
from pageframe.operators import runs as rn

ITEMS = "source_key string, page_index int, index int, str string, x double, y double, width double, height double, gap_left double, gap_right double, op_indices array<int>"


def items(spark, rows, page=0):
    full = [("s", page, i, s, float(x), float(y), float(w), 20.0, *(g or (None, None)), [op]) for i, s, x, y, w, op, g in rows]
    return spark.createDataFrame(full, ITEMS)


def build(df):
    return rn.build_run_rows(rn.insert_word_gaps(rn.order_run_items(rn.group_runs(df)))).collect()


def test_base_before_mark(spark):
    run = build(items(spark, [(0, "ަ", 100, 120, 0, 3, None), (1, "ކ", 100, 120, 12, 3, None)]))[0]
    assert run.text == "ކަ" and run.item_ids == [1, 0] and run.op_indices == [3]


def test_list_marker_and_digits(spark):
    a, b = "ދިވެހި", "ވަނަ"
    rows = [(0, "7.2", 490, 120, 16, 1, None), (1, a, 180, 120, 300, 2, (190.0, 470.0)), (2, "129", 260, 120, 20, 3, None), (3, b, 100, 120, 70, 4, None)]
    runs = build(items(spark, rows))
    assert len(runs) == 1
    assert re.match(rf"^7\.2\s+{a}", runs[0].text) and f"{a} 129 " in runs[0].text


def _script(t):
    if re.search("[֐-ࣿ]", t):
        return "rtl"
    return "ltr" if re.search("[!-~]", t) else "unknown"


def _sequential_runs(rows):
    out, bucket, n = {}, [], -1
    for i, s, x, y, w, _, _ in rows:
        cur = (s, x, x + (w or 6), y)
        if bucket:
            p = bucket[-1]
            gap = 0 if p[2] >= cur[1] and cur[2] >= p[1] else min(abs(cur[1] - p[2]), abs(p[1] - cur[2]))
            marker = re.fullmatch(r"[0-9.()\[\]/-]+", bucket[0][0].strip()) is not None
            ok = abs(y - p[3]) < 6 and (gap < 30 or (_script(p[0]) != _script(s) and gap < 40) or (len(bucket) == 1 and marker and _script(s) == "rtl") or (len(bucket) > 1 and marker))
            if not ok:
                bucket = []
        if not bucket:
            n += 1
        bucket.append(cur)
        out[i] = n
    return out


def test_group_runs_equals_sequential_rule(spark):
    random.seed(11)
    for _ in range(3):
        rows = [(i, random.choice(["7.2", "abc", "ދި", "(1)", "x"]), random.randint(0, 400), 100 + 30 * (i // 9), random.choice([0, 12, 25]), i, None) for i in range(120)]
        got = {r["index"]: r.run_no for r in rn.group_runs(items(spark, rows)).collect()}
        assert got == _sequential_runs(rows)


def test_banded_order_equals_python_sort(spark):
    rows = [(i, "a", 100 + 0.6 * i, 50, 5 + (i * 7) % 3, i, None) for i in range(9)]
    run = rn.order_run_items(rn.group_runs(items(spark, rows))).first()
    import functools

    def compare(p, q):
        d = p[2] - q[2]
        return d if abs(d) > 1 else q[4] - p[4]

    assert [p["index"] for p in run.parts] == [r[0] for r in sorted(rows, key=functools.cmp_to_key(compare))]


RUNS = "source_key string, page_index int, run_no int, run_id string, text string, left double, width double, baseline_y double, top double, height double, box_height double, font_family string, bold boolean, italic boolean, underline boolean, strikethrough boolean, op_indices array<int>"


def runs(spark, rows):
    full = [("s", 0, i, f"r{i}", t, float(le), float(w), float(b), b - 20.0, 20.0, 24.0, "Faruma", False, False, False, False, [i]) for i, (t, le, b, w) in enumerate(rows)]
    return spark.createDataFrame(full, RUNS)


def test_paragraph_goldens(spark):
    same = bl.make_blocks(bl.group_paragraphs(runs(spark, [("a", 80, 120, 180), ("b", 82, 148, 180)]))).collect()
    assert [(b.block_id, b.line_step) for b in same] == [("p1-b0", 28.0)]
    assert bl.group_paragraphs(runs(spark, [("a", 80, 120, 180), ("b", 150, 148, 180)])).select("block_head").distinct().count() == 2
    assert bl.group_paragraphs(runs(spark, [("6.2 first", 80, 120, 180), ("b", 128, 148, 180)])).select("block_head").distinct().count() == 1
    lines = [("a", 80, 120, 520), ("b", 120, 148, 500), ("c", 121, 176, 499), ("d", 220, 204, 200)]
    wide = [(f"6.2 {t}" if i == 0 else t, le, b, w) for i, (t, le, b, w) in enumerate(lines)]
    block = bl.make_blocks(bl.group_paragraphs(runs(spark, wide))).first()
    assert block.text_align == "justify" and block.line_step == 28.0
    cells = [("a", 80, 120, 100), ("b", 260, 120, 100), ("c", 80, 148, 100), ("d", 260, 148, 100)]
    assert bl.group_paragraphs(runs(spark, cells)).select("block_head").distinct().count() == 4


def test_block_text_layouts_and_style(spark):
    both = bl.make_blocks(bl.group_paragraphs(runs(spark, [("first wrapped line", 80, 120, 180), ("second wrapped line", 82, 148, 180)]))).first()
    assert both.text == "first wrapped line\nsecond wrapped line"
    assert [tuple(x) for x in both.line_layouts] == [(0.0, 0.0, 180.0, False), (2.0, 28.0, 180.0, False)]
    assert (both.font_family, both.bold, both.italic, both.size) == ("Faruma", False, False, 20.0)
    marked = bl.make_blocks(bl.group_paragraphs(runs(spark, [("6.2 first list line", 80, 120, 180), ("continuation line", 128, 148, 180)]))).first()
    assert marked.text.split("\n")[1] == " " * 10 + "continuation line"
    alone = bl.make_blocks(bl.group_paragraphs(runs(spark, [("only", 80, 120, 180)]))).first()
    assert alone.text == "only" and alone.line_layouts is None and not alone.is_paragraph
    rtl = [("ކއ ރތ", 80, 120, 500), ("ކއ ރތ", 80, 148, 500), ("ކއ", 500, 176, 80)]
    block = bl.make_blocks(bl.group_paragraphs(runs(spark, rtl))).first()
    lines = block.text.split("\n")
    assert len(lines[0]) > len(rtl[0][0]) and lines[0].split() == rtl[0][0].split() and lines[2] == rtl[2][0]
    assert [x.justify for x in block.line_layouts] == [True, True, False]


def test_pair_decorations_in_turn(spark):
    from pageframe.functions.geometry import rect

    shapes = spark.createDataFrame([("s", 0, f"s{i}", i, 0.0 + 3 * i, 98.0, 40.0, 1.0) for i in range(4)], "source_key string, page_index int, shape_id string, shape_no int, x double, y double, w double, h double")
    shapes = shapes.select("source_key", "page_index", "shape_id", "shape_no", rect(*map(F.col, "xywh")).alias("rect"))
    lines = spark.createDataFrame([("s", 0, "r0", 0, 0.0, 50.0, 100.0, 12.0), ("s", 0, "r1", 1, 0.0, 60.0, 100.5, 12.0)],
                                  "source_key string, page_index int, run_id string, run_no int, pdf_left double, pdf_width double, pdf_baseline double, size double")
    pairs = sorted((r.shape_id, r.run_id, r.kind) for r in rn.pair_decorations(shapes, lines).collect())
    assert pairs == [("s0", "r0", "underline"), ("s1", "r1", "underline")]


def test_white_space_before_a_mark_goes_from_the_edges(spark):
    words = ["ab", "x", "ަ", "ކަ", "c\u00a0d", "e \u064b", "\u2003", "7."]
    random.seed(4)
    rows = [(i, random.choice(words), 20 * i, 120, 18, i, None) for i in range(40)]
    runs = rn.insert_word_gaps(rn.order_run_items(rn.group_runs(items(spark, rows))))
    found = {(r.run_no, r.offset): r.ch for r in rn.char_edges(runs).collect()}
    for r in runs.collect():
        text = "".join(" " * n + p["str"] for p, n in zip(r.parts, r.spaces))
        kept = re.sub("[ \u00a0\u2003]+(?=[\u07a6-\u07b0\u064b-\u065f])", "", text)
        assert "".join(found[r.run_no, k] for k in range(len(kept))) == kept and (r.run_no, len(kept)) not in found


def test_run_steps_look_at_no_text_twice_over(spark):
    runs = rn.insert_word_gaps(rn.order_run_items(rn.group_runs(items(spark, [(0, "a", 0, 120, 9, 0, None)]))))
    plan = rn.char_edges(runs)._jdf.queryExecution().analyzed().toString()
    assert "substr(" not in plan and "array_sort(" not in plan and "_mix" in plan
