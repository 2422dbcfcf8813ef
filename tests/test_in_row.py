"""Plans that cut texts in their row: no character may become a row of a shuffle."""

from pyspark.sql import functions as F

from pageframe.operators import order as od
from pageframe.operators.cmap import glyph_widths, sized_shows


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_script_segments_match_levels_letter_by_letter(spark):
    texts = ["ab 12", "", None, "ހެލޯ 12ab,ހ", "\U0001f600ހ\U0001f600", "x\n\nހ", "אב12"]
    rows = spark.createDataFrame([(k, t, r) for k, t in enumerate(texts) for r in (True, False)], "k int, t string, r boolean")
    chars = rows.select("k", "r", F.posexplode(F.split("t", "")).alias("pos", "ch")).where("ch <> ''")
    slow = od.segment_by_level(chars.withColumn("level", od.script_level(F.col("ch"), F.col("r"))), ["k", "r"])
    want = sorted((x.k, x.r, x.segment, x.level, x.text) for x in slow.collect())
    fast = rows.select("k", "r", F.posexplode(od.script_segments(F.col("t"), F.col("r"))).alias("n", "s"))
    assert sorted((x.k, x.r, x.n + 1, x.s.level, x.s.text) for x in fast.collect()) == want
    assert exchanges(fast) == 0


def test_spans_of_a_line_are_merged_in_their_row(spark):
    from pageframe.operators.spans import merge_spans, merged_in_row, uniform_in_row, uniform_style

    style = "struct<font_family:string,bold:boolean>"
    faces = [("A", True), ("A", None), ("B", True), None]
    texts = [["a", "", "b", "c"], ["", ""], [], ["x", "\n", "y"], ["\n"], ["p", "q", "r", "s", "t"]]
    spans = [(k, [(n, t, faces[(n * n + k) // 3 % 4] if k else faces[0]) for n, t in enumerate(row)]) for k, row in enumerate(texts)]
    rows = spark.createDataFrame(spans, f"k int, spans array<struct<seq:long,text:string,style:{style}>>")
    each = rows.select("k", F.inline("spans"))
    want = sorted((r.k, r.island, r.text, r.style) for r in merge_spans(each, ["k"]).collect())
    fast = rows.select("k", F.posexplode(merged_in_row(F.col("spans"))).alias("n", "m"))
    assert sorted((r.k, r.n + 1, r.m.text, r.m.style) for r in fast.collect()) == want
    same = {r.k: r.style for r in uniform_style(each, ["k"]).collect()}
    assert {r.k: r.u for r in rows.select("k", uniform_in_row(F.col("spans")).alias("u")).collect()} == {k: same.get(k) for k in range(len(texts))}
    assert exchanges(fast) == 0


def test_spans_plan_shuffles_no_token(spark):
    from pageframe.plans import QUERIES
    import pageframe.plans.all  # noqa: F401

    assert exchanges(QUERIES["txt_18"](spark, "/root/testdata/sf0.001")) == 0


def test_shows_are_measured_in_their_row(spark):
    rows = [(0, "A", b"ab"), (1, "A", b""), (2, "C", b"\x00a\xd8\x01\xff"), (3, "X", b"ab"), (4, "none", b"a"), (5, "A", None)]
    shows = spark.createDataFrame([("s", 0, *r) for r in rows], "source_key string, page_index int, op_index int, font string, bytes binary")
    fonts = spark.createDataFrame(
        [("s", "A", "TrueType", "WinAnsiEncoding", True, 250.0), ("s", "C", "Type0", "Identity-H", True, None), ("s", "X", "Type3", None, True, None)],
        "source_key string, font string, subtype string, encoding string, has_widths boolean, default_width double")
    widths = spark.createDataFrame([("s", "A", 97, 500.0), ("s", "C", 0xD801, 7.0)], "source_key string, font string, gid int, width double")
    found = sized_shows(shows, widths, fonts)
    assert not [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and ("gid" in x and "op_index" in x)]
    got = {r.op_index: (r.supported, [tuple(g) for g in r.glyphs or []]) for r in found.collect()}
    assert got == {0: (True, [(97, 500.0), (98, 250.0)]), 1: (True, []), 2: (True, [(97, 1000.0), (0xD801, 7.0)]), 3: (False, [(None, None)]), 4: (False, [(None, None)]), 5: (True, [])}
    each = sorted((r.op_index, r.seq if r.seq is not None else -1, r.width) for r in glyph_widths(shows, widths, fonts).where("supported").collect())
    assert each == [(0, 0, 500.0), (0, 1, 250.0), (1, -1, None), (2, 0, 1000.0), (2, 1, 7.0), (5, -1, None)]


def test_longest_items_are_reduced_before_the_shuffle(spark):
    from pageframe.plans import QUERIES
    import pageframe.plans.all  # noqa: F401

    plan = QUERIES["top_4"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 1 and "REPARTITION" not in moved[0]
