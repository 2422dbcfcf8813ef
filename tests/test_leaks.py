"""Cases in which content could stay readable or get lost: highlights without rect, shows without codes, null windows."""

from pyspark.sql import functions as F

from pageframe.functions.geometry import rect
from pageframe.operators import annotations as an
from pageframe.operators import redact as rd
from pageframe.operators.cmap import decode_both, decode_glyphs, font_fallback_chunks

RAW = (
    "source_key string, page_index int, annot_index int, subtype string, nm string, rect_nums array<double>, quad_nums array<double>, ink_nums array<array<double>>, "
    "c array<double>, ic array<double>, contents string, da string, bs_w double, border array<double>"
)


def red(spark, page, *v):
    return spark.createDataFrame([("s", page, "r")], "source_key string, page_index int, red_id string").withColumn("red", rect(*v))


def quad(x0, y0, x1, y1):
    return [float(v) for v in (x0, y1, x1, y1, x0, y0, x1, y0)]


def raw(spark):
    rows = [
        ("s", 0, 0, "Highlight", "h", None, quad(10, 10, 50, 30), None, None, None, "SECRET", None, None, None),
        ("s", 0, 1, "Highlight", "far", None, quad(200, 200, 250, 220), None, None, None, "words", None, None, None),
        ("s", 0, 2, "FreeText", "hit", [15.0, 15.0, 45.0, 35.0], None, None, None, None, "SECRET", None, None, None),
        ("s", 0, 3, "FreeText", "safe", [80.0, 80.0, 110.0, 100.0], None, None, None, None, "safe", None, None, None),
        ("s", 0, 4, "Ink", "ink", None, None, [[0.0, 20.0, 100.0, 20.0]], None, None, None, None, 0.0, None),
        ("s", 1, 0, "Highlight", "other", None, quad(10, 10, 50, 30), None, None, None, "kept", None, None, None),
    ]
    return spark.createDataFrame(rows, RAW)


def test_annotations_are_redacted_as_they_are_read(spark):
    table = an.normalise_annotations(raw(spark))
    got = {r.id.rsplit(":", 1)[-1]: r for r in rd.redact_new_annotations(table, red(spark, 0, 25.0, 0.0, 10.0, 40.0)).collect()}
    assert set(got) == {"h", "far", "safe", "ink", "other"}
    assert [(q.x1, q.x2, q.y1, q.y3) for q in got["h"].quads] == [(10.0, 25.0, 30.0, 10.0), (35.0, 50.0, 30.0, 10.0)]
    assert got["h"].text is None and got["far"].text is None and got["other"].text == "kept" and got["safe"].text == "safe"
    assert [[(p.x, p.y) for p in s] for s in got["ink"].strokes] == [[(0.0, 20.0), (25.0, 20.0)], [(35.0, 20.0), (100.0, 20.0)]]
    whole = rd.redact_new_annotations(table, red(spark, 0, 0.0, 0.0, 60.0, 60.0))
    assert whole.where("id LIKE '%:h' OR id LIKE '%:hit' OR text = 'SECRET'").count() == 0


def test_highlight_without_rect_keeps_no_text(spark):
    table = an.normalise_annotations(raw(spark)).withColumn("subtype", F.initcap("kind")).where("kind = 'highlight'")
    got = {r.id.rsplit(":", 1)[-1]: r.text for r in rd.redact_annotations(table, red(spark, 0, 0.0, 0.0, 60.0, 60.0)).collect()}
    assert got == {"far": "words", "other": "kept"}
    part = {r.id.rsplit(":", 1)[-1]: r for r in rd.redact_annotations(table, red(spark, 0, 25.0, 0.0, 10.0, 40.0)).collect()}
    assert part["h"].text is None and len(part["h"].quads) == 2


def test_shows_without_a_whole_code_stay(spark):
    shows = spark.createDataFrame(
        [("s", 0, 0, "F", "Identity-H", b""), ("s", 0, 1, "F", "Identity-H", b"A"), ("s", 0, 2, "F", "Identity-H", b"\0A"), ("s", 0, 3, "F", None, b""), ("s", 0, 4, "F", None, None), ("s", 0, 5, "F", None, b"AZ")],
        "source_key string, page_index int, op_index int, font string, encoding string, bytes binary")
    cmap = spark.createDataFrame([("s", "F", 65, 97)], "source_key string, font string, cid int, cp int")
    for strict, want in ((True, ["", None, "a", "", None, None]), (False, ["", "", "a", "", None, "a"])):
        got = {r.op_index: r.decoded for r in decode_glyphs(shows, cmap, strict, map_keys=["source_key", "font"]).collect()}
        assert [got[i] for i in range(6)] == want


def test_null_windows_are_passed_over(spark):
    window = "array<struct<x0:int,y0:int,x1:int,y1:int>>"
    rows = [(bytes([9] * 4), [None, (0, 0, 1, 2)]), (bytes([9] * 4), [None]), (bytes([9] * 4), []), (bytes([9] * 4), None), (None, [(0, 0, 1, 1)])]
    df = spark.createDataFrame(rows, f"s binary, w {window}")
    got = [r.o for r in df.select(rd.black_out(F.col("s"), F.lit(2), F.lit(2), F.lit(1), F.col("w")).alias("o")).collect()]
    assert [None if o is None else bytes(o) for o in got] == [bytes([0, 9, 0, 9]), None, None, None, None]


def exchanges(df):
    """Exchanges of a plan other than broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_leak_check_moves_no_text(spark):
    texts = spark.createDataFrame([(0, "the red ring and the bolt"), (1, "ringring"), (2, ""), (3, None), (4, "\u00e9t\u00e9 \U0001f600 ring")], "n int, text string")
    words = ["ring", "red ring", "and", "n", "\U0001f600 ri", "absent one", "", None, "ring"]
    sentinels = spark.createDataFrame([(w,) for w in words], "s string")
    want = sorted((r.n, w) for r in texts.collect() for w in set(filter(None, words)) if w in (r.text or ""))
    for few in (256, 0):
        found = rd.leak_check(texts, "text", sentinels, "s", few=few)
        assert sorted((r.n, r.s) for r in found.collect()) == want
        assert exchanges(found) == 0
    assert rd.leak_check(texts, "text", sentinels.where("false"), "s").collect() == []


def test_codes_are_decoded_in_the_row_of_their_show(spark):
    rows = [("s", 0, 0, "F", "Identity-H", b"\xd8\x01\xd8\x01\x00A\xff\xff\xd8\x01"), ("s", 0, 1, "F", "Identity-H", b"\x00A\x00C"), ("s", 0, 2, "Z", None, b"AB"), ("s", 0, 3, "none", None, b"A"),
            ("s", 0, 4, "none", None, b""), ("s", 0, 5, "F", "Identity-H", b"\x00A\x00"), ("s", 0, 6, "B", None, b"ABA"), ("s", 0, 7, "F", "Identity-H", None)]
    shows = spark.createDataFrame(rows, "source_key string, page_index int, op_index int, font string, encoding string, bytes binary")
    pairs = [("F", 0xD801, 0x1F600), ("F", 65, 97), ("F", 0xFFFF, 0xF0041), ("F", 66, None), ("F", 70000, 98), ("Z", 65, 0), ("Z", 66, 98), ("B", 65, 0xFEFF), ("B", 66, 0x10FFFF)]
    cmap = spark.createDataFrame([("s", *p) for p in pairs], "source_key string, font string, cid int, cp int")
    found = decode_both(shows, cmap, map_keys=["source_key", "font"])
    assert "op_index" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    got = {r.op_index: (r.decoded, r.lenient) for r in found.collect()}
    same = lambda t: (t, t)
    assert got == {0: same("\U0001f600\U0001f600a\U000f0041\U0001f600"), 1: (None, "a"), 2: same("\0b"), 3: (None, ""), 4: same(""), 5: (None, "a"), 6: same("\ufeff\U0010ffff\ufeff"), 7: same(None)}


def test_fallback_chunks_are_cut_in_the_row_of_their_text(spark):
    texts = ["ab1 \U0001f600\U0001f600c\n\nd", "", None, "abc", "--", "]^-\\a", "\u00e9a\u00e9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for letters in ("abcd", "a\U0001f600^]-\\", ""):
        cover = spark.createDataFrame([(c,) for c in letters], "ch string")
        want = []
        for k, t in enumerate(texts):
            fonts = ["primary" if c in letters else "fallback" for c in t or ""]
            starts = [i for i in range(len(fonts)) if i == 0 or fonts[i] != fonts[i - 1]]
            want += [(k, n + 1, fonts[i], t[i:j]) for n, (i, j) in enumerate(zip(starts, [*starts[1:], len(fonts)]))]
        for most in (256, -1):
            found = font_fallback_chunks(rows, cover, ["k"], "t", most)
            assert sorted((r.k, r.chunk, r.font, r.text) for r in found.collect()) == sorted(want)
        assert exchanges(font_fallback_chunks(rows, cover, ["k"], "t")) == 0
