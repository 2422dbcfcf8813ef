"""Golden strings and scalars."""

from pyspark.sql import functions as F

from pageframe.functions import script as sc
from pageframe.functions import text as tx
from pageframe.operators.spans import merge_spans, spans_by_line


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


def test_rtl_lines(spark):
    cases = {
        "ހެނދުނު 00:9 ގައި": "ހެނދުނު 9:00 ގައި",
        "ހެނދުނު 00: 9 ގައި": "ހެނދުނު 9:00 ގައި",
        "ތާރީޚް 2026/1/14": "ތާރީޚް 14/1/2026",
        "ބަސް ، ބުދަ ؛ އެއް ؟ ނޫން !": "ބަސް، ބުދަ؛ އެއް؟ ނޫން!",
        "ދުވަސް ( ބުރުނު ) [ 8 ]": "ދުވަސް (ބުރުނު) [8]",
    }
    for given, wanted in cases.items():
        assert one(spark, given, lambda c: sc.normalise_rtl_line(c, F.lit(True))) == wanted
    assert one(spark, "morning 00:9, test", lambda c: sc.normalise_rtl_line(c, F.lit(False))) == "morning 00:9, test"


def test_scripts(spark):
    assert one(spark, "abc ދި", sc.script_of) == "rtl"
    assert one(spark, "12", sc.script_of) == "ltr"
    assert one(spark, " ", sc.script_of) == "unknown"
    assert one(spark, "ދި 12", sc.is_mixed_script) is False
    assert one(spark, "qwPF(", sc.latin_to_thaana) == "ްއ÷ﷲ)"
    assert len(sc.KEYS) == len(sc.THAANA) == 63


def test_fonts(spark):
    font = lambda c: tx.resolve_font(c, F.lit("ދި"))
    assert one(spark, "ABCDEE+Faruma", font) == "Faruma"
    assert one(spark, "BCDEEE+TimesNewRomanPSMT", font) == "Times New Roman"
    assert one(spark, "Mystery", font) == "Faruma"


def test_spans(spark):
    style = "struct<font_family:string,font_size:double,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,dir:string,color:array<double>>"
    bold = (None, None, True, None, None, None, None, None)
    italic = (None, None, None, True, None, None, None, None)
    df = spark.createDataFrame([("b", 0, "one\ntwo", bold), ("b", 1, " three", italic)], f"k string, seq long, text string, style {style}")
    parts = sorted((r.line_in_block, r.seq, r.text) for r in spans_by_line(df, ["k"]).collect())
    assert parts == [(0, 0, "one"), (1, 0, "two"), (1, 1, " three")]
    rows = spark.createDataFrame([("b", 0, "a", bold), ("b", 1, "", italic), ("b", 2, "b", bold), ("b", 3, "c", None)], f"k string, seq long, text string, style {style}")
    assert [r.text for r in merge_spans(rows, ["k"]).orderBy("island").collect()] == ["ab", "c"]


def test_wrap_pattern_cuts_at_every_kind_of_space(spark):
    from pageframe.functions.script import SPACE_CLASS

    text = F.concat_ws("x", F.transform(F.sequence(F.lit(1), F.lit(0xD7FF)), lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")))
    rows = spark.range(1).select(text.alias("t"))
    want = F.regexp_extract_all("t", F.lit(tx.WRAP_TOKEN), 0)
    assert rows.select((tx.wrap_tokens(F.col("t")) == want).alias("same"), F.size(want).alias("n")).first() == (True, 2 * 24 + 1)
    assert "Zs" in tx.WRAP_PATTERN and SPACE_CLASS in tx.WRAP_PATTERN
