"""Layout tables derived from the plain test tables.

Every table has a Spark builder and a DuckDB view of the same meaning, so that
a plan and its SQL twin start from the same rows. Geometry uses whole and half
points, which doubles hold exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.functions.geometry import rect
from pageframe.functions.script import KEYS, THAANA
from pageframe.sources.layout import line_items, text_lines

# Personal data patterns (mail address, telephone or card digits, dotted IP).
PII_PATTERN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
    r"|[+]?[0-9][0-9 ()-]{7,}[0-9]"
)

PARTS_A_SPLIT = 32

# DuckDB views. {name} pulls in another view.
_VIEWS = {
    "lines": """
        SELECT doc_id, lang, source, concat(source, '/', doc_id) AS source_key, n - 1 AS line_no,
               CAST(floor((n - 1) / 50) AS INT) AS page_index, line
        FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""",
    "items": """
        SELECT * EXCLUDE (n), CAST((line_no % 50) * 1000000 + tok_no AS INT) AS index,
               50e0 + "offset" * 6e0 AS x, 800e0 - (line_no % 50) * 14e0 AS y,
               length(str) * 6e0 AS width, 12e0 AS height
        FROM (SELECT *, n - 1 AS tok_no, CAST(coalesce(sum(length(str) + 1) OVER (
                     PARTITION BY doc_id, line_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS INT) AS "offset"
              FROM (SELECT * EXCLUDE (line), unnest(string_split(line, ' ')) AS str,
                           generate_subscripts(string_split(line, ' '), 1) AS n FROM {lines}))
        WHERE str <> ''""",
    "pii": """
        SELECT doc_id, lang, source, source_key, page_index, line_no, k - 1 AS span_no, span,
               CAST(list_sum(list_transform(gaps[:k], lambda g: length(g)))
                    + coalesce(list_sum(list_transform(spans[:k - 1], lambda s: length(s))), 0) AS INT) AS span_start
        FROM (SELECT *, unnest(spans) AS span, generate_subscripts(spans, 1) AS k
              FROM (SELECT *, regexp_extract_all(line, '@PII@') AS spans,
                           string_split_regex(line, '@PII@') AS gaps FROM {lines}))""",
    "redactions": """
        SELECT concat('redact-', doc_id, '-', line_no, '-', span_no) AS red_id, doc_id, lang, source, source_key,
               page_index, line_no, 50e0 + span_start * 6e0 AS rx, 801e0 - (line_no % 50) * 14e0 AS ry,
               length(span) * 6e0 AS rw, 10e0 AS rh
        FROM {pii}""",
    "runs": """
        SELECT doc_id, lang, source, source_key, page_index, line_no,
               concat('p', page_index + 1, '-r', line_no % 50) AS run_id, line AS text,
               100e0 + (line_no % 3) * 4e0 AS "left", 12e0 * length(line) AS width, 24e0 AS height,
               84e0 + (line_no % 50) * 28e0 AS baseline_y, 56e0 + (line_no % 50) * 28e0 AS top, 36e0 AS box_height
        FROM {lines} WHERE line <> ''""",
    "view_items": """
        SELECT doc_id, source_key, page_index, line_no, index, tok_no,
               CASE WHEN tok_no = 0 AND line_no % 3 = 0 THEN '7.2' WHEN doc_id % 2 = 1
                    THEN translate(str, '@KEYS@', '@THAANA@') ELSE str END AS str,
               x * 2e0 + floor(tok_no / 13) * 60e0 AS x, 1684e0 - y * 2e0 AS y,
               CASE WHEN tok_no % 17 = 16 THEN 0e0 ELSE width * 2e0 END AS width, 24e0 AS height
        FROM {items}""",
    "para_runs": """
        SELECT source_key, page_index, line_no, CAST(line_no % 50 AS INT) AS run_no, run_id,
               CASE WHEN line_no % 4 = 0 THEN concat('6.2 ', text) ELSE text END AS text,
               100e0 + CASE WHEN line_no % 13 = 12 THEN 900e0 WHEN line_no % 5 = 3 THEN 60e0 ELSE 0e0 END AS "left",
               CASE WHEN line_no % 13 >= 11 THEN 300e0 ELSE width END AS width, height, box_height,
               baseline_y - CASE WHEN line_no % 13 = 12 THEN 28e0 ELSE 0e0 END AS baseline_y,
               top - CASE WHEN line_no % 13 = 12 THEN 28e0 ELSE 0e0 END AS top,
               CASE WHEN floor(line_no / 7) % 3 = 2 THEN 'Arial' ELSE 'Faruma' END AS font_family,
               line_no % 19 = 0 AS bold, false AS italic, line_no % 2 = 0 AS underline, true AS strikethrough
        FROM {runs}""",
    "shows": """
        SELECT doc_id, source_key, page_index, index AS op_index, x + 2e0 AS x, y + 1e0 AS y, str,
               CASE (doc_id + tok_no) % 3 WHEN 0 THEN 'ABCDEE+Faruma' WHEN 1 THEN 'Helvetica-Bold' ELSE 'ArialMT' END AS base_font,
               (doc_id + tok_no) % 3 = 1 AS bold, false AS italic, concat('F', doc_id % 10) AS font
        FROM {items}""",
    "edit_log": """
        SELECT event_id AS seq, ts, concat('s', user_id) AS slot_id, event_type AS action,
               concat('r', regexp_extract(props, '[0-9]+', 0)) AS run_id,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, CAST(floor(value) AS DOUBLE) AS dx
        FROM events""",
    "slots": """
        SELECT concat('slot-', conv_id, '-', turn) AS slot_id, conv_id AS doc, turn AS pos,
               CASE WHEN role = 'system' THEN 'blank' ELSE 'page' END AS kind,
               CASE WHEN role = 'system' THEN concat('__blank__:slot-', conv_id, '-', turn)
                    WHEN role = 'user' THEN 'primary' ELSE concat('ext:', conv_id % 7) END AS source_key,
               CAST(CASE WHEN role = 'system' THEN 0 ELSE (turn * 3) % 5 END AS INT) AS source_page_index,
               595e0 AS w, 842e0 AS h, text
        FROM conversations""",
    "form_nodes": """
        SELECT 'form' AS source_key, concat('R', r_regionkey) AS node_id, CAST(NULL AS STRING) AS parent_id, r_name AS name,
               CASE WHEN r_regionkey % 2 = 0 THEN 'Tx' END AS ft, CAST(NULL AS INT) AS ff,
               CAST(NULL AS STRING) AS v, false AS is_widget, -1 AS page_index, 0e0 AS x, 0e0 AS y
        FROM region
        UNION ALL
        SELECT 'form', concat('N', n_nationkey), concat('R', n_regionkey), n_name,
               CASE n_nationkey % 4 WHEN 0 THEN 'Tx' WHEN 1 THEN 'Btn' WHEN 2 THEN 'Ch' END,
               CASE n_nationkey % 4 WHEN 0 THEN 4097 WHEN 1 THEN CASE WHEN n_nationkey % 8 = 1 THEN 32768 ELSE 2 END
                    WHEN 2 THEN 131072 + 2097152 END, CAST(NULL AS STRING), false, -1, 0e0, 0e0
        FROM nation
        UNION ALL
        SELECT 'form', concat('C', c_custkey), concat('N', c_nationkey), c_name,
               CASE WHEN c_custkey % 17 = 0 THEN 'Sig' END, CASE WHEN c_custkey % 13 = 0 THEN 65536 + 3 END,
               CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'Off' END, false, -1, 0e0, 0e0
        FROM customer
        UNION ALL
        SELECT 'form', concat('O', o_orderkey), concat('C', o_custkey), CAST(NULL AS STRING), CAST(NULL AS STRING),
               CAST(NULL AS INT), CAST(NULL AS STRING), true, CAST(o_orderkey % 40 AS INT),
               CAST(o_orderkey % 50 AS DOUBLE) * 10, CAST(o_orderkey % 80 AS DOUBLE) * 10
        FROM orders
        UNION ALL
        SELECT 'copy', concat('R', r_regionkey), CAST(NULL AS STRING), CASE WHEN r_regionkey < 4 THEN concat('copy of ', r_name) END,
               CASE WHEN r_regionkey % 2 = 1 THEN 'Ch' END, 2, 'kept', false, -1, 0e0, 0e0
        FROM region
        UNION ALL
        SELECT 'copy', concat('N', n_nationkey), concat('R', (n_regionkey + 1) % 5), n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'Tx' END,
               CAST(NULL AS INT), CAST(NULL AS STRING), false, -1, 0e0, 0e0
        FROM nation
        UNION ALL
        SELECT 'copy', concat('C', c_custkey), concat('N', (c_nationkey + 7) % 25), CASE WHEN c_custkey % 5 > 0 THEN c_name END,
               CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS STRING), c_custkey % 5 = 0, -1, 0e0, 0e0
        FROM customer""",
    "edges": """
        SELECT concat('O', o_orderkey) AS src, concat('C', o_custkey) AS dst FROM orders
        UNION ALL SELECT concat('O', l_orderkey), concat('P', l_partkey) FROM lineitem
        UNION ALL SELECT concat('P', l_partkey), concat('S', l_suppkey) FROM lineitem
        UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey) FROM supplier
        UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey) FROM customer
        UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey) FROM nation
        UNION ALL SELECT concat('R', n_regionkey), concat('N', n_nationkey) FROM nation""",
    "ops": """
        SELECT concat('u', user_id) AS source_key, CAST(floor(event_id / 2500) AS INT) AS page_index,
               event_id AS op_index, k, dx,
               CASE action WHEN 'signup' THEN CASE WHEN k % 5 = 4 THEN 'cm' ELSE 'q' END
                    WHEN 'error' THEN CASE WHEN k % 5 = 4 THEN 'w' ELSE 'Q' END
                    WHEN 'view' THEN CASE k % 10 WHEN 0 THEN 'Tf' WHEN 1 THEN 'Tm' WHEN 2 THEN 'Td' WHEN 3 THEN 'TD'
                         WHEN 4 THEN 'T*' WHEN 5 THEN 'Tc' WHEN 6 THEN 'BT' WHEN 7 THEN 'TL' WHEN 8 THEN 'TJ' ELSE 'Tj' END
                    WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'l' WHEN 2 THEN 're' ELSE 'Do' END
                    ELSE CASE k % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'f' WHEN 2 THEN 'n' ELSE 'Tj' END END AS op
        FROM (SELECT e.*, l.action, l.k, l.dx FROM events e JOIN {edit_log} l ON e.event_id = l.seq)""",
    "shapes": """
        SELECT doc_id, source_key, page_index, line_no, tok_no, concat('p', page_index + 1, '-s', index) AS shape_id,
               CAST(index AS BIGINT) * 4 AS q_index, CAST(index AS BIGINT) * 4 + 3 AS end_index,
               x AS sx, CASE WHEN tok_no % 2 = 0 THEN y - 2e0 ELSE y + 4e0 END AS sy, width AS sw, 1e0 AS sh
        FROM {items} WHERE (doc_id * 31 + line_no * 7 + tok_no) % 7 = 0""",
    "images": """
        SELECT doc_id, source_key, page_index, line_no, concat('p', page_index + 1, '-i', line_no % 50) AS image_id,
               CASE WHEN line_no % 4 = 3 THEN 'Form' ELSE 'Image' END AS subtype,
               CASE WHEN line_no % 5 <> 4 THEN CAST(line_no AS BIGINT) * 10 END AS q_index,
               CAST(line_no AS BIGINT) * 10 + 5 AS do_index, line_no % 3 <> 2 AS plain_raster,
               CASE WHEN line_no % 2 = 0 THEN 48e0 ELSE 250e0 END AS ix, 798e0 - (line_no % 50) * 14e0 AS iy,
               CASE WHEN line_no % 2 = 0 THEN 4096e0 ELSE 128e0 END AS iw, 16e0 AS ih
        FROM {lines} WHERE (doc_id + line_no) % 3 = 0""",
    "annotations": """
        SELECT concat(source_key, ':', line_no) AS id, doc_id, source_key, page_index, line_no,
               CASE line_no % 4 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'FreeText' WHEN 2 THEN 'Ink' ELSE 'Widget' END AS subtype,
               56e0 + (doc_id % 9) * 2e0 AS ax, 799e0 - (line_no % 50) * 14e0 AS ay,
               6e0 * length(line) AS aw, 14e0 AS ah, line AS contents
        FROM {lines} WHERE line <> '' AND (doc_id + line_no) % 2 = 0""",
}
_VIEWS["view_items"] = _VIEWS["view_items"].replace("@KEYS@", KEYS[:-2]).replace("@THAANA@", THAANA[:-2])
_VIEWS["pii"] = _VIEWS["pii"].replace("@PII@", PII_PATTERN.replace("'", "''"))


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\{([a-z_]+)\}", text):
        if name not in seen:
            _needed(_VIEWS[name], seen)
            seen.append(name)
    return seen


def duck(text: str) -> str:
    """DuckDB query text with the derived views it names put in front as a WITH list."""
    names = _needed(text, [])
    body = text
    views = []
    for name in names:
        views.append(f"{name}_v AS ({_VIEWS[name]})")
    whole = ", ".join(views)
    for name in names:
        whole = whole.replace("{" + name + "}", f"{name}_v")
        body = body.replace("{" + name + "}", f"{name}_v")
    if not names:
        return body
    stripped = body.lstrip()
    for lead, joiner in (("WITH RECURSIVE ", "WITH RECURSIVE "), ("WITH ", "WITH ")):
        if stripped.upper().startswith(lead):
            return f"{joiner}{whole}, {stripped[len(lead):]}"
    return f"WITH {whole} {body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than cores (a small file is one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf: str, where=None) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    if where is not None:
        docs = docs.where(where)
    return text_lines(spread(docs), "text").withColumn("source_key", F.concat_ws("/", "source", "doc_id"))


def dealt(line_rows: DataFrame, *keys: str) -> DataFrame:
    """Lines dealt out by the keys, so that windows, groups and joins by them find the tokens made of them in their task.

    Text is many times smaller than its tokens. The number of parts follows the splits of the input, as a number of its
    own would be merged again by the size of the text.
    """
    return line_rows.repartition(PARTS_A_SPLIT * line_rows.rdd.getNumPartitions(), *keys)


def by_page(line_rows: DataFrame) -> DataFrame:
    return dealt(line_rows, "source_key", "page_index")


def paged_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return by_page(text_lines(docs, "text").withColumn("source_key", F.concat_ws("/", "source", "doc_id")))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return line_items(paged_lines(spark, sf))


def view_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items in view pixels. Built without SQL text, under which a union forgets that its rows are dealt out by page."""
    tok, kind = F.col("tok_no"), F.col("line_no") % 3
    text = F.when((tok == 0) & (kind == 0), "7.2").when(
        F.col("doc_id") % 2 == 1, F.translate("str", KEYS[:-2], THAANA[:-2])).otherwise(F.col("str"))
    return items(spark, sf).select(
        "doc_id", "source_key", "page_index", "line_no", "index", "tok_no", text.alias("str"),
        (F.col("x") * 2.0 + F.floor(tok / 13) * 60.0).alias("x"), (F.lit(1684.0) - F.col("y") * 2.0).alias("y"),
        F.when(tok % 17 == 16, 0.0).otherwise(F.col("width") * 2.0).alias("width"), F.lit(24.0).alias("height"))


def shows(spark: SparkSession, sf: str) -> DataFrame:
    """Every token as a show beside its item, in one of three fonts."""
    turn = (F.col("doc_id") + F.col("tok_no")) % 3
    return items(spark, sf).select(
        "doc_id", "source_key", "page_index", F.col("index").alias("op_index"), (F.col("x") + 2.0).alias("x"), (F.col("y") + 1.0).alias("y"), "str",
        F.when(turn == 0, "ABCDEE+Faruma").when(turn == 1, "Helvetica-Bold").otherwise("ArialMT").alias("base_font"),
        (turn == 1).alias("bold"), F.lit(False).alias("italic"), F.concat(F.lit("F"), F.col("doc_id") % 10).alias("font"))


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A thin rule under or through some tokens. Built without SQL text, as view_items is."""
    tok, index = F.col("tok_no"), F.col("index").cast("bigint")
    return items(spark, sf).where((F.col("doc_id") * 31 + F.col("line_no") * 7 + tok) % 7 == 0).select(
        "doc_id", "source_key", "page_index", "line_no", "tok_no",
        F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("-s"), F.col("index")).alias("shape_id"), (index * 4).alias("q_index"), (index * 4 + 3).alias("end_index"),
        F.col("x").alias("sx"), F.when(tok % 2 == 0, F.col("y") - 2.0).otherwise(F.col("y") + 4.0).alias("sy"), F.col("width").alias("sw"), F.lit(1.0).alias("sh"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as text runs. Built without SQL text, as view_items is."""
    row, text = F.col("line_no") % 50, F.col("line")
    return paged_lines(spark, sf).where(text != "").select(
        "doc_id", "lang", "source", "source_key", "page_index", "line_no",
        F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("-r"), row).alias("run_id"), text.alias("text"),
        (F.lit(100.0) + F.col("line_no") % 3 * 4.0).alias("left"), (F.length("line") * 12.0).alias("width"), F.lit(24.0).alias("height"),
        (F.lit(84.0) + row * 28.0).alias("baseline_y"), (F.lit(56.0) + row * 28.0).alias("top"), F.lit(36.0).alias("box_height"))


def pii_of(line_rows: DataFrame) -> DataFrame:
    """Spans of personal data with their character position in the line."""
    found = line_rows.where(F.col("line").rlike(PII_PATTERN))
    spans = F.regexp_extract_all("line", F.lit(PII_PATTERN), 0)
    gaps = F.split("line", PII_PATTERN)
    size = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, p: a + F.length(p))
    exploded = found.select("*", F.posexplode(spans).alias("span_no", "span"))
    start = size(gaps, F.col("span_no") + 1) + size(spans, F.col("span_no"))
    return exploded.withColumn("span_start", start).drop("line")


def redactions_of(line_rows: DataFrame) -> DataFrame:
    """Tight redaction rects over personal data."""
    spans = pii_of(line_rows)
    row = F.col("line_no") % 50
    placed = rect(
        F.lit(50.0) + F.col("span_start") * 6.0, F.lit(801.0) - row * 14.0, F.length("span") * 6.0, F.lit(10.0)
    )
    return spans.select(
        F.concat_ws("-", F.lit("redact"), "doc_id", "line_no", "span_no").alias("red_id"),
        "doc_id", "lang", "source", "source_key", "page_index", "line_no", placed.alias("red"),
    )


def redactions(spark: SparkSession, sf: str) -> DataFrame:
    return redactions_of(lines(spark, sf, F.col("text").rlike(PII_PATTERN)))


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Any other derived table, from the SQL both engines read."""
    builders = {"lines": lines, "items": items, "redactions": redactions, "view_items": view_items, "shows": shows, "shapes": shapes, "runs": runs}
    if name in builders:
        return builders[name](spark, sf)
    text = _VIEWS[name].replace('"left"', "`left`").replace('"offset"', "`offset`")
    frames: dict[str, DataFrame] = {}
    for used in re.findall(r"\{([a-z_]+)\}", text):
        frames[used] = view(spark, sf, used)
    for plain in set(re.findall(r"(?:FROM|JOIN) ([a-z]+)", text)):
        text = re.sub(rf"(FROM|JOIN) {plain}\b", rf"\1 {{{plain}}}", text)
        frames[plain] = table(spark, sf, plain)
    return spark.sql(text, **frames)
