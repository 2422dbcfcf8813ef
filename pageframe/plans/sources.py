"""Plans over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.operators.cmap import explode_cmap
from pageframe.plans.registry import plan
from pageframe.session import fresh_path
from pageframe.sources import bridge, layout
from pageframe.sources.bridge import duck


@plan("src_1", duck("""
    SELECT 'items' AS tab, count(*) AS n, sum(x) AS sx, sum(width) AS sw FROM {items}
    UNION ALL SELECT 'redactions', count(*), sum(rx), sum(rw) FROM {redactions}"""))
def src_1(spark, sf):
    """Write layout tables, read them back by declared schema."""
    items = bridge.items(spark, sf).withColumn("gap_left", F.lit(None).cast("double")).withColumn(
        "gap_right", F.lit(None).cast("double")).withColumn("op_indices", F.array("index"))
    reds = bridge.redactions(spark, sf).withColumnRenamed("red_id", "id").withColumnRenamed("red", "rect")
    path = fresh_path(spark, "layout")
    keep = ["source_key", "page_index", "index", "str", "x", "y", "width", "height", "gap_left", "gap_right", "op_indices"]
    items.select(*keep).write.parquet(f"{path}/items")
    reds.select("id", "source_key", "page_index", "rect").write.parquet(f"{path}/redactions")
    tables = layout.read_layout(spark, path)
    a = tables["items"].agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("width").alias("sw"))
    b = tables["redactions"].agg(F.count("*").alias("n"), F.sum("rect.x").alias("sx"), F.sum("rect.w").alias("sw"))
    return a.withColumn("tab", F.lit("items")).unionByName(b.withColumn("tab", F.lit("redactions")))


@plan("src_2", duck("SELECT source_key, page_index, index, str, x, y, width, height FROM {items}"))
def src_2(spark, sf):
    return bridge.items(spark, sf).select("source_key", "page_index", "index", "str", "x", "y", "width", "height")


@plan("src_3", duck("""
    WITH f AS (SELECT concat('doc', doc_id, '.pdf') AS name, n_chars * 10000 AS size, n_chars // 100 AS pages
               FROM documents),
         m AS (SELECT *, size / 1048576e0 AS mib FROM f),
         t AS (SELECT *, CASE WHEN size <= 0 THEN '0 MB' WHEN mib < 10 THEN concat(printf('%.1f', mib), ' MB')
                         ELSE concat(CAST(floor(mib + 0.5e0) AS BIGINT), ' MB') END AS shown FROM m)
    SELECT name, CASE
        WHEN size > 157286400 THEN concat(name, ' is ', shown,
             '; this browser build currently supports PDFs up to 150 MB.')
        WHEN pages > 250 THEN concat(name, ' has ', pages,
             ' pages; this browser build currently supports up to 250 pages at a time.') END AS reason, shown
    FROM t"""))
def src_3(spark, sf):
    files = bridge.table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), "doc_id", F.lit(".pdf")).alias("name"),
        (F.col("n_chars") * 10000).alias("length"),
        F.floor(F.col("n_chars") / 100).alias("page_count"),
    )
    accepted, rejected = layout.admit(files)
    both = accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("name", "reason", layout.format_megabytes(F.col("length")).alias("shown"))


@plan("src_5", """
    WITH RECURSIVE d(doc_id, source, size, n) AS (SELECT doc_id, source, n_chars,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 FROM documents),
      b(doc_id, source, size, n, rest, txt) AS (SELECT *, n, '' FROM d
        UNION ALL SELECT doc_id, source, size, n, rest // 36,
            concat(substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(rest % 36 AS INT) + 1, 1), txt)
        FROM b WHERE rest > 0)
    SELECT doc_id, CASE WHEN n = 0 THEN 'primary' ELSE concat('ext:doc', doc_id, ':', size, ':', txt) END AS source_key
    FROM b WHERE rest = 0""")
def src_5(spark, sf):
    """Each source of the corpus is one session; its documents are numbered by a block scan."""
    from pageframe.operators.scan import with_running

    docs = bridge.table(spark, sf, "documents").select(
        "doc_id", "source", F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("n_chars").alias("size"))
    numbered = with_running(docs, ["source"], "doc_id", {"n": ("sum", F.lit(1))})
    numbered = numbered.withColumn("n", F.col("n") - 1)
    return layout.assign_source_key(numbered, "source", "n").select("doc_id", "source_key")


@plan("src_6", """
    WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('89504E47', hex(encode(text)))
                 WHEN 1 THEN concat('FFD8FF', hex(encode(text))) WHEN 2 THEN hex(encode(text)) ELSE 'FFD8FF' END AS h,
                 CASE WHEN doc_id % 5 = 0 THEN 'DCTDecode' END AS filter_name FROM documents),
    s AS (SELECT *, CASE WHEN length(h) < 8 THEN NULL WHEN h LIKE '89504E47%' THEN 'png'
                 WHEN h LIKE 'FFD8FF%' THEN 'jpeg' END AS format FROM b)
    SELECT doc_id, format, CASE WHEN filter_name = 'DCTDecode' THEN 'jpeg' ELSE format END AS stream_format FROM s""")
def src_6(spark, sf):
    docs = bridge.table(spark, sf, "documents").select("doc_id", "text")
    body = F.hex(F.encode("text", "UTF-8"))
    kind = F.col("doc_id") % 4
    content = F.unhex(
        F.when(kind == 0, F.concat(F.lit("89504E47"), body)).when(kind == 1, F.concat(F.lit("FFD8FF"), body))
        .when(kind == 2, body).otherwise("FFD8FF"))
    filter_name = F.when(F.col("doc_id") % 5 == 0, "DCTDecode")
    return docs.select("doc_id", layout.sniff_image(content).alias("format"),
                       layout.sniff_stream(content, filter_name).alias("stream_format"))


@plan("src_7", duck("""
    WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'primary' ELSE source_key END AS source_key,
                      doc_id, page_index FROM {lines})
    SELECT doc_id, source_key, page_index, 'page' AS kind, CASE WHEN source_key = 'primary'
           THEN concat('slot-page-primary-', page_index)
           ELSE concat('slot-page-', source_key, '-', page_index, '-', page_index + 1) END AS slot_id FROM p"""))
def src_7(spark, sf):
    rows = bridge.lines(spark, sf)
    pages = rows.select(
        F.when(F.col("doc_id") % 3 == 0, "primary").otherwise(F.col("source_key")).alias("source_key"),
        "doc_id", "page_index").distinct()
    return layout.slots_from_source(pages).select("doc_id", "source_key", "page_index", "kind", "slot_id")


@plan("src_8", """
    WITH RECURSIVE d(conv_id, turn, stamp) AS (
        SELECT conv_id, turn, conv_id * 1000 + 1700000000000 FROM conversations WHERE role = 'system'),
      b(conv_id, turn, rest, txt) AS (SELECT conv_id, turn, stamp, '' FROM d
        UNION ALL SELECT conv_id, turn, rest // 36,
            concat(substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(rest % 36 AS INT) + 1, 1), txt)
        FROM b WHERE rest > 0)
    SELECT conv_id, concat('slot-blank-', txt, '-', turn + 1) AS slot_id, 'blank' AS kind,
           concat('__blank__:slot-blank-', txt, '-', turn + 1) AS source_key, true AS is_blank,
           concat('slot-blank-', txt, '-', turn + 1) AS decoded, 595e0 AS w, 842e0 AS h FROM b WHERE rest = 0""")
def src_8(spark, sf):
    turns = bridge.table(spark, sf, "conversations").where("role = 'system'")
    sized = turns.select("conv_id", "turn", F.lit(595.0).alias("w"), F.lit(842.0).alias("h"))
    blanks = layout.blank_slots(sized, F.col("conv_id") * 1000 + F.lit(1700000000000), F.col("turn") + 1)
    key = F.col("source_key")
    return blanks.select("conv_id", "slot_id", "kind", "source_key", layout.is_blank_source_key(key).alias("is_blank"),
                         layout.blank_slot_id(key).alias("decoded"), "w", "h")


@plan("src_9", duck("""
    SELECT concat('doc', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END) AS filename,
           concat('doc', doc_id, '.edited.pdf') AS result, count(*) AS n, sum(width) AS total
    FROM {items} GROUP BY doc_id"""))
def src_9(spark, sf):
    items = bridge.items(spark, sf).select("source_key", "doc_id", "page_index", "index", "str", "x", "y", "width")
    path = fresh_path(spark, "result")
    layout.write_result({"items": items}, path, buckets=8)
    back = spark.read.schema(items.schema).parquet(f"{path}/items")
    filename = F.concat(F.lit("doc"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".PDF"))
    totals = back.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("width").alias("total"))
    return totals.select(filename.alias("filename"), layout.result_name(filename).alias("result"), "n", "total")


@plan("src_10", """
    WITH u AS (SELECT p_partkey % 50 AS font, p_partkey // 50 AS j, 16 + (p_partkey // 50) * 5 AS lo FROM part),
    chars AS (SELECT font, lo AS cid, 1920 + lo % 60 AS cp, 0 AS pass FROM u WHERE j % 3 = 0),
    spans AS (SELECT font, lo + unnest(generate_series(0, 6)) AS cid, 1700 + lo AS base, lo FROM u WHERE j % 3 = 1),
    arrs AS (SELECT font, lo AS cid, 1958 AS cp, lo FROM u WHERE j % 3 = 2
             UNION ALL SELECT font, lo + 1, 32, lo FROM u WHERE j % 3 = 2),
    alls AS (SELECT font, cid, cp, 0 AS pass, cid AS pos FROM chars
        UNION ALL SELECT font, cid, base + cid - lo, 1, lo FROM spans UNION ALL SELECT font, cid, cp, 1, lo FROM arrs)
    SELECT concat('F', font) AS font, cid, arg_max(cp, pass * 100000 + pos) AS cp FROM alls GROUP BY font, cid""")
def src_10(spark, sf):
    """ToUnicode text composed from the part table, one font per fifty parts."""
    parts = bridge.table(spark, sf, "part").select(
        (F.col("p_partkey") % 50).alias("font"), F.floor(F.col("p_partkey") / 50).alias("j"))
    lo = F.lit(16) + F.col("j") * 5
    # Four digits hold codes up to FFFF; larger ones take eight, as lpad would cut them.
    code = lambda v: F.concat(F.lit("<"), F.lpad(F.hex(v), F.when(v > 0xFFFF, 8).otherwise(4), "0"), F.lit(">"))
    char = F.concat_ws(" ", code(lo), code(F.lit(1920) + lo % 60))
    span = F.concat_ws(" ", code(lo), code(lo + 6), code(F.lit(1700) + lo))
    arr = F.concat(code(lo), F.lit(" "), code(lo + 1), F.lit(" [<07A6> <0020>]"))
    kind = F.col("j") % 3
    gathered = parts.groupBy("font").agg(
        F.array_sort(F.collect_list(F.struct("j", F.when(kind == 0, char).alias("t")))).alias("chars"),
        F.array_sort(F.collect_list(F.struct("j", F.when(kind == 1, span).when(kind == 2, arr).alias("t")))).alias("ranges"))
    body = lambda c: F.array_join(F.filter(F.transform(c, lambda s: s["t"]), lambda t: t.isNotNull()), "\n")
    text = F.concat(F.lit("1 beginbfchar\n"), body("chars"), F.lit("\nendbfchar\n1 beginbfrange\n"), body("ranges"),
                    F.lit("\nendbfrange"))
    fonts = gathered.select(F.concat(F.lit("F"), "font").alias("font"), text.alias("to_unicode"))
    return explode_cmap(fonts, ["font"], "to_unicode").select("font", "cid", "cp")
