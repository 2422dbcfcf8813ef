"""Plans over the edit log and page order."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageframe.functions.geometry import rect
from pageframe.operators import edits as ed
from pageframe.operators import pages as pg
from pageframe.operators.reducer import reduce_items
from pageframe.plans.registry import plan
from pageframe.sources import bridge
from pageframe.sources.bridge import duck
from pageframe.sources.layout import line_items

_ACTIONS = ["setEdit", "setEdit", "setImageMove", "markImageDeleted", "setEditingRun", "addTextInsert", "patchTextInsert", "deleteTextInsert", "addImageInsert", "patchImageInsert",
            "deleteImageInsert", "markShapeDeleted", "addAnnotation", "mergeAnnotations", "patchAnnotation", "deleteAnnotation", "setFormValue", "addRedaction", "patchRedaction", "deleteRedaction"]
_ACTION_SQL = "CASE WHEN seq % 1900 = 7 THEN 'replaceAll' ELSE list_extract([" + ", ".join(f"'{a}'" for a in _ACTIONS) + "], CAST(k % 20 AS INT) + 1) END"
_HOURS6 = 6 * 3600 * 1000


def _log(spark, sf):
    df = bridge.view(spark, sf, "edit_log")
    action = F.when(F.col("seq") % 1900 == 7, "replaceAll").otherwise(F.get(F.array(*[F.lit(a) for a in _ACTIONS]), F.col("k") % 20))
    slot = F.concat(F.lit("p"), F.col("seq") % 3)
    return df.select(F.col("slot_id").alias("doc"), "seq", "ts", action.alias("action"), slot.alias("slot_id"), F.concat(F.lit("i"), F.col("seq") % 4).alias("id"),
                     F.when(F.col("seq") % 11 != 0, F.col("dx").cast("string")).alias("value"), F.col("action").alias("key"), "k", "dx")


@plan("win_7", duck(f"""
    WITH l AS (SELECT slot_id AS doc, seq, ts, CASE WHEN k % 9 = 0 THEN NULL ELSE action END AS key FROM {{edit_log}}),
    m AS (SELECT *, CASE WHEN key IS NULL OR lag(key) OVER w IS NULL OR key <> lag(key) OVER w OR epoch_ms(ts) - epoch_ms(lag(ts) OVER w) >= {_HOURS6} THEN 1 ELSE 0 END AS o FROM l WINDOW w AS (PARTITION BY doc ORDER BY seq)),
    e AS (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY seq) AS entry FROM m),
    g AS (SELECT doc, entry, min(seq) AS first_seq, max(seq) AS last_seq, any_value(key) AS key, count(*) AS calls FROM e GROUP BY doc, entry)
    SELECT doc, CAST(entry AS BIGINT) AS entry, first_seq, last_seq, key, calls FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY entry DESC) AS rn FROM g) WHERE rn <= 20"""))
def win_7(spark, sf):
    """Events are minutes apart, so the gap is six hours here and the cap twenty."""
    log = bridge.view(spark, sf, "edit_log").select(F.col("slot_id").alias("doc"), "seq", "ts", F.when(F.col("k") % 9 != 0, F.col("action")).alias("key"))
    return ed.coalesce_history(log, gap_ms=_HOURS6, cap=20)


@plan("win_8", duck("""
    WITH RECURSIVE c AS (SELECT slot_id AS doc, seq, CASE action WHEN 'signup' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'record' END AS command, row_number() OVER (PARTITION BY slot_id ORDER BY seq) AS pos FROM {edit_log}),
    r AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS state, CAST([] AS BIGINT[]) AS u, CAST([] AS BIGINT[]) AS d FROM c
        UNION ALL SELECT c.doc, c.pos, c.seq, CASE WHEN command = 'record' THEN c.seq WHEN command = 'undo' AND len(u) > 0 THEN u[len(u)] WHEN command = 'redo' AND len(d) > 0 THEN d[len(d)] ELSE r.state END,
            CASE WHEN command = 'record' THEN list_append(u, r.state)[greatest(1, len(u) - 98):] WHEN command = 'undo' AND len(u) > 0 THEN u[:len(u) - 1] WHEN command = 'redo' AND len(d) > 0 THEN list_append(u, r.state) ELSE u END,
            CASE WHEN command = 'record' THEN CAST([] AS BIGINT[]) WHEN command = 'undo' AND len(u) > 0 THEN list_append(d, r.state) WHEN command = 'redo' AND len(d) > 0 THEN d[:len(d) - 1] ELSE d END
        FROM r JOIN c ON c.doc = r.doc AND c.pos = r.pos + 1)
    SELECT doc, seq, state, CAST(len(u) AS INT) AS undo_depth, CAST(len(d) AS INT) AS redo_depth FROM r WHERE pos > 0"""))
def win_8(spark, sf):
    command = F.when(F.col("action") == "signup", "undo").when(F.col("action") == "error", "redo").otherwise("record")
    log = bridge.view(spark, sf, "edit_log").select(F.col("slot_id").alias("doc"), F.lit(0).alias("session"), "seq", command.alias("command"))
    return ed.undo_redo(log)


@plan("win_19", duck("""
    SELECT slot_id, run_id, arg_max(dx, seq) FILTER (action <> 'error') AS value, max(seq) FILTER (action <> 'error') AS seq,
           coalesce(max(seq) FILTER (action = 'error') > coalesce(max(seq) FILTER (action <> 'error'), -1), false) AS deleted FROM {edit_log} GROUP BY slot_id, run_id"""))
def win_19(spark, sf):
    return ed.last_write_wins(bridge.view(spark, sf, "edit_log"), ["slot_id", "run_id"], F.col("dx"), F.col("action") == "error")


@plan("win_20", duck("""
    SELECT doc, slot_id, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS index, CASE WHEN kind = 'page' THEN row_number() OVER (PARTITION BY doc, source_key, kind ORDER BY pos) - 1 END AS copy_no,
           coalesce(bool_or(drops) OVER (PARTITION BY doc), false) AS reordered
    FROM (SELECT *, CASE WHEN source_key = 'primary' THEN source_page_index < lag(source_page_index) OVER (PARTITION BY doc, source_key ORDER BY pos) END AS drops FROM {slots})"""))
def win_20(spark, sf):
    slots = bridge.view(spark, sf, "slots")
    indexed = pg.slot_index(slots).select("doc", "slot_id", "index")
    copies = pg.copy_cursor(slots).select("doc", "slot_id", "copy_no")
    joined = indexed.join(copies, ["doc", "slot_id"], "left").join(pg.is_reordered(slots), "doc", "left")
    return joined.withColumn("reordered", F.coalesce("reordered", F.lit(False)))


@plan("top_3", duck("SELECT slot_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY seq DESC) AS rn FROM {edit_log}) WHERE rn <= 4"))
def top_3(spark, sf):
    return pg.keep_newest(bridge.view(spark, sf, "edit_log").select("slot_id", "seq"), ["slot_id"], "seq", 4)


@plan("top_1", duck("SELECT slot_id, action, arg_min(run_id, dx * 1000000000 + seq) AS best FROM {edit_log} GROUP BY slot_id, action"))
def top_1(spark, sf):
    log = bridge.view(spark, sf, "edit_log")
    return log.groupBy("slot_id", "action").agg(pg.first_of(F.col("run_id"), F.col("dx"), F.col("seq")).alias("best"))


@plan("top_4", duck("SELECT source_key, page_index, arg_max(str, length(str) * 1000000000 - index) AS longest FROM {items} GROUP BY source_key, page_index"))
def top_4(spark, sf):
    """The lines of a page lie in one task, so tokens are reduced to a row a page before anything is shuffled."""
    items = line_items(bridge.lines(spark, sf))
    return items.groupBy("source_key", "page_index").agg(pg.longest(F.col("str"), F.col("str"), F.col("index")).alias("longest"))


@plan("top_5", duck("""
    WITH i AS (SELECT doc, slot_id, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY doc) AS n FROM {slots}),
    m AS (SELECT doc, slot_id, CASE WHEN n < 2 THEN idx WHEN idx = 0 THEN 1 WHEN idx = 1 THEN 0 ELSE idx END AS idx, n FROM i),
    ins AS (SELECT doc, slot_id, CASE WHEN idx >= least(2, n) THEN idx + 2 ELSE idx END AS idx FROM m UNION ALL SELECT DISTINCT doc, concat('new-', doc, '-', k), least(2, n) + k FROM m, (SELECT unnest([0, 1]) AS k))
    SELECT doc, slot_id, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS index FROM ins WHERE slot_id NOT LIKE '%-3'"""))
def top_5(spark, sf):
    """Swap the first two slots, insert two at 2, delete those numbered 3."""
    indexed = pg.slot_index(bridge.view(spark, sf, "slots")).select("doc", "slot_id", "index")
    docs = indexed.groupBy("doc").agg(F.count("*").alias("n"))
    moved = pg.move_slot(indexed, docs.where("n >= 2").select("doc", F.lit(0).alias("from_index"), F.lit(1).alias("to_index")))
    fresh = docs.select("doc", F.lit(2).alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    fresh = fresh.withColumn("slot_id", F.concat(F.lit("new-"), "doc", F.lit("-"), "n"))
    placed = pg.insert_slots(moved, fresh).withColumn("pos", F.col("index")).drop("index")
    return pg.delete_slots(placed, placed.where("slot_id like '%-3'").select("doc", "slot_id")).select("doc", "slot_id", "index")


@plan("set_5", duck("""
    WITH a AS (SELECT doc, slot_id, pos FROM {slots}), u AS (SELECT doc, slot_id, pos FROM a WHERE pos % 2 = 0
        UNION ALL SELECT b.doc, concat(b.slot_id, 'b'), b.pos + coalesce(m.s, 0) FROM a b LEFT JOIN (SELECT doc, max(pos) + 1 AS s FROM a WHERE pos % 2 = 0 GROUP BY doc) m ON m.doc = b.doc WHERE b.pos % 2 = 1)
    SELECT doc, slot_id, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS index FROM u"""))
def set_5(spark, sf):
    slots = bridge.view(spark, sf, "slots").select("doc", "slot_id", "pos")
    b = slots.where("pos % 2 = 1").withColumn("slot_id", F.concat("slot_id", F.lit("b")))
    return pg.concat_slots(slots.where("pos % 2 = 0"), b).select("doc", "slot_id", "index")


@plan("edt_1", duck(f"""
    WITH RECURSIVE l AS (SELECT slot_id AS doc, seq, {_ACTION_SQL} AS action, concat('p', seq % 3) AS slot, concat('i', seq % 4) AS id, CASE WHEN seq % 11 <> 0 THEN CAST(dx AS VARCHAR) END AS value FROM {{edit_log}}),
    v AS (SELECT l.* FROM l LEFT JOIN (SELECT doc, max(seq) AS rs FROM l WHERE action = 'replaceAll' GROUP BY doc) r USING (doc) WHERE rs IS NULL OR seq > rs),
    b AS (SELECT *, CASE WHEN action = 'setEdit' THEN 'edits' WHEN action IN ('setImageMove', 'markImageDeleted') THEN 'image_moves' WHEN action = 'setEditingRun' THEN 'editing' WHEN action LIKE '%TextInsert' THEN 'text_inserts'
        WHEN action LIKE '%ImageInsert' THEN 'image_inserts' WHEN action = 'markShapeDeleted' THEN 'shape_deletes' WHEN action LIKE '%Annotation%' THEN 'annotations' WHEN action = 'setFormValue' THEN 'form_values' ELSE 'redactions' END AS bucket FROM v),
    s AS (SELECT doc, bucket, slot, CASE WHEN bucket = 'annotations' THEN '' WHEN bucket = 'editing' THEN '' ELSE id END AS grp, id, action, value, seq, row_number() OVER (PARTITION BY doc, bucket, slot, CASE WHEN bucket IN ('annotations', 'editing') THEN '' ELSE id END ORDER BY seq) AS pos FROM b),
    r AS (SELECT DISTINCT doc, bucket, slot, grp, CAST(0 AS BIGINT) AS pos, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS m, false AS deleted FROM s
        UNION ALL SELECT s.doc, s.bucket, s.slot, s.grp, s.pos, CASE
            WHEN s.action = 'mergeAnnotations' THEN MAP([s.id], [coalesce(s.value, '~')])
            WHEN s.action = 'setEditingRun' THEN CASE WHEN s.value IS NULL THEN CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) ELSE MAP([''], [s.value]) END
            WHEN s.action = 'markImageDeleted' THEN CASE WHEN map_contains(r.m, s.id) THEN r.m ELSE MAP([s.id], ['~']) END
            WHEN s.action LIKE 'set%' OR s.action LIKE 'add%' OR s.action = 'markShapeDeleted' THEN map_concat(r.m, MAP([s.id], [coalesce(s.value, '~')]))
            WHEN s.action LIKE 'patch%' THEN CASE WHEN map_contains(r.m, s.id) AND s.value IS NOT NULL THEN map_concat(r.m, MAP([s.id], [s.value])) ELSE r.m END
            ELSE map_from_entries(list_filter(map_entries(r.m), lambda e: e.key <> s.id)) END,
            CASE WHEN s.action = 'markImageDeleted' THEN true WHEN s.action = 'setImageMove' THEN false ELSE s.bucket = 'shape_deletes' END
        FROM r JOIN s ON s.doc = r.doc AND s.bucket = r.bucket AND s.slot = r.slot AND s.grp = r.grp AND s.pos = r.pos + 1),
    f AS (SELECT doc, bucket, slot, grp, arg_max(m, pos) AS m, arg_max(deleted, pos) AS deleted FROM r GROUP BY ALL)
    SELECT doc, bucket, slot AS slot_id, e.key AS id, CASE WHEN e.value <> '~' THEN e.value END AS value, deleted FROM (SELECT *, unnest(map_entries(m)) AS e FROM f)""".replace("{{", "{").replace("}}", "}").replace("MAP {}", "MAP {}")))
def edt_1(spark, sf):
    return ed.reduce_log(_log(spark, sf))


_ITEM = "CASE WHEN action LIKE '%TextInsert' THEN 'text_inserts' WHEN action LIKE '%ImageInsert' THEN 'image_inserts' WHEN action LIKE '%Annotation%' THEN 'annotations' WHEN action LIKE '%Redaction' THEN 'redactions' END"


@plan("edt_1_items", duck(f"""
    WITH RECURSIVE l AS (SELECT slot_id AS doc, seq, {_ACTION_SQL} AS action, concat('p', seq % 3) AS slot, concat('i', seq % 4) AS id, CASE WHEN seq % 5 < 3 THEN CAST(k % 4 AS VARCHAR) END AS pos,
            CASE WHEN seq % 11 <> 0 THEN map_from_entries([(concat('f', k % 3), CAST(dx AS VARCHAR))]) ELSE CAST(map_from_entries([]) AS MAP(VARCHAR, VARCHAR)) END AS f FROM {{edit_log}}),
    resets AS (SELECT doc, max(seq) AS rs FROM l WHERE action = 'replaceAll' GROUP BY doc),
    v AS (SELECT l.*, {_ITEM} AS bucket FROM l LEFT JOIN resets USING (doc) WHERE (rs IS NULL OR seq > rs)
        UNION ALL SELECT doc, rs, 'add', 'p0', 'i1', NULL, map_from_entries([('restored', CAST(rs AS VARCHAR))]), b FROM resets, (SELECT unnest(['text_inserts', 'image_inserts', 'annotations', 'redactions']) AS b)),
    a AS (SELECT *, action LIKE 'patch%' AND bucket <> 'redactions' AND pos IN ('0', '1') AND concat('p', pos) <> slot AS moves FROM v WHERE bucket IS NOT NULL),
    s AS (SELECT doc, bucket, action, concat(slot, '|') AS slot, id, concat(CASE WHEN moves THEN concat('p', pos) ELSE slot END, '|', id) AS target,
            CASE WHEN moves THEN map_concat(f, map_from_entries([('sourceKey', concat('src', pos)), ('pageIndex', CAST(CAST(pos AS INT) + 10 AS VARCHAR))]))
                WHEN pos IS NOT NULL AND action LIKE 'patch%' AND bucket = 'redactions' THEN map_concat(f, map_from_entries([('sourceKey', 'any'), ('pageIndex', pos)])) ELSE f END AS f,
            row_number() OVER (PARTITION BY doc, bucket ORDER BY seq) AS n FROM a),
    r AS (SELECT DISTINCT doc, bucket, CAST(0 AS BIGINT) AS n, CAST(map_from_entries([]) AS MAP(VARCHAR, MAP(VARCHAR, VARCHAR))) AS m FROM s
        UNION ALL SELECT s.doc, s.bucket, s.n, CASE
            WHEN s.action = 'mergeAnnotations' THEN map_concat(map_from_entries(list_filter(map_entries(r.m), lambda e: NOT starts_with(e.key, s.slot))), map_from_entries([(concat(s.slot, s.id), s.f)]))
            WHEN s.action LIKE 'add%' THEN map_concat(r.m, map_from_entries([(concat(s.slot, s.id), s.f)]))
            WHEN s.action LIKE 'delete%' THEN map_from_entries(list_filter(map_entries(r.m), lambda e: e.key <> concat(s.slot, s.id)))
            WHEN map_contains(r.m, concat(s.slot, s.id)) THEN map_concat(map_from_entries(list_filter(map_entries(r.m), lambda e: e.key <> concat(s.slot, s.id))),
                map_from_entries([(s.target, map_concat(map_extract(r.m, concat(s.slot, s.id))[1], s.f))])) ELSE r.m END
        FROM r JOIN s ON s.doc = r.doc AND s.bucket = r.bucket AND s.n = r.n + 1),
    f AS (SELECT doc, bucket, arg_max(m, n) AS m FROM r GROUP BY ALL)
    SELECT doc, bucket, string_split(e.key, '|')[1] AS slot_id, string_split(e.key, '|')[2] AS id, array_to_string(list_sort(list_transform(map_entries(e.value), lambda x: concat(x.key, '=', x.value))), ',') AS fields
    FROM (SELECT doc, bucket, unnest(map_entries(m)) AS e FROM f)"""))
def edt_1_items(spark, sf):
    """Inserts, annotations and redactions of every user's log, with moves between two pages, merged fields and restored snapshots."""
    log = _log(spark, sf)
    none = F.create_map().cast("map<string,string>")
    named = F.when(F.col("seq") % 11 != 0, F.create_map(F.concat(F.lit("f"), F.col("k") % 3), F.col("dx").cast("string"))).otherwise(none)
    aim = F.create_map(F.lit("sourceKey"), F.lit("any"), F.lit("pageIndex"), (F.col("k") % 4).cast("string"))
    log = log.withColumn("fields", F.when(F.col("action").startswith("patch") & (F.col("seq") % 5 < 3), F.map_concat(named, aim)).otherwise(named))
    resets = log.where("action = 'replaceAll'").select("doc", "seq")
    buckets = F.explode(F.array(*[F.lit(b) for b in ("text_inserts", "image_inserts", "annotations", "redactions")]))
    snapshots = resets.select("doc", "seq", buckets.alias("bucket"), F.lit("p0").alias("slot_id"), F.lit("i1").alias("id"), F.create_map(F.lit("restored"), F.col("seq").cast("string")).alias("fields"))
    pos = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    slots = log.select("doc").distinct().select("doc", pos.alias("pos")).select(
        "doc", "pos", F.concat(F.lit("p"), "pos").alias("slot_id"), F.when(F.col("pos") < 2, "page").otherwise("blank").alias("kind"), F.concat(F.lit("src"), "pos").alias("source_key"), (F.col("pos") + 10).alias("source_page_index"))
    done = reduce_items(log.select("doc", "seq", "action", "slot_id", "id", "fields"), slots, snapshots)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return done.select("doc", "bucket", "slot_id", "id", text.alias("fields"))


@plan("edt_2", duck("""
    WITH a AS (SELECT i.doc, concat('t', i.pos) AS id, i.slot_id, i.source_key, i.source_page_index AS pg, t.slot_id AS s0, t.source_key AS k0, t.source_page_index AS p0, u.slot_id AS s2, u.source_key AS k2, u.source_page_index AS p2
        FROM {slots} i LEFT JOIN {slots} t ON t.doc = i.doc AND t.pos = i.pos % 3 AND t.kind = 'page' AND t.slot_id <> i.slot_id LEFT JOIN {slots} u ON u.doc = i.doc AND u.pos = (i.pos + 2) % 3 AND u.kind = 'page' AND u.slot_id <> i.slot_id)
    SELECT doc, id, coalesce(s0, s2, slot_id) AS slot_id, CASE WHEN s0 IS NOT NULL THEN k0 WHEN s2 IS NOT NULL THEN k2 ELSE source_key END AS source_key, CASE WHEN s0 IS NOT NULL THEN p0 WHEN s2 IS NOT NULL THEN p2 ELSE pg END AS page_index,
           CASE WHEN s0 IS NOT NULL THEN 'v0' ELSE 'v2' END AS value FROM a"""))
def edt_2(spark, sf):
    """Text inserts patched, some of them moved between the slots of their conversation."""
    slots = bridge.view(spark, sf, "slots")
    items = slots.select("doc", F.concat(F.lit("t"), "pos").alias("id"), "slot_id", "source_key", F.col("source_page_index").alias("page_index"), F.substring("text", 1, 12).alias("value"))
    n = F.explode(F.sequence(F.lit(0), F.lit(2)))
    patches = slots.select("doc", "pos", "slot_id", n.alias("n")).select(
        "doc", F.concat(F.lit("t"), "pos").alias("id"), F.col("n").cast("long").alias("seq"), F.col("slot_id").alias("from_slot"),
        F.when(F.col("n") != 1, ((F.col("pos") + F.col("n")) % 3).cast("int")).alias("page_index"), F.when(F.col("n") != 1, "any").alias("source_key"),
        F.concat(F.lit("v"), "n").alias("value"))
    return ed.apply_patches(items, patches, slots)


def _edits(spark, sf):
    """One edit per slot, aimed at a slot two places on; the last slots aim at nothing."""
    slots = bridge.view(spark, sf, "slots")
    goal = F.concat(F.lit("slot-"), "doc", F.lit("-"), F.col("pos") + 2)
    return slots, slots.select(
        "doc", "slot_id", F.concat(F.lit("p"), F.col("source_page_index") + 1, F.lit("-r0")).alias("run_id"), "pos", F.substring("text", 1, 9).alias("text"),
        F.when(F.col("pos") % 3 != 0, goal).alias("target_slot_id"), (F.col("pos") * 2.0).alias("target_x"), F.when(F.col("pos") % 5 != 4, F.lit(7.0)).alias("target_y"),
        F.when(F.col("pos") % 7 == 6, True).alias("deleted"), F.when(F.col("pos") % 2 == 0, "Arial").alias("font_family"), F.lit(None).cast("double").alias("font_size"),
        F.when(F.col("pos") % 2 == 0, True).alias("bold"), F.lit(None).cast("boolean").alias("italic"), F.when(F.col("pos") % 4 == 0, False).alias("underline"), F.lit(None).cast("boolean").alias("strikethrough"))


_E = """
    e AS (SELECT doc, slot_id, pos, substr(text, 1, 9) AS text, source_page_index, CASE WHEN pos % 3 <> 0 THEN concat('slot-', doc, '-', pos + 2) END AS goal, pos * 2e0 AS tx, CASE WHEN pos % 5 <> 4 THEN 7e0 END AS ty, pos % 7 = 6 AS gone FROM {slots})"""


@plan("join_11", duck(f"""WITH {_E} SELECT e.doc, e.slot_id, s.source_key, s.source_page_index AS page_index, t.source_key AS target_source_key, t.source_page_index AS target_page_index
    FROM e JOIN {{slots}} s ON s.doc = e.doc AND s.slot_id = e.slot_id LEFT JOIN {{slots}} t ON t.doc = e.doc AND t.slot_id = e.goal WHERE e.pos <> 1"""))
def join_11(spark, sf):
    slots, edits = _edits(spark, sf)
    return ed.resolve_targets(edits.where("pos <> 1"), slots).select("doc", "slot_id", "source_key", "page_index", "target_source_key", "target_page_index")


def _page_rows(spark, sf):
    slots = bridge.view(spark, sf, "slots").where("kind = 'page'")
    return slots.select("source_key", F.col("source_page_index").alias("page_index")).distinct().withColumn("scale", F.lit(2.0)).withColumn("view_height", F.lit(200.0))


@plan("join_12", duck(f"""WITH {_E} SELECT e.doc, concat(e.slot_id, '::p', e.source_page_index + 1, '-r0') AS key, e.goal AS target_slot_id, e.text, e.tx AS target_x, e.ty AS target_y, 12e0 AS font_size, CASE WHEN e.pos % 2 = 0 THEN 'Arial' ELSE 'Faruma' END AS font_family,
    e.pos % 2 = 0 AS bold, true AS italic, e.pos % 4 <> 0 AS underline, false AS strikethrough FROM e JOIN {{slots}} s ON s.slot_id = e.slot_id AND s.kind = 'page' WHERE e.goal IS NOT NULL AND e.ty IS NOT NULL AND NOT e.gone"""))
def join_12(spark, sf):
    slots, edits = _edits(spark, sf)
    pages = _page_rows(spark, sf)
    runs = pages.select("source_key", "page_index", F.concat(F.lit("p"), F.col("page_index") + 1, F.lit("-r0")).alias("run_id"), F.lit(24.0).alias("height"), F.lit("Faruma").alias("font_family"),
                        F.lit(False).alias("bold"), F.lit(True).alias("italic"), F.lit(True).alias("underline"), F.lit(None).cast("boolean").alias("strikethrough"))
    return ed.text_arrivals(edits, slots, runs, pages)


@plan("join_12_images", duck(f"""WITH {_E} SELECT e.doc, concat(e.slot_id, '::img') AS key, e.goal AS target_slot_id, e.tx AS target_x, 20e0 AS source_left, 80e0 AS source_top, 60e0 AS source_width, 80e0 AS source_height
    FROM e JOIN {{slots}} s ON s.slot_id = e.slot_id AND s.kind = 'page' WHERE e.goal IS NOT NULL AND e.ty IS NOT NULL AND NOT e.gone"""))
def join_12_images(spark, sf):
    slots, edits = _edits(spark, sf)
    pages = _page_rows(spark, sf)
    moves = edits.select("doc", "slot_id", F.lit("img").alias("image_id"), "target_slot_id", "target_x", "target_y", F.lit(5.0).alias("target_w"), F.lit(6.0).alias("target_h"), "deleted")
    images = pages.select("source_key", "page_index", F.lit("img").alias("image_id"), rect(10, 20, 30, 40).alias("rect"))
    return ed.image_arrivals(moves, slots, images, pages).select("doc", "key", "target_slot_id", "target_x", "source_left", "source_top", "source_width", "source_height")


@plan("join_13", duck(f"""WITH {_E} SELECT e.doc, e.slot_id, CAST(t.pos AS INT) AS target_page_index, CASE WHEN e.goal IS NULL OR t.slot_id IS NOT NULL THEN e.tx END AS target_x FROM e LEFT JOIN {{slots}} t ON t.doc = e.doc AND t.slot_id = e.goal"""))
def join_13(spark, sf):
    slots, edits = _edits(spark, sf)
    return ed.clear_stale_targets(edits, slots, ("target_x", "target_y")).select("doc", "slot_id", "target_page_index", "target_x")


@plan("join_14", duck("""
    WITH b AS (SELECT source_key, page_index, line_no // 5 AS blk, list(run_id ORDER BY line_no) AS ids FROM {runs} GROUP BY ALL),
    e AS (SELECT source_key, page_index, run_id, CASE WHEN line_no % 4 = 0 THEN [run_id, 'missing'] END AS own FROM {runs} WHERE line_no % 3 = 0
          UNION ALL SELECT source_key, page_index, concat('b', blk), NULL FROM b WHERE blk % 2 = 0 UNION ALL SELECT source_key, page_index, 'nowhere', NULL FROM b),
    x AS (SELECT DISTINCT e.source_key, e.page_index, e.run_id AS edit_id, unnest(coalesce(e.own, CASE WHEN r.run_id IS NOT NULL THEN [e.run_id] END, b.ids)) AS run_id
        FROM e LEFT JOIN {runs} r ON r.source_key = e.source_key AND r.page_index = e.page_index AND r.run_id = e.run_id LEFT JOIN b ON b.source_key = e.source_key AND b.page_index = e.page_index AND concat('b', b.blk) = e.run_id)
    SELECT x.* FROM x JOIN {runs} r ON r.source_key = x.source_key AND r.page_index = x.page_index AND r.run_id = x.run_id"""))
def join_14(spark, sf):
    runs = bridge.view(spark, sf, "runs").select("source_key", "page_index", "run_id", "line_no")
    blk = F.floor(F.col("line_no") / 5)
    blocks = runs.groupBy("source_key", "page_index", blk.alias("blk")).agg(F.array_sort(F.collect_list(F.struct("line_no", "run_id"))).alias("m"))
    blocks = blocks.select("source_key", "page_index", "blk", F.concat(F.lit("b"), "blk").alias("block_id"), F.transform("m", lambda s: s["run_id"]).alias("run_ids"))
    none = F.lit(None).cast("array<string>")
    edits = runs.where("line_no % 3 = 0").select("source_key", "page_index", "run_id", F.when(F.col("line_no") % 4 == 0, F.array("run_id", F.lit("missing"))).alias("source_run_ids"))
    edits = edits.unionByName(blocks.where("blk % 2 = 0").select("source_key", "page_index", F.col("block_id").alias("run_id"), none.alias("source_run_ids")))
    edits = edits.unionByName(blocks.select("source_key", "page_index", F.lit("nowhere").alias("run_id"), none.alias("source_run_ids")))
    return ed.resolve_edit_runs(edits, runs, blocks).distinct()


@plan("edt_3", duck("""
    SELECT e.doc, e.slot_id, t.slot_id AS target_slot_id, CASE WHEN e.aim IS NOT NULL THEN 'ext' END AS target_source_key FROM (SELECT *, CASE WHEN pos % 3 <> 0 THEN pos + 1 END AS aim FROM {slots}) e LEFT JOIN {slots} t ON t.doc = e.doc AND t.pos = e.aim"""))
def edt_3(spark, sf):
    slots = bridge.view(spark, sf, "slots")
    edits = slots.select("doc", "slot_id", F.when(F.col("pos") % 3 != 0, (F.col("pos") + 1).cast("int")).alias("target_page_index"), F.lit("ext").alias("target_source_key"))
    return ed.normalise_targets(edits, slots)


@plan("edt_5", duck("""
    WITH st AS (SELECT doc, list_extract(['edits', 'image_moves', 'text_inserts', 'form_values'], CAST(pos % 4 AS INT) + 1) AS bucket, CASE WHEN pos % 11 = 10 THEN 'lost' ELSE slot_id END AS slot_id, pos, CASE WHEN pos % 8 = 2 THEN '  ' ELSE substr(text, 1, 5) END AS value,
        CASE WHEN pos % 8 = 1 THEN 0e0 ELSE 3e0 END AS dx, CASE WHEN pos % 5 = 0 THEN concat('slot-', doc, '-', pos + 1) END AS goal FROM {slots})
    SELECT st.doc, st.pos, st.bucket, CASE WHEN st.bucket = 'form_values' THEN st.slot_id ELSE s.source_key END AS source_key, CASE WHEN st.bucket <> 'form_values' THEN s.source_page_index END AS page_index, t.source_key AS target_source_key
    FROM st LEFT JOIN {slots} s ON s.doc = st.doc AND s.slot_id = st.slot_id LEFT JOIN {slots} t ON t.doc = st.doc AND t.slot_id = st.goal
    WHERE (st.bucket = 'form_values' OR s.slot_id IS NOT NULL) AND NOT (st.bucket = 'image_moves' AND st.goal IS NULL AND st.dx = 0) AND NOT (st.bucket = 'text_inserts' AND trim(st.value) = '')"""))
def edt_5(spark, sf):
    slots = bridge.view(spark, sf, "slots")
    pos = F.col("pos")
    null = F.lit(None).cast("double")
    state = slots.select(
        "doc", "pos", F.get(F.array(*[F.lit(b) for b in ("edits", "image_moves", "text_inserts", "form_values")]), (pos % 4).cast("int")).alias("bucket"),
        F.when(pos % 11 == 10, "lost").otherwise(F.col("slot_id")).alias("slot_id"), F.when(pos % 8 == 2, "  ").otherwise(F.substring("text", 1, 5)).alias("value"),
        F.when(pos % 8 == 1, 0.0).otherwise(3.0).alias("dx"), null.alias("dy"), null.alias("dw"), null.alias("dh"),
        F.when(pos % 5 == 0, F.concat(F.lit("slot-"), "doc", F.lit("-"), pos + 1)).alias("target_slot_id"), F.lit(False).alias("deleted"))
    return ed.flatten_payload(state, slots).select("doc", "pos", "bucket", "source_key", "page_index", "target_source_key")


def _run_edits(spark, sf):
    runs = bridge.view(spark, sf, "runs")
    n = F.col("line_no")
    base = runs.select("source_key", "page_index", "run_id", "text", (F.col("left") / 2).alias("pdf_x"), ((F.lit(1684.0) - F.col("baseline_y")) / 2).alias("pdf_y"), F.lit(2.0).alias("scale"),
                       (n % 6 == 5).alias("underline"), F.lit(False).alias("strikethrough"), "line_no")
    edits = base.where("line_no % 2 = 1").select(
        "source_key", "page_index", "run_id", F.when(n % 8 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("new_text"), (n % 10 == 9).alias("deleted"), (n % 12 == 3).alias("styled"),
        F.when(n % 4 == 1, 8.0).alias("dx"), F.lit(4.0).alias("dy"), F.when(n % 14 == 13, F.col("page_index") + 1).alias("target_page_index"),
        F.when(n % 28 == 13, "ext:1").alias("target_source_key"), F.lit(9.0).alias("target_x"), F.lit(11.0).alias("target_y"))
    return base, edits


_RUN_EDITS = """
    e AS (SELECT source_key, page_index, run_id, line_no AS n, text, "left" / 2 AS x, (1684 - baseline_y) / 2 AS y, line_no % 2 = 1 AS edited, CASE WHEN line_no % 8 = 7 THEN concat(text, '!') ELSE text END AS nt FROM {runs}),
    p AS (SELECT *, CASE WHEN NOT edited THEN 'keep' WHEN n % 10 = 9 THEN 'delete' WHEN n % 28 = 13 THEN 'cross_source' WHEN n % 14 = 13 THEN 'cross_page' WHEN nt = text AND n % 12 <> 3 AND n % 6 <> 5 THEN 'move' ELSE 'redraw' END AS plan FROM e)"""


@plan("edt_6", duck(f"WITH {_RUN_EDITS} SELECT source_key, page_index, run_id, plan FROM p WHERE edited"))
def edt_6(spark, sf):
    base, edits = _run_edits(spark, sf)
    joined = edits.join(base.select("source_key", "page_index", "run_id", "text", F.col("underline").alias("decorated")), ["source_key", "page_index", "run_id"])
    return joined.withColumn("plan", ed.classify_edit()).select("source_key", "page_index", "run_id", "plan")


@plan("edt_7", duck(f"""WITH {_RUN_EDITS} SELECT CASE plan WHEN 'cross_source' THEN 'ext:1' ELSE source_key END AS source_key, CASE WHEN plan LIKE 'cross%' THEN page_index + 1 ELSE page_index END AS page_index, run_id, plan, CASE WHEN edited THEN nt ELSE text END AS text,
    CASE WHEN plan LIKE 'cross%' THEN 9e0 WHEN edited AND n % 4 = 1 THEN x + 4 ELSE x END AS pdf_x, CASE WHEN plan LIKE 'cross%' THEN 11e0 WHEN edited THEN y - 2 ELSE y END AS pdf_y FROM p WHERE plan <> 'delete'"""))
def edt_7(spark, sf):
    base, edits = _run_edits(spark, sf)
    return ed.apply_text_edits(base, edits).select("source_key", "page_index", "run_id", "plan", "text", "pdf_x", "pdf_y")


@plan("edt_8", duck("""
    WITH m AS (SELECT *, CASE WHEN line_no % 2 = 1 THEN 'keep' WHEN q_index IS NULL THEN 'fixed' WHEN line_no % 7 = 6 THEN 'delete' WHEN line_no % 8 = 4 THEN 'cross' ELSE 'move' END AS plan FROM {images})
    SELECT source_key, page_index, image_id, plan, CASE plan WHEN 'move' THEN (iw + 32) / iw WHEN 'cross' THEN 77e0 END AS a, CASE plan WHEN 'move' THEN ix + 3 - ix * ((iw + 32) / iw) WHEN 'cross' THEN ix END AS e FROM m"""))
def edt_8(spark, sf):
    images = bridge.view(spark, sf, "images").withColumn("rect", rect(F.col("ix"), F.col("iy"), F.col("iw"), F.col("ih"))).withColumn("scale", F.lit(2.0))
    n = F.col("line_no")
    null = F.lit(None).cast("double")
    moves = images.where("line_no % 2 = 0").select(
        "source_key", "page_index", "image_id", n.alias("move_id"), (n % 7 == 6).alias("deleted"), F.lit(6.0).alias("dx"), null.alias("dy"), F.lit(64.0).alias("dw"), null.alias("dh"),
        F.when(n % 8 == 4, F.col("page_index") + 1).alias("target_page_index"), F.lit(None).cast("string").alias("target_source_key"), null.alias("target_x"), null.alias("target_y"), F.lit(77.0).alias("target_w"), null.alias("target_h"))
    done = ed.apply_image_moves(images, moves)
    return done.select("source_key", "page_index", "image_id", "plan", "cm.a", "cm.e")


@plan("edt_9", duck("""
    WITH k AS (SELECT * FROM {slots} WHERE kind = 'blank' OR source_page_index <> 3)
    SELECT doc, slot_id, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS output_page, CASE kind WHEN 'blank' THEN w ELSE 600e0 + source_page_index END AS pdf_width FROM k"""))
def edt_9(spark, sf):
    pages = _page_rows(spark, sf).where("page_index <> 3").select("source_key", "page_index", (F.col("page_index") + 600.0).alias("pdf_width"), F.lit(800.0).alias("pdf_height"))
    return pg.assemble_pages(bridge.view(spark, sf, "slots"), pages).select("doc", "slot_id", "output_page", "pdf_width")


@plan("agg_5", duck("""
    WITH s AS (SELECT doc, count(*) FILTER (kind = 'page' AND source_key = 'primary') AS p, count(*) FILTER (kind = 'blank') AS b, count(*) FILTER (kind = 'page' AND source_key <> 'primary') AS x FROM {slots} GROUP BY doc),
    o AS (SELECT DISTINCT doc FROM (SELECT doc, source_page_index < lag(source_page_index) OVER (PARTITION BY doc ORDER BY pos) AS d FROM {slots} WHERE kind = 'page' AND source_key = 'primary') WHERE d),
    e AS (SELECT doc, count(*) AS n FROM {slots} WHERE pos % 2 = 0 GROUP BY doc), a AS (SELECT doc, count(*) AS n FROM {slots} WHERE pos % 3 = 0 GROUP BY doc)
    SELECT s.doc, CAST(greatest(0, 4 - p) + b + x + CASE WHEN o.doc IS NULL THEN 0 ELSE 1 END + coalesce(e.n, 0) + coalesce(a.n, 0) AS BIGINT) AS changes FROM s LEFT JOIN o USING (doc) LEFT JOIN e USING (doc) LEFT JOIN a USING (doc)"""))
def agg_5(spark, sf):
    slots = bridge.view(spark, sf, "slots")
    state = slots.where("pos % 2 = 0").select("doc", F.lit("edits").alias("bucket"))
    annots = slots.select("doc", (F.col("pos") % 3 == 0).alias("changed"))
    sources = slots.select("doc").distinct().withColumn("primary_pages", F.lit(4))
    return ed.change_counts(state, slots, sources, annots)


@plan("agg_7", duck("""
    SELECT source_key, page_index, count(*) FILTER (t = 'e') AS edits, count(*) FILTER (t = 'm') AS moves, count(*) FILTER (t = 'r') AS redactions FROM (
        SELECT source_key, page_index, 'e' AS t FROM {runs} WHERE line_no % 9 = 1 UNION ALL SELECT source_key, page_index, 'm' FROM {images} UNION ALL SELECT source_key, page_index, 'r' FROM {redactions}) GROUP BY ALL"""))
def agg_7(spark, sf):
    return ed.group_ops_by_page(edits=bridge.view(spark, sf, "runs").where("line_no % 9 = 1"), moves=bridge.view(spark, sf, "images"), redactions=bridge.redactions(spark, sf))


@plan("agg_11", """
    SELECT source AS source_key, sha256(text) AS asset, min(doc_id) AS owner, count(*) AS uses FROM documents GROUP BY ALL""")
def agg_11(spark, sf):
    docs = bridge.table(spark, sf, "documents").select(F.col("source").alias("source_key"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("bytes"))
    return ed.distinct_assets(docs)


@plan("set_3", duck("""
    WITH gone AS (SELECT source_key, page_index, op_index FROM {ops} WHERE k % 3 = 0 UNION SELECT source_key, page_index, op_index FROM {ops} WHERE op = 'Do')
    SELECT o.source_key, o.page_index, o.op_index, g.op_index IS NOT NULL AS removed FROM {ops} o LEFT JOIN gone g USING (source_key, page_index, op_index) WHERE g.op_index IS NOT NULL OR o.k % 2 = 0"""))
def set_3(spark, sf):
    ops = bridge.view(spark, sf, "ops")
    gone = ed.ops_to_remove(ops.where("k % 3 = 0"), ops.where("op = 'Do'"))
    kept = ed.keep_replacements(ops.where("k % 2 = 0").select("source_key", "page_index", "op_index"), gone)
    return gone.withColumn("removed", F.lit(True)).unionByName(kept.withColumn("removed", F.lit(False)))


@plan("set_4", duck("""
    WITH r AS (SELECT DISTINCT source_key, page_index, concat('Im', i) AS name FROM {ops}, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i))
    SELECT * FROM r WHERE EXISTS (SELECT 1 FROM {ops} o WHERE o.op = 'Do' AND o.source_key = r.source_key AND o.page_index = r.page_index AND concat('Im', o.k % 6) = r.name)"""))
def set_4(spark, sf):
    ops = bridge.view(spark, sf, "ops").withColumn("name", F.concat(F.lit("Im"), F.col("k") % 6))
    resources = ops.select("source_key", "page_index").distinct().select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("Im"), i))).alias("name"))
    return ed.prune_unused(resources, ops)


@plan("set_6", duck("""
    WITH u AS (SELECT source_key, page_index, 'r' AS kind, run_id AS id FROM {runs} WHERE line_no % 10 = 3 UNION SELECT source_key, page_index, 'i', image_id FROM {images} WHERE line_no % 4 <> 0 UNION SELECT source_key, page_index, 's', shape_id FROM {shapes} WHERE line_no % 20 = 0),
    g AS (SELECT source_key, page_index, concat(page_index, ':r=', coalesce(string_agg(id, ',' ORDER BY id) FILTER (kind = 'r'), ''), ':i=', coalesce(string_agg(id, ',' ORDER BY id) FILTER (kind = 'i'), ''), ':s=', coalesce(string_agg(id, ',' ORDER BY id) FILTER (kind = 's'), '')) AS signature FROM u GROUP BY source_key, page_index)
    SELECT *, sha256(signature) AS digest FROM g"""))
def set_6(spark, sf):
    n = F.col("line_no")
    moves = bridge.view(spark, sf, "images").select("source_key", "page_index", "image_id", F.when(n % 4 == 1, 5.0).otherwise(0.0).alias("dx"), F.lit(None).cast("double").alias("dy"), F.lit(0.0).alias("dw"), F.lit(0.0).alias("dh"),
                                                    (n % 4 == 2).alias("deleted"), F.when(n % 4 == 3, "slot").alias("target_slot_id"))
    specs = ed.strip_specs(bridge.view(spark, sf, "runs").where("line_no % 10 = 3"), moves, bridge.view(spark, sf, "shapes").where("line_no % 20 = 0"))
    return specs.select("source_key", "page_index", "signature", "digest")
