"""Edit log: history, reduction to state, addresses, payload, application to runs and images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions.geometry import image_move_matrix
from pageframe.functions.script import wide_trim
from pageframe.operators.scan import islands, with_running

# History rule and action names by effect.
COALESCE_MS, HISTORY_CAP = 500, 100
RESET = "replaceAll"
BUCKET = {
    "setEdit": "edits", "setImageMove": "image_moves", "markImageDeleted": "image_moves", "setEditingRun": "editing",
    "addTextInsert": "text_inserts", "patchTextInsert": "text_inserts", "deleteTextInsert": "text_inserts",
    "addImageInsert": "image_inserts", "patchImageInsert": "image_inserts", "deleteImageInsert": "image_inserts",
    "markShapeDeleted": "shape_deletes", "addAnnotation": "annotations", "mergeAnnotations": "annotations",
    "patchAnnotation": "annotations", "deleteAnnotation": "annotations", "setFormValue": "form_values",
    "addRedaction": "redactions", "patchRedaction": "redactions", "deleteRedaction": "redactions",
}
SETS = ("setEdit", "setImageMove", "setEditingRun", "addTextInsert", "addImageInsert", "markShapeDeleted", "addAnnotation",
        "mergeAnnotations", "setFormValue", "addRedaction")
PATCHES = ("patchTextInsert", "patchImageInsert", "patchAnnotation", "patchRedaction")
DELETES = ("deleteTextInsert", "deleteImageInsert", "deleteAnnotation", "deleteRedaction")


def coalesce_history(log: DataFrame, doc: str = "doc", gap_ms: int = COALESCE_MS, cap: int = HISTORY_CAP) -> DataFrame:
    """One entry per burst of equal keys, each repeat within the gap extends it; the newest `cap` stay.

    The log carries seq, ts and key; a null key is always an entry of its own.
    """
    apart = (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("_ts").cast("timestamp"))) >= gap_ms
    starts = lambda: F.col("key").isNull() | F.col("_key").isNull() | (F.col("key") != F.col("_key")) | apart
    bursts = islands(log, [doc], "seq", {"_key": "key", "_ts": "ts"}, starts, "entry")
    entries = bursts.groupBy(doc, "entry").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("key", "seq").alias("key"), F.count("*").alias("calls"))
    last = entries.groupBy(doc).agg(F.max("entry").alias("_last"))
    return entries.join(last, doc).where(F.col("entry") > F.col("_last") - cap).drop("_last")


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    undo, redo, out = [], [], []
    current = 0
    for doc, seq, command in rows.sort_values("seq")[["doc", "seq", "command"]].itertuples(index=False):
        if command == "record":
            undo.append(current)
            del undo[:-HISTORY_CAP]
            redo.clear()
            current = seq
        elif command == "undo" and undo:
            redo.append(current)
            current = undo.pop()
        elif command == "redo" and redo:
            undo.append(current)
            current = redo.pop()
        out.append((doc, seq, current, len(undo), len(redo)))
    return pd.DataFrame(out, columns=["doc", "seq", "state", "undo_depth", "redo_depth"])


def undo_redo(commands: DataFrame) -> DataFrame:
    """State (the seq of its record) and stack depths after each record, undo or redo of a document.

    A document without any undo or redo needs no replay: its state is its last
    record. The rest is replayed in order, one editing session of one document at
    a time.
    """
    mixed = commands.groupBy("doc", "session").agg(F.bool_or(F.col("command") != "record").alias("_mixed"))
    marked = commands.join(mixed, ["doc", "session"])
    schema = "doc string, seq bigint, state bigint, undo_depth int, redo_depth int"
    replayed = marked.where("_mixed").groupBy("doc", "session").applyInPandas(_replay, schema)
    plain = with_running(marked.where(~F.col("_mixed")), ["doc", "session"], "seq", {"_n": ("sum", F.lit(1))})
    simple = plain.select("doc", "seq", F.col("seq").alias("state"), F.least(F.col("_n"), F.lit(HISTORY_CAP)).cast("int").alias("undo_depth"),
                          F.lit(0).alias("redo_depth"))
    return replayed.unionByName(simple)


def last_write_wins(log: DataFrame, keys: list[str], value: Column, deleted: Column) -> DataFrame:
    """Newest value per key; a delete mark after it merges into it. One map-side combined aggregate."""
    write = F.when(~deleted, F.col("seq"))
    return log.groupBy(*keys).agg(
        F.max_by(value, write).alias("value"), F.max(write).alias("seq"),
        F.coalesce(F.max(F.when(deleted, F.col("seq"))) > F.coalesce(F.max(write), F.lit(-1)), F.lit(False)).alias("deleted"))


def reduce_log(log: DataFrame) -> DataFrame:
    """Content after a log of actions, as one row per live entry with its bucket.

    The log carries doc, seq, action, slot_id, id, value. Everything up to the
    last reset of a document is void. Sets and adds start an entry, patches
    change a value that is there, deletes end it, a merge replaces the
    annotations of its slot, marking an image keeps its move.
    """
    resets = log.where(F.col("action") == RESET).groupBy("doc").agg(F.max("seq").alias("_reset"))
    live = log.join(resets, "doc", "left").where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")
    bucket = F.create_map(*[F.lit(x) for pair in BUCKET.items() for x in pair])[F.col("action")]
    rows = live.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    rows = rows.withColumn("id", F.when(F.col("bucket") == "editing", F.lit("")).otherwise(F.col("id")))
    starts = F.when(F.col("action").isin(*SETS), F.col("seq"))
    writes = F.when(F.col("action").isin(*SETS), F.struct(F.col("value").alias("v"))).when(
        F.col("action").isin(*PATCHES) & F.col("value").isNotNull(), F.struct(F.col("value").alias("v")))
    marks = F.when(F.col("action") == "markImageDeleted", F.col("seq"))
    entries = rows.groupBy("doc", "bucket", "slot_id", "id").agg(
        F.max(starts).alias("_set"), F.max_by(writes, F.when(writes.isNotNull(), F.col("seq"))).alias("_value"), F.max(marks).alias("_mark"),
        F.max(F.when(F.col("action").isin(*DELETES), F.col("seq"))).alias("_gone"))
    merges = rows.where(F.col("action") == "mergeAnnotations").groupBy("doc", "bucket", "slot_id").agg(F.max("seq").alias("_merge"))
    joined = entries.join(merges, ["doc", "bucket", "slot_id"], "left")
    born = F.coalesce("_set", F.lit(-1))
    alive = (
        (F.col("_set").isNotNull() | F.col("_mark").isNotNull()) & (F.coalesce("_gone", F.lit(-1)) < F.greatest(born, F.coalesce("_mark", F.lit(-1))))
        & (born >= F.coalesce("_merge", F.lit(-1))) & ~((F.col("bucket") == "editing") & F.col("_value.v").isNull())
    )
    return joined.where(alive).select(
        "doc", "bucket", "slot_id", "id", F.when(F.col("_set").isNotNull(), F.col("_value.v")).alias("value"),
        (F.coalesce(F.col("_mark") > born, F.lit(False)) | (F.col("bucket") == "shape_deletes")).alias("deleted"))


def apply_patches(items: DataFrame, patches: DataFrame, slots: DataFrame) -> DataFrame:
    """Patches on slot items in seq order.

    Items: doc, id, slot_id, source_key, page_index, value. Patches: doc, id, seq,
    from_slot, page_index, source_key, value. A patch that names a page and a
    source moves the item to the slot at that position and takes its address;
    blank or equal slots keep the old address; a patch from a slot that does not
    hold the item changes nothing.
    """
    target = slots.select("doc", F.col("pos").cast("int").alias("page_index"), F.struct(
        "slot_id", "kind", "source_key", F.col("source_page_index").alias("page_index")).alias("target"))
    aimed = patches.join(target, ["doc", "page_index"], "left")
    step = F.struct("seq", "from_slot", (F.col("page_index").isNotNull() & F.col("source_key").isNotNull()).alias("placed"), "source_key", "page_index", "value", "target")
    grouped = aimed.groupBy("doc", "id").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def fold(state: Column, p: Column) -> Column:
        here = state["slot_id"] == p["from_slot"]
        moves = here & p["placed"] & F.coalesce(p["target"]["kind"] == "page", F.lit(False)) & (p["target"]["slot_id"] != p["from_slot"])
        direct = here & ~p["placed"]
        pick = lambda moved, patched, kept: F.when(moves, moved).when(direct, F.coalesce(patched, kept)).otherwise(kept)
        return F.struct(
            F.when(moves, p["target"]["slot_id"]).otherwise(state["slot_id"]).alias("slot_id"),
            pick(p["target"]["source_key"], p["source_key"], state["source_key"]).alias("source_key"),
            pick(p["target"]["page_index"], p["page_index"], state["page_index"]).alias("page_index"),
            F.when(here, F.coalesce(p["value"], state["value"])).otherwise(state["value"]).alias("value"))

    start = F.struct("slot_id", "source_key", "page_index", "value")
    joined = items.join(grouped, ["doc", "id"], "left")
    done = F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, fold))
    return joined.withColumn("_s", done).select("doc", "id", "_s.slot_id", "_s.source_key", "_s.page_index", "_s.value")


def normalise_targets(edits: DataFrame, slots: DataFrame) -> DataFrame:
    """On write: a target position becomes a stable slot id; without one all targets are cleared."""
    at = slots.select("doc", F.col("pos").cast("int").alias("target_page_index"), F.col("slot_id").alias("_slot"))
    joined = edits.join(at, ["doc", "target_page_index"], "left")
    aimed = F.col("target_page_index").isNotNull()
    return joined.withColumn("target_slot_id", F.when(aimed, F.col("_slot"))).withColumn(
        "target_source_key", F.when(aimed, F.col("target_source_key"))).drop("_slot", "target_page_index")


def clear_stale_targets(edits: DataFrame, slots: DataFrame, fields: tuple[str, ...] = ("target_source_key", "target_x", "target_y")) -> DataFrame:
    """On read: a target slot becomes its current position; an unknown one clears all target fields."""
    at = slots.select("doc", F.col("slot_id").alias("target_slot_id"), F.col("pos").cast("int").alias("_pos"))
    joined = edits.join(at, ["doc", "target_slot_id"], "left")
    stale = F.col("target_slot_id").isNotNull() & F.col("_pos").isNull()
    kept = {f: F.when(~stale, F.col(f)) for f in fields}
    return joined.withColumns(kept).withColumn("target_page_index", F.col("_pos")).drop("_pos", "target_slot_id")


def addresses(slots: DataFrame) -> DataFrame:
    """Source and page of every slot; blank slots have a source of their own."""
    return slots.select("doc", "slot_id", "source_key", F.col("source_page_index").alias("page_index"), "kind")


def resolve_targets(edits: DataFrame, slots: DataFrame) -> DataFrame:
    """Edits with source address and target address; rows of missing slots go, missing targets are null."""
    own = addresses(slots).drop("kind")
    goal = own.select("doc", F.col("slot_id").alias("target_slot_id"), F.col("source_key").alias("target_source_key"),
                      F.col("page_index").alias("target_page_index"))
    return edits.join(own, ["doc", "slot_id"]).join(goal, ["doc", "target_slot_id"], "left")


def text_arrivals(edits: DataFrame, slots: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs moved to another slot with the style they are drawn in; sizes in points.

    Edits: doc, slot_id, run_id, text, target_slot_id, target_x, target_y, deleted and style fields font_size, font_family, bold, italic, underline, strikethrough.
    """
    own = addresses(slots).where(F.col("kind") == "page").drop("kind")
    moved = edits.where(F.col("target_slot_id").isNotNull() & ~F.coalesce("deleted", F.lit(False)) & F.col("target_x").isNotNull() & F.col("target_y").isNotNull())
    style = ["font_family", "bold", "italic", "underline", "strikethrough"]
    run = runs.select("source_key", "page_index", "run_id", "height", *[F.col(c).alias(f"_{c}") for c in style])
    joined = moved.join(own, ["doc", "slot_id"]).join(pages.select("source_key", "page_index", "scale"), ["source_key", "page_index"]).join(
        run, ["source_key", "page_index", "run_id"])
    return joined.select(
        "doc", F.concat_ws("::", "slot_id", "run_id").alias("key"), "target_slot_id", "text", "target_x", "target_y",
        F.coalesce("font_size", F.col("height") / F.col("scale")).alias("font_size"),
        F.coalesce("font_family", "_font_family").alias("font_family"), F.coalesce("bold", "_bold").alias("bold"), F.coalesce("italic", "_italic").alias("italic"),
        F.coalesce("underline", "_underline", F.lit(False)).alias("underline"), F.coalesce("strikethrough", "_strikethrough", F.lit(False)).alias("strikethrough"))


def image_arrivals(moves: DataFrame, slots: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images moved to another slot with their crop on the source page in pixels."""
    own = addresses(slots).where(F.col("kind") == "page").drop("kind")
    target = ["target_x", "target_y", "target_w", "target_h"]
    whole = F.lit(True)
    for c in target:
        whole = whole & F.col(c).isNotNull()
    moved = moves.where(F.col("target_slot_id").isNotNull() & ~F.coalesce("deleted", F.lit(False)) & whole)
    joined = moved.join(own, ["doc", "slot_id"]).join(pages.select("source_key", "page_index", "scale", "view_height"), ["source_key", "page_index"]).join(
        images.select("source_key", "page_index", "image_id", "rect"), ["source_key", "page_index", "image_id"])
    s = F.col("scale")
    return joined.select(
        "doc", F.concat_ws("::", "slot_id", "image_id").alias("key"), "target_slot_id", *target, (F.col("rect.x") * s).alias("source_left"),
        (F.col("view_height") - (F.col("rect.y") + F.col("rect.h")) * s).alias("source_top"), (F.col("rect.w") * s).alias("source_width"), (F.col("rect.h") * s).alias("source_height"))


def resolve_edit_runs(edits: DataFrame, runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Runs each edit covers: its own list, else the run it names, else the runs of the block it names.

    Edits: source_key, page_index, run_id, source_run_ids. Blocks: block_id, run_ids.
    """
    page = ["source_key", "page_index"]
    known = runs.select(*page, "run_id")
    direct = edits.join(known.withColumn("_direct", F.lit(True)), [*page, "run_id"], "left")
    block = blocks.select(*page, F.col("block_id").alias("run_id"), F.col("run_ids").alias("_members"))
    both = direct.join(block, [*page, "run_id"], "left").where(F.col("_direct") | F.col("_members").isNotNull())
    ids = F.when(F.size("source_run_ids") > 0, F.col("source_run_ids")).when(F.col("_direct"), F.array("run_id")).otherwise(F.col("_members"))
    covered = both.select(*page, F.col("run_id").alias("edit_id"), F.explode(ids).alias("run_id"))
    return covered.join(known, [*page, "run_id"], "left_semi")


def flatten_payload(state: DataFrame, slots: DataFrame) -> DataFrame:
    """State rows by source and page instead of slot; missing slots, moves that move nothing and blank texts go.

    State rows: doc, bucket, slot_id, id, value (text), dx, dy, dw, dh, target_slot_id, deleted. Form values stay keyed by their source in slot_id.
    """
    own = addresses(slots).select("doc", "slot_id", "source_key", "page_index")
    fills = state.where(F.col("bucket") == "form_values").withColumn("source_key", F.col("slot_id")).withColumn("page_index", F.lit(None).cast("int"))
    placed = state.where(F.col("bucket") != "form_values").join(own, ["doc", "slot_id"])
    zero = F.lit(True)
    for c in ("dx", "dy", "dw", "dh"):
        zero = zero & (F.coalesce(c, F.lit(0.0)) == 0)
    idle = (F.col("bucket") == "image_moves") & F.col("target_slot_id").isNull() & ~F.coalesce("deleted", F.lit(False)) & zero
    blank = (F.col("bucket") == "text_inserts") & (wide_trim(F.coalesce("value", F.lit(""))) == "")
    goal = own.select("doc", F.col("slot_id").alias("target_slot_id"), F.col("source_key").alias("target_source_key"), F.col("page_index").alias("target_page_index"))
    kept = placed.where(~idle & ~blank).unionByName(fills)
    return kept.join(goal, ["doc", "target_slot_id"], "left").drop("slot_id", "target_slot_id")


def classify_edit() -> Column:
    """Plan of an edit: delete, cross_source, cross_page, move or redraw.

    Reads source_key, page_index, target_source_key, target_page_index, deleted, new_text, text, styled, decorated, dx, dy.
    """
    other = F.coalesce(F.col("target_source_key") != F.col("source_key"), F.lit(False))
    aimed = F.col("target_page_index").isNotNull()
    moved = (F.coalesce("dx", F.lit(0.0)) != 0) | (F.coalesce("dy", F.lit(0.0)) != 0)
    plain = (F.col("new_text") == F.col("text")) & ~F.col("styled") & ~F.col("decorated")
    return (
        F.when(F.coalesce("deleted", F.lit(False)), "delete").when(aimed & other, "cross_source")
        .when(aimed & (F.col("target_page_index") != F.col("page_index")), "cross_page").when(plain & moved, "move").otherwise("redraw"))


def apply_text_edits(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """Run table after edits; runs carry pdf_x, pdf_y, scale, text, underline, strikethrough."""
    page = ["source_key", "page_index"]
    joined = runs.join(edits, [*page, "run_id"], "left")
    edited = F.col("new_text").isNotNull() | F.coalesce("deleted", F.lit(False))
    decorated = F.coalesce("underline", F.lit(False)) | F.coalesce("strikethrough", F.lit(False))
    planned = joined.withColumn("styled", F.coalesce("styled", F.lit(False))).withColumn("decorated", decorated)
    planned = planned.withColumn("plan", F.when(edited, classify_edit()).otherwise("keep"))
    crosses = F.col("plan").isin("cross_page", "cross_source")
    return planned.where(F.col("plan") != "delete").select(
        F.when(crosses, F.coalesce("target_source_key", "source_key")).otherwise(F.col("source_key")).alias("source_key"),
        F.when(crosses, F.col("target_page_index")).otherwise(F.col("page_index")).alias("page_index"), "run_id", "plan",
        F.coalesce("new_text", "text").alias("text"),
        F.when(crosses, F.coalesce("target_x", "pdf_x")).otherwise(F.col("pdf_x") + F.coalesce("dx", F.lit(0.0)) / F.col("scale")).alias("pdf_x"),
        F.when(crosses, F.coalesce("target_y", F.lit(0.0))).otherwise(F.col("pdf_y") - F.coalesce("dy", F.lit(0.0)) / F.col("scale")).alias("pdf_y"),
        "underline", "strikethrough")


def apply_image_moves(images: DataFrame, moves: DataFrame) -> DataFrame:
    """Images with their move plan: keep, fixed (no block), delete, cross or move with its matrix."""
    joined = images.join(moves, ["source_key", "page_index", "image_id"], "left")
    aimed = F.col("target_page_index").isNotNull() & (
        F.coalesce(F.col("target_source_key") != F.col("source_key"), F.lit(False)) | (F.col("target_page_index") != F.col("page_index")))
    plan = (
        F.when(F.col("move_id").isNull(), "keep").when(F.col("q_index").isNull(), "fixed").when(F.coalesce("deleted", F.lit(False)), "delete")
        .when(aimed, "cross").otherwise("move"))
    planned = joined.withColumn("plan", plan)
    own = image_move_matrix(F.col("rect"), F.col("dx"), F.col("dy"), F.col("dw"), F.col("dh"), F.col("scale"))
    box = F.struct(
        F.coalesce("target_w", "rect.w").alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.coalesce("target_h", "rect.h").alias("d"),
        F.coalesce("target_x", "rect.x").alias("e"), F.coalesce("target_y", "rect.y").alias("f"))
    return planned.withColumn("cm", F.when(F.col("plan") == "move", own).when(F.col("plan") == "cross", box))


def change_counts(state: DataFrame, slots: DataFrame, source_pages: DataFrame, annotation_changes: DataFrame) -> DataFrame:
    """Unsaved changes per document.

    State rows count once each, annotations by changed slot instead. Structure:
    removed primary pages, blank slots, external slots, and one when primary pages are out of order.
    """
    from pageframe.operators.pages import is_reordered

    rows = state.where(F.col("bucket").isin("annotations", "editing") == F.lit(False)).groupBy("doc").agg(F.count("*").alias("n"))
    annots = annotation_changes.where("changed").groupBy("doc").agg(F.count("*").alias("n"))
    primary = (F.col("kind") == "page") & (F.col("source_key") == "primary")
    shape = slots.groupBy("doc").agg(
        F.count_if(primary).alias("_primary"), F.count_if(F.col("kind") == "blank").alias("_blank"),
        F.count_if((F.col("kind") == "page") & ~primary).alias("_external"))
    shape = shape.join(source_pages.select("doc", "primary_pages"), "doc", "left").join(is_reordered(slots), "doc", "left")
    removed = F.greatest(F.lit(0), F.coalesce("primary_pages", F.lit(0)) - F.col("_primary"))
    ops = shape.select("doc", (removed + F.col("_blank") + F.col("_external") + F.coalesce("reordered", F.lit(False)).cast("int")).alias("n"))
    return rows.unionByName(annots).unionByName(ops).groupBy("doc").agg(F.sum("n").alias("changes"))


def ops_to_remove(*parts: DataFrame) -> DataFrame:
    """Union of operator sets (source_key, page_index, op_index) to remove."""
    page = ["source_key", "page_index", "op_index"]
    out = parts[0].select(*page)
    for part in parts[1:]:
        out = out.unionByName(part.select(*page))
    return out.distinct()


def keep_replacements(replacements: DataFrame, removed: DataFrame) -> DataFrame:
    """Removal beats replacement."""
    return replacements.join(removed, ["source_key", "page_index", "op_index"], "left_anti")


def prune_unused(resources: DataFrame, ops: DataFrame) -> DataFrame:
    """Resources some Do operator of their page still names."""
    used = ops.where(F.col("op") == "Do").select("source_key", "page_index", "name").distinct()
    return resources.join(used, ["source_key", "page_index", "name"], "left_semi")


def strip_specs(edited_runs: DataFrame, moves: DataFrame, shapes: DataFrame) -> DataFrame:
    """What to hide per page: sets of run, image and shape ids with one digest for change detection.

    A page's ids go into one row, as the digest needs; moves that move nothing are left out.
    """
    page = ["source_key", "page_index"]
    zero = F.lit(True)
    for c in ("dx", "dy", "dw", "dh"):
        zero = zero & (F.coalesce(c, F.lit(0.0)) == 0)
    moving = moves.where(F.coalesce("deleted", F.lit(False)) | ~zero | F.col("target_slot_id").isNotNull())
    tag = lambda df, kind, col: df.select(*page, F.lit(kind).alias("kind"), F.col(col).alias("id"))
    every = tag(edited_runs, "r", "run_id").unionByName(tag(moving, "i", "image_id")).unionByName(tag(shapes, "s", "shape_id")).distinct()
    ids = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("id"))))
    rows = every.groupBy(*page).agg(ids("r").alias("run_ids"), ids("i").alias("image_ids"), ids("s").alias("shape_ids"))
    text = F.concat_ws(":", F.col("page_index"), *[F.concat(F.lit(f"{k}="), F.array_join(c, ",")) for k, c in (("r", "run_ids"), ("i", "image_ids"), ("s", "shape_ids"))])
    return rows.withColumn("signature", text).withColumn("digest", F.sha2(text, 256))


def group_ops_by_page(**tables: DataFrame) -> DataFrame:
    """Pages to rewrite and how many rows of each table touch them; its sources are the ones to load."""
    page = ["source_key", "page_index"]
    out = None
    for name, df in tables.items():
        part = df.select(*page, F.lit(name).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*page).agg(*[F.count_if(F.col("kind") == name).alias(name) for name in tables])


def distinct_assets(inserts: DataFrame) -> DataFrame:
    """Equal bytes on one source are stored once: asset key per insert row and the rows that own the bytes."""
    keyed = inserts.withColumn("asset", F.sha2("bytes", 256))
    return keyed.groupBy("source_key", "asset").agg(F.min("id").alias("owner"), F.count("*").alias("uses"))
