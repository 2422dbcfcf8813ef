"""Reduction of an edit log to content, by composing actions as functions.

For one id of one bucket the content is a map from slot to an item (fields). An action is
a function on that map: it drops a slot, fills it, or takes an item, merges fields into
it and may put it into another slot. Such functions compose: a composed one names, for
every slot it touches, the candidates whose first living one stands there afterwards.
A candidate is an item made inside (its fields) or one that stood in slot `src` before
(with the fields merged into it since). So the log of one id is cut into blocks of `seq`,
blocks are composed in parallel, and `FAN` neighbours become one until one is left:
a hot document spreads over its ids, a hot id over its blocks.

Emptying a slot (`mergeAnnotations`) concerns every id in it, so it is no action of an id.
A running maximum along each slot tells every action the last emptying before it, and a
candidate lives on only if it was placed after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.operators.edits import BUCKET, DELETES, PATCHES, RESET
from pageframe.operators.scan import with_running
from pageframe.session import cut_lineage

# Buckets whose items sit in slots, those whose patches can move an item, and address fields.
ITEM_BUCKETS = ("text_inserts", "image_inserts", "annotations", "redactions")
MOVING = ("text_inserts", "image_inserts", "annotations")
ADDS = ("addTextInsert", "addImageInsert", "addAnnotation", "addRedaction")
MERGE = "mergeAnnotations"
SOURCE, PAGE_FIELD = "sourceKey", "pageIndex"

FAN = 32
_FIELDS = "map<string,string>"
_CANDIDATE = f"struct<src:string,need:bigint,placed:bigint,fields:{_FIELDS}>"
_STATE = f"map<string,array<{_CANDIDATE}>>"


def _no_fields() -> Column:
    return F.create_map().cast(_FIELDS)


def merge_fields(old: Column, new: Column) -> Column:
    """Fields of both, the new value where both have one."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def _put(state: Column, slot: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(state, lambda k, _: k != slot), F.map_from_arrays(F.array(slot), F.array(value)))


def _held(state: Column, slot: Column) -> Column:
    """Candidates of a slot; one that no action has touched holds what stood there before."""
    before = F.array(F.struct(slot.alias("src"), F.lit(None).cast("bigint").alias("need"), F.lit(None).cast("bigint").alias("placed"), _no_fields().alias("fields")))
    return F.coalesce(F.try_element_at(state, slot), before.cast(f"array<{_CANDIDATE}>"))


def _candidate(src: Column, need: Column, placed: Column, fields: Column) -> Column:
    return F.struct(src.alias("src"), need.alias("need"), placed.alias("placed"), fields.alias("fields")).cast(_CANDIDATE)


def _since(found: Column, need: Column) -> Column:
    """Candidates still there after the slot was emptied at `need`."""
    stay = F.filter(found, lambda c: c["placed"].isNull() | (c["placed"] > F.coalesce(need, F.lit(-1))))
    return F.transform(stay, lambda c: _candidate(c["src"], F.when(c["placed"].isNull(), F.greatest(c["need"], need)).otherwise(c["need"]), c["placed"], c["fields"]))


def _act(state: Column, a: Column) -> Column:
    """One action: drop, fill, or take, merge and place."""
    nothing = F.array().cast(f"array<{_CANDIDATE}>")
    here = _since(_held(state, a["slot"]), a["emptied"])
    patched = F.transform(here, lambda c: _candidate(c["src"], c["need"], a["seq"], merge_fields(c["fields"], a["fields"])))
    made = F.array(_candidate(F.lit(None).cast("string"), F.lit(None).cast("bigint"), a["seq"], a["fields"]))
    moved = _put(_put(state, a["slot"], nothing), a["target"], F.concat(patched, _held(state, a["target"])))
    return (
        F.when(a["kind"] == "drop", _put(state, a["slot"], nothing)).when(a["kind"] == "fill", _put(state, a["slot"], made))
        .when(a["slot"] == a["target"], _put(state, a["slot"], patched)).otherwise(moved)
    )


def _after(first: Column, then: Column) -> Column:
    """The function `then` after the function `first`."""

    def resolved(c: Column) -> Column:
        inner = _since(_held(first, c["src"]), c["need"])
        later = F.transform(inner, lambda i: _candidate(i["src"], i["need"], F.coalesce(c["placed"], i["placed"]), merge_fields(i["fields"], c["fields"])))
        return F.when(c["src"].isNull(), F.array(c)).otherwise(later)

    found = F.transform_values(then, lambda _, cs: F.flatten(F.transform(cs, resolved)))
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(found), k)), found)


def _fold(rows: DataFrame, keys: list[str], order: str, step: Column, combine) -> DataFrame:
    """The functions of a group, composed in the order of the field `order` of `step`."""
    sooner = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(step), sooner).alias("_steps"))
    start = F.create_map().cast(_STATE)
    return listed.select(*keys, F.aggregate("_steps", start, combine).alias("state"))


def compose(actions: DataFrame, keys: list[str], block: int = 256) -> DataFrame:
    """(keys, state): what all actions of a key do together; actions carry seq, kind, slot, target, fields, emptied.

    Actions of one `seq` in a key fill different slots, in any order; but for those a block holds `block` actions at most.
    """
    at = [*keys, "_block"]
    step = F.struct("seq", "kind", "slot", "target", "fields", "emptied")
    made = _fold(actions.withColumn("_block", F.floor(F.col("seq") / block).cast("bigint")), at, "seq", step, _act)
    made = cut_lineage(made)
    crowded = lambda: made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    while not crowded():
        pairs = made.withColumn("_at", F.col("_block")).withColumn("_block", F.floor(F.col("_block") / FAN).cast("bigint"))
        made = cut_lineage(_fold(pairs, at, "_at", F.struct("_at", "state"), lambda s, x: _after(s, x["state"])))
    return made.drop("_block")


def _aimed(patches: DataFrame, slots: DataFrame) -> DataFrame:
    """Patches with `target`; a page and a source move an item to the page slot at that position, and give it its address."""
    position, source = (F.try_element_at("fields", F.lit(f)) for f in (PAGE_FIELD, SOURCE))
    asked = patches.withColumn("_pos", F.when(F.col("bucket").isin(*MOVING) & source.isNotNull(), F.expr("try_cast(fields['%s'] AS bigint)" % PAGE_FIELD)))
    pages = slots.where(F.col("kind") == "page").select("doc", F.col("pos").cast("bigint").alias("_pos"), F.col("slot_id").alias("_to"), F.col("source_key").alias("_key"), F.col("source_page_index").cast("string").alias("_page"))
    met = asked.join(pages, ["doc", "_pos"], "left")
    moves = F.col("_to").isNotNull() & (F.col("_to") != F.col("slot"))
    placed = F.col("bucket").isin(*MOVING) & position.isNotNull() & source.isNotNull()
    plain = F.map_filter("fields", lambda k, _: ~k.isin(SOURCE, PAGE_FIELD))
    address = F.create_map(F.lit(SOURCE), F.col("_key"), F.lit(PAGE_FIELD), F.col("_page")).cast(_FIELDS)
    fields = F.when(moves, F.map_concat(plain, address)).when(placed, plain).otherwise(F.col("fields"))
    return met.withColumn("target", F.when(moves, F.col("_to")).otherwise(F.col("slot"))).withColumn("fields", fields).select(*patches.columns, "target")


def reduce_items(log: DataFrame, slots: DataFrame, snapshots: DataFrame | None = None, block: int = 256) -> DataFrame:
    """(doc, bucket, slot_id, id, fields): items in slots after a log of actions, moves, merges of fields and restored snapshots.

    The log carries doc, seq (unique in a document), action, slot_id, id and fields (map of texts). Adds put an item into
    its slot, in place of one of that id; patches merge their fields into the item if it is in their slot, and one that
    names a position and a source moves it to the page slot there; deletes take it out. `mergeAnnotations` rows of one
    doc, seq and slot are together the new annotations of the slot; one without id empties it. Everything up to the last
    `replaceAll` of a document is void; the rows that `snapshots` (doc, seq, bucket, slot_id, id, fields) has for that seq
    stand in its place. Slots carry doc, pos, slot_id, kind, source_key, source_page_index; a position is held by one slot.
    Actions of other buckets, and rows without doc, seq, slot or id, change nothing.
    """
    bucket = F.try_element_at(F.create_map(*[F.lit(x) for pair in BUCKET.items() for x in pair]), F.col("action"))
    resets = log.where(F.col("action") == RESET).groupBy("doc").agg(F.max("seq").alias("_reset"))
    live = log.where(F.col("action") != RESET).join(resets, "doc", "left").where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")))
    named = live.select("doc", "seq", "action", bucket.alias("bucket"), F.col("slot_id").alias("slot"), "id", F.coalesce("fields", _no_fields()).alias("fields"))
    named = named.where(F.col("bucket").isin(*ITEM_BUCKETS) & F.col("slot").isNotNull())
    kind = F.when(F.col("action").isin(*ADDS, MERGE), "fill").when(F.col("action").isin(*DELETES), "drop").when(F.col("action").isin(*PATCHES), "patch")
    acts = named.withColumn("kind", kind).where("id IS NOT NULL AND kind IS NOT NULL").drop("action")
    if snapshots is not None:
        restored = snapshots.join(resets, (snapshots["doc"] == resets["doc"]) & (snapshots["seq"] == resets["_reset"]), "left_semi")
        restored = restored.select("doc", "seq", "bucket", F.col("slot_id").alias("slot"), "id", F.coalesce("fields", _no_fields()).alias("fields"), F.lit("fill").alias("kind"))
        acts = acts.unionByName(restored.where(F.col("bucket").isin(*ITEM_BUCKETS) & F.col("slot").isNotNull() & F.col("id").isNotNull()))
    still = acts.where("kind <> 'patch'").withColumn("target", F.col("slot"))
    acts = still.unionByName(_aimed(acts.where("kind = 'patch'"), slots))
    # all rows of one merge share its seq, so an item is in place if it was placed at the emptying or later
    empties = named.where(F.col("action") == MERGE).select("doc", "bucket", "slot", "seq").distinct()
    marks = empties.select("doc", "bucket", "slot", (F.col("seq") * 2).alias("at"), F.col("seq").alias("mark"))
    rows = acts.select("*", (F.col("seq") * 2 + 1).alias("at"), F.lit(None).cast("bigint").alias("mark"))
    running = with_running(rows.unionByName(marks, allowMissingColumns=True), ["doc", "bucket", "slot"], "at", {"last": ("max", F.col("mark"))})
    ready = running.where("kind IS NOT NULL").withColumn("emptied", F.col("last") - 1)
    done = compose(ready, ["doc", "bucket", "id"], block)
    entries = done.select("doc", "bucket", "id", F.explode("state").alias("slot", "found"))
    last = empties.groupBy("doc", "bucket", "slot").agg(F.max("seq").alias("emptied"))
    met = entries.join(last, ["doc", "bucket", "slot"], "left")
    living = F.filter("found", lambda c: c["src"].isNull() & (c["placed"] >= F.coalesce("emptied", F.lit(-1))))
    stay = met.select("doc", "bucket", F.col("slot").alias("slot_id"), "id", F.get(living, F.lit(0)).alias("item")).where("item IS NOT NULL")
    return stay.select("doc", "bucket", "slot_id", "id", "item.fields")
