"""Edit log reduction: moves, field patches, snapshots, emptied slots, against the serial rule."""

import random

from pyspark.sql import functions as F

from pageframe.operators.edits import BUCKET, DELETES, PATCHES
from pageframe.operators.reducer import ADDS, ITEM_BUCKETS, MOVING, reduce_items

LOG = "doc string, seq long, action string, slot_id string, id string, fields map<string,string>"
SNAPSHOT = "doc string, seq long, bucket string, slot_id string, id string, fields map<string,string>"
SLOTS = "doc string, pos int, slot_id string, kind string, source_key string, source_page_index int"


def serial(log, slots, snapshots):
    out = {}
    order = {}
    for row in log:
        order.setdefault((row[0], row[1]), []).append(row)
    for (doc, seq), rows in sorted(order.items()):
        if rows[0][2] == "replaceAll":
            out = {k: v for k, v in out.items() if k[0] != doc}
            out.update({(d, b, s, i): dict(f or {}) for d, q, b, s, i, f in snapshots if (d, q) == (doc, seq)})
            continue
        for slot in {r[3] for r in rows if r[2] == "mergeAnnotations"}:
            out = {k: v for k, v in out.items() if (k[0], k[1], k[2]) != (doc, "annotations", slot)}
        for _, _, action, slot, i, fields in rows:
            bucket, fields = BUCKET.get(action), dict(fields or {})
            key = (doc, bucket, slot, i)
            if bucket not in ITEM_BUCKETS or i is None:
                continue
            if action in ADDS or action == "mergeAnnotations":
                out[key] = fields
            elif action in DELETES:
                out.pop(key, None)
            elif action in PATCHES and key in out:
                item = out.pop(key)
                if bucket in MOVING and "pageIndex" in fields and "sourceKey" in fields:
                    at = [s for s in slots if s[0] == doc and str(s[1]) == fields["pageIndex"] and s[3] == "page" and s[2] != slot]
                    fields = {k: v for k, v in fields.items() if k not in ("pageIndex", "sourceKey")}
                    if at:
                        key = (doc, bucket, at[0][2], i)
                        fields |= {"sourceKey": at[0][4], "pageIndex": str(at[0][5])}
                out[key] = item | fields
    return sorted((*k, tuple(sorted(v.items()))) for k, v in out.items())


def reduced(spark, log, slots, snapshots, block):
    got = reduce_items(spark.createDataFrame(log, LOG), spark.createDataFrame(slots, SLOTS), spark.createDataFrame(snapshots, SNAPSHOT), block)
    return sorted((r.doc, r.bucket, r.slot_id, r.id, tuple(sorted(r.fields.items()))) for r in got.collect())


SLOT_ROWS = [("d", 0, "a", "page", "primary", 0), ("d", 1, "b", "page", "primary", 1), ("d", 2, "c", "blank", "none", 0), ("d", 3, "e", "page", "ext", 4)]


def test_moved_item_is_followed_and_keeps_its_fields(spark):
    log = [
        ("d", 1, "addTextInsert", "a", "t", {"text": "x", "sourceKey": "primary", "pageIndex": "0"}),
        ("d", 2, "patchTextInsert", "a", "t", {"sourceKey": "primary", "pageIndex": "1", "pdfX": "42"}),
        ("d", 3, "patchTextInsert", "b", "t", {"text": "y"}),
        ("d", 4, "addTextInsert", "a", "u", {"text": "u"}),
        ("d", 5, "patchTextInsert", "a", "u", {"sourceKey": "primary", "pageIndex": "1"}),
        ("d", 6, "deleteTextInsert", "b", "u", None),
        ("d", 7, "patchTextInsert", "a", "t", {"text": "not here"}),
        ("d", 8, "patchTextInsert", "b", "t", {"sourceKey": "primary", "pageIndex": "2", "size": "9"}),
    ]
    want = [("d", "text_inserts", "b", "t", (("pageIndex", "1"), ("pdfX", "42"), ("size", "9"), ("sourceKey", "primary"), ("text", "y")))]
    for block in (1, 3, 256):
        assert reduced(spark, log, SLOT_ROWS, [], block) == want


def test_snapshot_stands_in_for_what_was_before(spark):
    log = [("d", 1, "addRedaction", "a", "r", {"w": "1"}), ("d", 2, "replaceAll", None, None, None), ("d", 3, "patchRedaction", "a", "s", {"h": "2"})]
    snapshot = [("d", 2, "redactions", "a", "s", {"w": "5"}), ("d", 1, "redactions", "a", "old", {"w": "5"})]
    assert reduced(spark, log, SLOT_ROWS, snapshot, 256) == [("d", "redactions", "a", "s", (("h", "2"), ("w", "5")))]


def test_random_logs_equal_the_serial_rule(spark):
    rng = random.Random(8)
    actions = [*ADDS * 2, *PATCHES * 3, *DELETES, "mergeAnnotations", "setEdit", "unknown"]
    log, snapshots = [], []
    for doc in ("d", "x"):
        for seq in range(1, 400):
            action = rng.choice(actions) if rng.random() > 0.004 else "replaceAll"
            slot, i = rng.choice("abce"), rng.choice(["i", "j"])
            fields = {k: str(rng.randrange(9)) for k in ("text", "w") if rng.random() < 0.6}
            if action in PATCHES and rng.random() < 0.5:
                fields |= {"pageIndex": str(rng.randrange(6)), "sourceKey": "any"} if rng.random() < 0.8 else {"pageIndex": "3"}
            if action == "mergeAnnotations":
                log += [(doc, seq, action, slot, x, fields) for x in rng.sample(["i", "j", None], rng.randrange(1, 3))]
            else:
                log.append((doc, seq, action, slot, i, fields or None))
            if action == "replaceAll":
                snapshots += [(doc, seq, b, s, "i", {"from": "snapshot"}) for b in ITEM_BUCKETS for s in "ab"]
    slots = SLOT_ROWS + [("x", 0, "a", "page", "p", 7), ("x", 1, "c", "page", "p", 8)]
    want = serial(log, slots, snapshots)
    assert len(want) > 5
    for block in (1, 7, 256):
        assert reduced(spark, log, slots, snapshots, block) == want


def test_one_hot_id_is_composed_in_blocks(spark):
    log = spark.range(1, 5001).select(
        F.lit("d").alias("doc"), F.col("id").alias("seq"), F.when(F.col("id") == 1, "addTextInsert").otherwise("patchTextInsert").alias("action"),
        F.when(F.col("id") % 2 == 1, "a").otherwise("b").alias("slot_id"), F.lit("t").alias("id2"),
        F.create_map(F.lit("n"), F.col("id").cast("string"), F.lit("sourceKey"), F.lit("s"), F.lit("pageIndex"), (F.col("id") % 2).cast("string")).alias("fields"),
    ).withColumnRenamed("id2", "id")
    log = log.withColumn("slot_id", F.when(F.col("seq") == 1, "a").when(F.col("seq") == 2, "a").otherwise(F.when(F.col("seq") % 2 == 1, "a").otherwise("b")))
    got = reduce_items(log, spark.createDataFrame(SLOT_ROWS, SLOTS), block=64).collect()
    want = serial([tuple(r) for r in log.collect()], SLOT_ROWS, [])
    assert [(r.doc, r.bucket, r.slot_id, r.id, tuple(sorted(r.fields.items()))) for r in got] == want
