"""Tokens, slot patches, streams and the registry."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageframe.operators import edits as ed
from pageframe.plans import ORACLES, QUERIES
from pageframe.sources import layout
from pageframe.streaming import edits as st


def test_tokens_of_short_and_long_lines(spark):
    text = "  ab  c " + "x" * 700 + " yy  z " + " ".join(f"w{i}" for i in range(400)) + "\n\nlast line "
    df = spark.createDataFrame([("d", text)], "source_key string, text string")
    wanted = []
    for n, line in enumerate(text.split("\n")):
        at = 0
        for k, token in enumerate(line.split(" ")):
            if token:
                wanted.append((n, k, token, at))
            at += len(token) + 1
    for limit in (10, 1 << 20):
        rows = layout.line_items(layout.text_lines(df, "text"), long_line=limit).select("line_no", "tok_no", "str", "offset").collect()
        assert sorted(tuple(r) for r in rows) == wanted


def test_admit_limits(spark):
    files = spark.createDataFrame([("a.pdf", 150 * 1024 * 1024, 250), ("b.pdf", 150 * 1024 * 1024 + 1, 1), ("", 5, 251)], "name string, length long, page_count int")
    accepted, rejected = layout.admit(files)
    assert [r.name for r in accepted.collect()] == ["a.pdf"]
    reasons = {r.name: r.reason for r in rejected.collect()}
    assert reasons["b.pdf"].startswith("b.pdf is 150 MB;") and reasons[""].startswith("PDF has 251 pages;")


def test_patch_moves_between_slots(spark):
    slots = spark.createDataFrame([("d", "a", 0, "page", "primary", 0), ("d", "b", 1, "page", "ext", 4), ("d", "c", 2, "blank", "__blank__:c", 0)],
                                  "doc string, slot_id string, pos long, kind string, source_key string, source_page_index int")
    items = spark.createDataFrame([("d", "t", "a", "primary", 0, "v"), ("d", "u", "a", "primary", 0, "v")], "doc string, id string, slot_id string, source_key string, page_index int, value string")
    patches = spark.createDataFrame([("d", "t", 1, "a", 1, "x", "w"), ("d", "t", 2, "a", 0, "x", "lost"), ("d", "t", 3, "b", 2, "x", "kept"), ("d", "u", 1, "a", None, None, "n")],
                                    "doc string, id string, seq long, from_slot string, page_index int, source_key string, value string")
    got = {r.id: tuple(r)[2:] for r in ed.apply_patches(items, patches, slots).collect()}
    assert got == {"t": ("b", "ext", 4, "kept"), "u": ("a", "primary", 0, "n")}


def test_undo_redo(spark):
    rows = [("d", 0, i + 1, c) for i, c in enumerate(["record", "record", "undo", "undo", "undo", "redo", "record", "redo"])]
    got = ed.undo_redo(spark.createDataFrame(rows, "doc string, session int, seq long, command string")).orderBy("seq").collect()
    assert [r.state for r in got] == [1, 2, 1, 0, 0, 1, 7, 7]


def _bursts(spark, log, folder, parts, delay):
    """Entries of a stream that reads the rows in `parts` files, one a micro-batch, and how many rows came too late."""
    for part in range(parts):
        log.where(F.col("part") % parts == part).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.01)
    stream = spark.readStream.schema(log.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    late = st.run_available(st.stream_coalesce(stream, delay=delay), f"{folder}/job", "append")
    return sorted(map(tuple, spark.read.parquet(f"{folder}/job/out").drop("batch").collect()), key=str), late


def test_stream_bursts_do_not_depend_on_micro_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    stamps = sorted(start + timedelta(milliseconds=130 * i + (900 if i % 7 == 0 else 0)) for i in range(60))
    rows = [(f"d{i % 2}", i, ts, "ab"[(i // 4) % 2] if i % 11 else None, i // 6 + (i * 5) % 3) for i, ts in enumerate(stamps)]
    rows += [("z", 100, start + timedelta(days=1), "a", 10**6)]
    log = spark.createDataFrame(rows, "doc string, seq long, ts timestamp, key string, part int")
    want = sorted((r.doc, r.first_seq, r.last_seq, r.key, r.calls) for r in ed.coalesce_history(log).where("doc <> 'z'").collect())
    want = sorted(want, key=str)
    ranked = log.withColumn("part", F.when(F.col("doc") == "z", 8).otherwise(F.least("part", F.lit(11)) % 8))
    for name, parts in (("one", 1), ("nine", 9)):
        # rows of neighbouring files overlap in time by less than the delay; the last file closes everything
        assert _bursts(spark, ranked, str(tmp_path / name), parts, "30 seconds") == (want, 0)


def test_late_events_are_counted_and_join_no_burst(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("d", 1, start, "a", 0), ("z", 2, start + timedelta(hours=1), "a", 1), ("z", 4, start + timedelta(hours=2), "a", 2), ("d", 3, start + timedelta(milliseconds=100), "a", 3)]
    log = spark.createDataFrame(rows, "doc string, seq long, ts timestamp, key string, part int")
    got, late = _bursts(spark, log, str(tmp_path), 4, "1 second")
    assert got == [("d", 1, 1, "a", 1), ("z", 2, 2, "a", 1)] and late == 1


def test_registry():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 140 and set(ORACLES) <= set(QUERIES)
    assert not any("{" + v + "}" in sql for sql in ORACLES.values() for v in ("lines", "items", "ops", "runs"))


def test_lines_of_one_piece_are_not_cut_letter_by_letter(spark):
    from pageframe.sources import layout

    df = spark.createDataFrame([(1, "a b  c")], "doc_id long, text string")
    plan = layout.line_items(layout.text_lines(df, "text"))._jdf.queryExecution().analyzed().toString()
    assert "translate(" not in plan and "CASE WHEN (length(line" in plan


def test_results_are_written_with_zstd(spark, tmp_path):
    from pageframe.sources import layout

    df = spark.createDataFrame([(f"s{n}", n) for n in range(20)], "source_key string, n int")
    layout.write_result({"items": df}, f"{tmp_path}/out", buckets=2)
    names = [p.name for p in (tmp_path / "out" / "items").rglob("*.parquet")]
    assert names and all(".zstd." in n for n in names)
    assert sorted((r.source_key, r.n) for r in spark.read.parquet(f"{tmp_path}/out/items").collect()) == sorted((f"s{n}", n) for n in range(20))
