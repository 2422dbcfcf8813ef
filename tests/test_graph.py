"""Trees of many files in one table, cycles, and long paths."""

import random

from pyspark.sql import functions as F

from pageframe.operators import forms as fm
from pageframe.operators import graph as gr

TREE = "source_key string, node_id string, parent_id string, name string, ft string"


def test_ids_that_repeat_across_files_do_not_mix(spark):
    rows = [("A", "1", None, "a", "Tx"), ("A", "2", "1", "x", None), ("B", "1", None, "b", "Btn"), ("B", "2", "1", "y", None), ("C", "2", "1", "z", None)]
    nodes = spark.createDataFrame(rows, TREE)
    assert {(r.source_key, r.node_id): r.full_name for r in gr.qualified_name(nodes).collect()} == {("A", "1"): "a", ("A", "2"): "a.x", ("B", "1"): "b", ("B", "2"): "b.y", ("C", "2"): "z"}
    assert sorted((r.source_key, r.ft) for r in gr.inherit(nodes, ["ft"]).where("node_id = '2'").collect()) == [("A", "Tx"), ("B", "Btn"), ("C", None)]
    assert sorted((r.source_key, r.node_id) for r in gr.terminal_fields(nodes).collect()) == [("A", "2"), ("B", "2"), ("C", "2")]
    scrubbed = gr.scrub_tree(nodes.withColumn("v", F.lit("secret")), nodes.where("source_key = 'A' AND node_id = '1'"))
    assert sorted((r.source_key, r.node_id, r.v) for r in scrubbed.collect()) == [("A", "1", None), ("A", "2", None), ("B", "1", "secret"), ("B", "2", "secret"), ("C", "2", "secret")]
    pages = fm.widget_pages(nodes.select("source_key", "node_id"), spark.createDataFrame([("A", "2", 4)], "source_key string, node_id string, page_index int"))
    assert {(r.source_key, r.node_id): r.page_index for r in pages.collect()}[("A", "2")] == 4 and pages.where("page_index = -1").count() == 4


def test_cycles_are_found_and_cut(spark):
    ring = [("A", f"r{i}", f"r{(i + 1) % 5}", f"n{i}", "Tx" if i == 3 else None) for i in range(5)]
    rows = ring + [("A", "under", "r2", "u", None), ("A", "self", "self", "s", None), ("B", "r0", None, "other", None), ("B", "r1", "r0", "o1", None)]
    nodes = spark.createDataFrame(rows, TREE)
    got = {(r.source_key, r.node_id): r.cycle for r in gr.cycles(nodes).collect()}
    assert got == {**{("A", f"r{i}"): "r0" for i in range(5)}, ("A", "self"): "self"}
    names = {(r.source_key, r.node_id): r.full_name for r in gr.qualified_name(nodes).collect()}
    assert names == {("A", "r0"): "n0", ("A", "r4"): "n0.n4", ("A", "r3"): "n0.n4.n3", ("A", "r2"): "n0.n4.n3.n2", ("A", "r1"): "n0.n4.n3.n2.n1",
                     ("A", "under"): "n0.n4.n3.n2.u", ("A", "self"): "s", ("B", "r0"): "other", ("B", "r1"): "other.o1"}
    assert gr.top_ancestor(nodes).where("top IN ('r0', 'self')").count() == len(rows)


def test_reachable_equals_search_by_hand(spark):
    rng = random.Random(2)
    for trial in range(3):
        edges = [(f, rng.randrange(40), rng.randrange(40)) for f in "AB" for _ in range(34)] + [(f, 100 + i, 101 + i) for f in "AB" for i in range(30)] + [("A", 5, 100), ("A", 130, 7), ("B", 3, 115), ("A", 500, 501), ("A", 501, 500)]
        roots = [("A", 1), ("B", 2), ("B", 120), ("A", 700)]
        seen, todo = set(roots), list(roots)
        while todo:
            f, n = todo.pop()
            for g, s, d in edges:
                if (g, s) == (f, n) and (f, d) not in seen:
                    seen.add((f, d))
                    todo.append((f, d))
        got = gr.reachable(spark.createDataFrame(edges, "source_key string, src int, dst int"), spark.createDataFrame(roots, "source_key string, node int"), within=["source_key"]).collect()
        assert sorted((r.source_key, r.node) for r in got) == sorted(seen)


def test_long_path_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = gr.cut_lineage
    monkeypatch.setattr(gr, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    edges = spark.range(100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert gr.reachable(edges, spark.createDataFrame([(40,)], "node long")).count() == 100_000 - 39
    assert len(rounds) < 60


def test_flat_graph_makes_no_stretches(spark, monkeypatch):
    monkeypatch.setattr(gr, "_stretches", lambda *_: 1 / 0)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z"), ("c", None)], "src string, dst string")
    got = gr.reachable(edges, spark.createDataFrame([("a",), ("a",), (None,)], "node string"))
    assert sorted(r.node for r in got.collect()) == ["a", "b", "c"]
