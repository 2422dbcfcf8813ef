"""Block scans and position joins against plain computation."""

import random

from pyspark.sql import functions as F

from pageframe.functions.geometry import rect
from pageframe.operators import grid, scan


def test_scans_equal_sequential_rules(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.7 else f"k{i % 3}", i, random.randint(0, 3), random.choice([None, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long, w long")
    before = {(r.k, r.i): (r.p, r.n) for r in scan.with_previous(
        scan.with_previous(df, ["k"], "i", {"p": "v"}, 16), ["k"], "i", {"n": "v"}, 16, backwards=True).collect()}
    running = {(r.k, r.i): (r.s, r.m, r.l) for r in scan.with_running(
        df, ["k"], "i", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("w"))}, 16).collect()}
    isl = {(r.k, r.i): r.island for r in scan.islands(df, ["k"], "i", {"_v": "v"}, lambda: F.col("v") != F.col("_v"), block=16).collect()}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        total, last, island = 0, None, 0
        for n, (k, i, v, w) in enumerate(own):
            total += v
            last = w if w is not None else last
            island += n == 0 or own[n - 1][2] != v
            assert before[k, i] == (own[n - 1][2] if n else None, own[n + 1][2] if n + 1 < len(own) else None)
            assert running[k, i] == (total, max(r[2] for r in own[: n + 1]), last)
            assert isl[k, i] == island


def test_overlap_join_equals_all_pairs(spark):
    random.seed(5)

    def make(n, big):
        out = [(i, "s", 0, float(random.randint(-50, 900)), float(random.randint(-50, 900)), float(random.randint(0, 150)), float(random.randint(0, 150))) for i in range(n)]
        return out + [(n + j, "s", 0, -4000.0, -4000.0, 9000.0, 9000.0) for j in range(big)]

    a, b = make(80, 1), make(80, 2)
    schema = "id int, source_key string, page_index int, x double, y double, w double, h double"
    left = spark.createDataFrame(a, schema).select("source_key", "page_index", F.col("id").alias("l"), rect(*map(F.col, "xywh")).alias("lr"))
    right = spark.createDataFrame(b, schema).select("source_key", "page_index", F.col("id").alias("r"), rect(*map(F.col, "xywh")).alias("rr"))
    got = sorted((r.l, r.r) for r in grid.overlap_join(left, right, "lr", "rr").collect())
    hit = lambda p, q: p[3] < q[3] + q[5] and p[3] + p[5] > q[3] and p[4] < q[4] + q[6] and p[4] + p[6] > q[4]
    assert got == sorted((p[0], q[0]) for p in a for q in b if hit(p, q))


def test_nearest_in_row(spark):
    random.seed(7)
    points = [("s", i, float(random.randint(0, 5000))) for i in range(60)]
    probes = [("s", i, float(random.randint(-50, 5050))) for i in range(60)]
    got = grid.nearest_in_row(
        spark.createDataFrame(probes, "k string, p int, px double"), spark.createDataFrame(points, "k string, q int, qx double"), ["k"], "px", "qx", "q", 256.0)
    best = {r.p: r.b for r in got.groupBy("p").agg(F.min_by("near_id", F.struct(F.abs(F.col("near_x") - F.col("px")), "near_id")).alias("b")).collect()}
    for _, p, px in probes:
        assert best[p] == min(points, key=lambda t: (abs(t[2] - px), t[1]))[1]


def test_joins_by_position_are_equi_joins(spark):
    schema = "source_key string, page_index int, x double, y double, w double, h double"
    a = spark.createDataFrame([("s", 0, 1.0, 1.0, 2.0, 2.0)], schema).select("source_key", "page_index", rect(*map(F.col, "xywh")).alias("a"))
    plan = grid.overlap_join(a, a.withColumnRenamed("a", "b"), "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "_cx" in plan
