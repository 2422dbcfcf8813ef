"""Tokens stay in the task of their page: text is shuffled, what is made of it is not."""

import pytest

import pageframe.plans.all  # noqa: F401
from pageframe.plans import QUERIES


def shuffles(spark, name, sf):
    """Exchanges that the planner had to add beyond dealing out the lines, as the plan before execution names them."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return plan.count("ENSURE_REQUIREMENTS")


@pytest.fixture
def sf(spark, tmp_path):
    text = "\n".join(f"1. word{n} other 2 words {n}" for n in range(120))
    rows = [(n, text, "en", "web", len(text)) for n in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["win_1", "win_2", "win_3", "agg_1"])
def test_runs_shuffle_no_items(spark, sf, name):
    assert shuffles(spark, name, sf) == 0


@pytest.mark.parametrize("name", ["join_2", "join_3", "join_4", "join_5", "qa_1", "agg_12"])
def test_nearest_matches_shuffle_no_items(spark, sf, name):
    assert shuffles(spark, name, sf) == 0


@pytest.mark.parametrize("name", ["join_10", "win_5", "agg_2"])
def test_paragraphs_shuffle_no_lines(spark, sf, name):
    assert shuffles(spark, name, sf) == 0


def test_justification_looks_at_a_block_once(spark):
    from pyspark.sql import functions as F

    from pageframe.operators.blocks import justified_flags

    rows = spark.sql("SELECT array(named_struct('text', '1. a', 'left', 100D, 'width', 50D, 'height', 24D)) AS lines")
    plan = rows.select(justified_flags(F.col("lines")).alias("j"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("rlike") == 2


def test_capture_shuffles_no_shows(spark, sf):
    assert shuffles(spark, "join_7_fallback", sf) == 0


def test_decoration_candidates_shuffle_no_shapes(spark, sf):
    from pageframe.operators.runs import decoration_candidates
    from pageframe.plans import runs as rp

    found = decoration_candidates(rp._shapes(spark, sf), rp._pdf_runs(spark, sf))
    assert found._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0


def test_met_in_band_equals_pairs_of_a_page(spark):
    from pageframe.operators.grid import met_in_band

    rows = [(k, p, float(n * n % 37) / 2) for p in (0, 1, 2, None) for n, k in enumerate(range(40))]
    marks = [(k, p, float(n * 7 % 20), 1.0 + n % 3) for p in (0, 1, 3, None) for n, k in enumerate(range(15))]
    left = spark.createDataFrame([("s", p, k, y) for k, p, y in rows], "source_key string, page_index int, a int, y double")
    right = spark.createDataFrame([("s", p, k, v, r) for k, p, v, r in marks], "source_key string, page_index int, b int, v double, r double")
    found = met_in_band(left, right, "y", "v", "r").where("abs(y - v) <= r").collect()
    want = sorted((p, k, b) for k, p, y in rows for b, q, v, r in marks if p == q and p is not None and abs(y - v) <= r)
    assert sorted((x.page_index, x.a, x.b) for x in found) == want
