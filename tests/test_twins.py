"""Plans against their SQL twins on odd rows."""

import duckdb
import pytest

import pageframe.plans.all  # noqa: F401
from pageframe.plans import ORACLES, QUERIES


@pytest.fixture
def twins(spark, tmp_path):
    """Rows of a plan and of its twin over small tables given as (rows, schema)."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            spark.createDataFrame(rows, schema).write.parquet(path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        found = QUERIES[name](spark, str(tmp_path))
        wanted = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({ORACLES[name]})").fetchall()
        return sorted(map(tuple, found.collect()), key=repr), sorted(wanted, key=repr)

    return run


def documents(*texts):
    return [(n, t, "en", "web", len(t)) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"


def test_block_of_a_right_to_left_document_that_starts_with_digits(twins):
    found, wanted = twins("txt_23", documents=documents("abc\n 12\nx", "2024 12\nabc def\nghi", "ދިވެހި\nabc", "***\nq w"))
    assert found == wanted


def test_cmap_codes_beyond_four_digits(twins):
    keys = [50 * j + f for j in (0, 1, 2, 12760, 12761, 13200, 13201, 13202, 13203) for f in (0, 7)]
    found, wanted = twins("src_10", part=([(k,) for k in keys], "p_partkey long"))
    assert found == wanted
