from collections import defaultdict

import numpy as np

import corpus_pipeline as pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_substrings import brute as brute_bytes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choice(words, 12)) + "." for _ in range(n))
    passage = " ".join(rng.choice(words, 60))
    good = [text(int(rng.integers(6, 14))) for _ in range(60)]
    good += [text(4) + " " + passage + " " + text(4) for _ in range(4)]
    good += [good[3], good[3], good[4].replace(good[4].split(" ")[20], "edited", 1)]
    good = [f"Shared header line.\n{t}" if i % 2 else t for i, t in enumerate(good)]
    bad = ["LOUD!! " * int(rng.integers(20, 60)) for _ in range(25)]
    return [(i, t, int(i < len(good))) for i, t in enumerate(good + bad)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 15}", len(t or ""), "clash") for i, t, *_ in rows], COLUMNS)


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).drop("kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
        found = docs.collect()
        docs = spark.createDataFrame(found, docs.schema)
        kept[name] = {r.doc_id: r.text for r in found}
        assert all(r.n_chars == len(r.text) for r in found)
    good = {i for i, _, q in rows if q}
    assert set(kept["quality classifier"]) == good
    lines = brute_lines([(i, t, f"s{i % 15}") for i, t, q in rows if q], 10)
    assert kept["line dedup"] == {i: t for i, t, _, gone in lines if t.strip() or not gone}
    assert set(kept["SimHash near-dedup"]) == set(kept["line dedup"]) - {64, 65, 66}
    stayed = sorted(kept["SimHash near-dedup"])
    sizes = {i: n - m for i, (n, m, _, _) in zip(stayed, brute_bytes([kept["SimHash near-dedup"][i] for i in stayed]))}
    assert {i: len(t) for i, t in kept["suffix-array dedup"].items()} == sizes
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["suffix-array dedup"])
    full = defaultdict(int)
    for r in packed:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 4096


def test_unlike_texts_of_one_id_stay(spark):
    rng = np.random.default_rng(3)
    a, b, c = (" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(120)) for _ in range(3))
    near = a.replace(a.split(" ")[50], "edited", 1)
    rows = [(1, a), (1, b), (2, c), (3, near), (1, a), (4, b), (None, a), (None, c)]
    found = pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted([(1, a), (1, b), (2, c), (None, a), (None, c)], key=str)


def test_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, None), (1, ""), (1, ""), (2, None), (3, "word " * 30000), (4, "a\n\nb")]
    for docs in (frame(spark, rows), frame(spark, [])):
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= 40
