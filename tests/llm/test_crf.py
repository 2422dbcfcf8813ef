import zlib
from itertools import product

import numpy as np

from pageframe.llm import crf

SCHEMA = "doc_id long, text string, score double, held_out string"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    scores, sizes = crf.padded([rng.normal(size=n) for n in (1, 4, 6)])
    moves = rng.normal(size=(2, 2))
    good, expected = crf.forward_backward(scores, sizes, moves)
    for row, n in enumerate(sizes):
        total, on, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(scores[row, t] for t in range(n) if path[t]) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            on += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                pairs[a, b] += weight
        assert np.allclose(good[row, :n], on / total) and np.allclose(expected[row], pairs / total)


def test_line_features_count_bytes():
    features, weights = crf.line_features("Ab 1!\n\né\xa0x\nq q q")
    assert weights.tolist() == [6, 1, 6, 6]
    assert np.allclose(features[0, :8], [0.2, 0.2, 0.2, 0.2, 0, 0.2, 0, 0]) and features[3, 10] == 2 / 3
    assert np.allclose(features[1, 13:26], features[0, :13]) and np.allclose(features[1, 26:], features[2, :13])
    assert crf.line_features(None)[1].tolist() == [1.0]


def documents():
    rng = np.random.default_rng(1)
    words = ["tree", "river", "stone", "walks", "along", "the", "and", "green", "slow"]
    sentence = lambda: " ".join(rng.choice(words, 9)).capitalize() + "."
    junk = lambda: " | ".join(rng.choice(words, 9)) if rng.random() < 0.5 else ("BUY!! " * 8)
    rows = []
    for i in range(400):
        make = sentence if i % 4 else junk
        rows.append((i, "\n".join(make() for _ in range(int(rng.integers(1, 9))))))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = documents()
    extra = [(None, None), (1000, ""), (1001, "Tree walks. " * 20000), (1002, "| x " * 20000), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 9.0, "clash") for i, t in rows + extra], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    found = crf.scored(docs, crf.fit_quality(docs, labels)).collect()
    assert len(found) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    out = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(out) > 60 and np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in out]) > 0.97
    assert len({r.score for r in found if r.doc_id == 5}) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert crf.scored(docs, crf.fit_quality(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "a", 0.0, "")], SCHEMA)
    assert crf.scored(one, crf.fit_quality(one, labels)).first().score == 0.5


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    taken = []
    fit = crf.fit
    monkeypatch.setattr(crf, "fit", lambda features, labels: taken.append(len(labels)) or fit(features, labels))
    rows = documents()
    rows += [(i, f"{t}\nAnother line {n}.") for i, t in rows for n in range(3)]
    docs = spark.createDataFrame([(r[0], r[1], 0.0, "x") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    crf.fit_quality(docs, labels, most_docs=5)
    assert taken[0] <= 5
    crf.fit_quality(docs, labels)
    assert 5 < taken[1] <= 400
