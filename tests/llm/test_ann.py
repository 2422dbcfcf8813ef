import numpy as np

from pageframe.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim string"


def brute(ids, vectors, every, k):
    out = {}
    for i, q in zip(ids, vectors):
        if i % every == 0:
            d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
            out[i] = sorted((float(x), int(j)) for x, j in zip(d, ids) if j != i)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32))
    vectors = (centres[rng.integers(20, size=3000)] + 0.5 * rng.normal(size=(3000, 32))).astype(np.float32)
    vectors[500:900] = vectors[500]
    ids = np.arange(3000)
    docs = spark.createDataFrame([(int(i), v.tolist(), 0, "clash", "") for i, v in zip(ids, vectors)], SCHEMA)
    want = brute(ids, vectors.astype(float), 100, 10)
    got = {}
    for r in ann.nearest(docs, block=700, query_block=11).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    hits = [len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want]
    assert sum(hits) >= 0.95 * 10 * len(want)
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        assert np.allclose([s for s, _ in found], [np.linalg.norm(vectors[j].astype(float) - vectors[q].astype(float)) for _, j in found])


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [2.0, 0.0]), (6, [3.0, 1.0, 1.0]), (None, [1.0, 1.0]), (5, [2.0, 0.0]), (100, [1.0, 0.0]), (7, [float("inf"), 1.0]), (8, [])]
    docs = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in ann.nearest(docs).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 5, 1.0), (100, 1, 0, 0.0), (100, 2, 5, 1.0)]
    assert ann.nearest(docs.limit(0)).collect() == []
