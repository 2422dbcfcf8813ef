import hashlib
from collections import Counter

import numpy as np

from pageframe.llm import weighted

SCHEMA = "doc_id long, text string, bucket int, fingerprint string"


def edit(texts):
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[: len(t) - half] + texts[(i + 1) % len(texts)][:half])
    return out


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def test_texts_edits_and_likeness(spark):
    rng = np.random.default_rng(0)
    words = [f"wörd{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words[: int(rng.integers(5, 400))], int(rng.integers(1, 300)))) for _ in range(150)]
    texts += [texts[-1], "", " \n", "", "😀 ü" * 30, "long " * 20000]
    ids = [int(x) for x in np.sort(rng.choice(9000, len(texts), replace=False))]
    docs = spark.createDataFrame([(i, t if t else None, 1, "clash") for i, t in zip(ids, texts)], SCHEMA).repartition(5)
    rows = sorted(weighted.fingerprints(docs, samples=64).collect(), key=lambda r: r.doc_id)
    edited = edit(texts)
    assert [r.doc_id for r in rows] == ids and [r.n_chars for r in rows] == [len(t) for t in texts]
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    prints = {}
    for t, r in zip(texts + edited, [r.fingerprint for r in rows] + [r.edited_fingerprint for r in rows]):
        assert prints.setdefault(t, r) == r
    off = [r.near_edited - jaccard(a, b) for r, a, b in zip(rows, texts, edited)]
    off += [r.near_next - jaccard(a, b) for r, a, b in zip(rows, texts, texts[1:] + texts[:1])]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.08


def test_odd_rows(spark):
    assert weighted.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b"), (3, "a b"), (3, "a b"), (3, None), (1 << 40, "c d")]
    found = weighted.fingerprints(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)).collect()
    assert len(found) == 5 and len({r.fingerprint for r in found}) == 3
    one = weighted.fingerprints(spark.createDataFrame([(7, "abcd", 0, "")], SCHEMA)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_no_python_in_the_plan(spark):
    plan = weighted.fingerprints(spark.createDataFrame([(1, "a", 0, "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_disjoint_texts_are_unlike(spark):
    texts = [" ".join(f"{name}{i}" for i in range(20_000)) for name in ("left", "right")]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    assert max(r.near_next for r in weighted.fingerprints(docs).collect()) < 0.04


def test_default_samples_keep_the_spread(spark):
    piece = lambda i: " ".join(f"p{i % 300}w{j}" for j in range(10))
    docs = spark.createDataFrame([(i, piece(i) + " " + piece(i + 1), 0, "") for i in range(300)], SCHEMA)
    off = [r.near_next - 1 / 3 for r in weighted.fingerprints(docs).collect()]  # deviation 0.059 with 64 samples, 0.083 with 32
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.07
