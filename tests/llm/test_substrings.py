import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from pageframe.llm import substrings

SCHEMA = "doc_id long, text string, id int, kept string, tag string"


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i + 1 : i + 1 + length] = True
        spans = int((cover[1:] & ~cover[:-1]).sum())
        mask = cover[1 : len(d) + 1]
        kept = bytes(np.frombuffer(d, np.uint8)[~mask])
        out.append((len(d), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé ðz\n"), int(rng.integers(2, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    texts = [text(int(rng.integers(0, 200))) for _ in range(40)]
    texts += [text(30) + passage + text(int(rng.integers(0, 40))) for _ in range(12)]
    for _ in range(12):
        parts = texts[3].split(" ")
        parts[int(rng.integers(len(parts)))] = "edit"
        texts.append(" ".join(parts))
    texts += [texts[5], texts[5], "", None, "x", "a" * 900, "ab" * 150, passage[:160], passage + passage, text(4000), "z" * 199, "z" * 199]
    return texts


@pytest.mark.parametrize("seed,hot,tile", [(1, 4096, 1 << 20), (2, 3, 1 << 20), (3, 4096, 3000), (4, 1, 1000)])
def test_matches_brute_force(spark, monkeypatch, seed, hot, tile):
    texts = corpus(seed)
    monkeypatch.setattr(substrings, "TILE", tile)
    docs = spark.createDataFrame([(i, t, 3, "clash", "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    found = substrings.without_repeats(docs, hot=hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(enumerate(brute(texts)))


def test_repeated_rows_missing_ids_and_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    other = "".join(chr(97 + i * i * i % 26) + str(i * 7) for i in range(200))
    rows = [(1, long), (1, long), (1, other), (None, "q" + other), (None, None)]
    docs = spark.createDataFrame([(i, t, 0, "", "") for i, t in rows], SCHEMA)
    got = sorted((r.n_bytes, r.n_removed) for r in substrings.without_repeats(docs).collect())
    assert got == sorted((n, m) for n, m, _, _ in brute([t for _, t in rows]))


def test_kept_text_is_cut_at_characters(spark):
    shared = "é" * 300
    docs = spark.createDataFrame([(1, "a" + shared + "b", 0, "", ""), (2, "ü" + shared, 0, "", "")], SCHEMA)
    got = {r.doc_id: r.kept for r in substrings.without_repeats(docs, keep_text=True).collect()}
    assert got[1] == "ab" and got[2] == "ü"


def test_rows_of_one_id_and_tag_keep_their_own_runs(spark):
    passage = "".join(f"<{i}>" for i in range(100))
    first = passage + "first"
    other = next(t for t in (f"{i} " + "".join(f"({j})" for j in range(200)) for i in range(1_000_000)) if (zlib.crc32(t.encode()) ^ zlib.crc32(first.encode())) & 0xFFFF == 0)
    for id_ in (None, 7):
        docs = spark.createDataFrame([(id_, first), (id_, other), (9, passage)], "doc_id long, text string")
        got = {r.n_bytes: r.n_removed for r in substrings.without_repeats(docs).collect()}
        assert got == {len(first): len(passage), len(other): 0, len(passage): len(passage)}
