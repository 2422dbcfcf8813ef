import re
from collections import Counter

import numpy as np

from pageframe.llm import phrases

SCHEMA = "doc_id long, text string, lang string, k int, words int, shard int, a string, c int"


def brute(rows, least, longest, top, covered=80):
    counts, out = {}, []
    for _, text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                own.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, f in counts.items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in wanted.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in wanted.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= covered * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, total, -s))
    return sorted(out)


def rows():
    rng = np.random.default_rng(3)
    pool = ["Alpha", "beta", "gamma", "delta", "é", " x", "Ж", "eta"]
    weight = np.array([8, 6, 4, 3, 2, 2, 1, 1]) / 27
    made = []
    for i in range(60):
        w = rng.choice(pool, int(rng.integers(0, 40)), p=weight)
        made.append((i, "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b"]) for x in w), [None, "en", "de"][i % 3]))
    made += [(i, "new york city hall", "en") for i in range(100, 130)] + [(131, "new york " * 3000, "en"), (132, None, "en"), (133, "", None), (134, " . ", "fr"), (None, "beta beta beta beta beta", None)]
    return made + [made[0]] * 3


def test_matches_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in data], SCHEMA).repartition(5)
    for least, longest, top, shards in ((5, 4, 2000, 3), (12, 3, 7, 1), (30, 4, 50, 4)):
        got = sorted(map(tuple, phrases.collocations(docs, least, longest, top, shards=shards).collect()))
        assert got == brute(data, least, longest, top)


def test_full_bit_arrays_and_short_stretches_change_nothing(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in data], SCHEMA)
    monkeypatch.setattr(phrases, "CHUNK", 50)
    raw = [(t or "").encode() for _, t, _ in data]
    words = [s.phrase(i, 1) for s in phrases.stretches(raw) for i in range(len(s.begin))]
    monkeypatch.setattr(phrases, "CHUNK", 1 << 21)
    assert words == [s.phrase(i, 1) for s in phrases.stretches(raw) for i in range(len(s.begin))]
    monkeypatch.setattr(phrases, "has", lambda bits, keys: np.ones(len(keys), bool))
    assert sorted(map(tuple, phrases.collocations(docs, 5).collect())) == brute(data, 5, 4, 2000)


def test_keys_of_long_words_differ_in_every_place():
    words = [b"w" * i + bytes([c]) + b"w" * (300 - i) for i in range(301) for c in b"abc"]
    (stretch,) = phrases.stretches([b" ".join(words)])
    for seed in (1, 2):
        key, _ = next(stretch.keys(phrases.Hash(seed), np.zeros(1, np.uint64), 1))
        assert len(np.unique(key)) == len(words)


def test_groups_of_clashing_keys_are_told_apart():
    key, check = np.array([5, 3, 5, 3, 5], np.uint64), np.array([1, 2, 9, 2, 1], np.uint64)
    order, first = phrases.grouped(key, check)
    groups = [sorted(x.tolist()) for x in np.split(order, first[1:])]
    assert sorted(groups) == [[0, 4], [1, 3], [2]]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
