import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pageframe.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string, length string"


def test_packs_every_piece_once(spark):
    rng = np.random.default_rng(0)
    words = ["Ünïcode", "it's", "don't,", "42nd", "naïve.", "x́y", "ΣΑΣ", "İstanbul", "ab!!", "\x1cq", "a\xa0b", "<|endoftext|>", "é"]
    words += ["".join(rng.choice(list("abcdefgHIJ"), int(rng.integers(1, 9)))) for _ in range(200)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 2500)))) for _ in range(60)] + ["", None, " \n", "word " * 9000, "the end", "the end", "x" * 5000]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)] + [(None, "the end", "", "")], SCHEMA).repartition(3)
    rows = packing.packed(docs, VOCABULARY, block=7).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in [*enumerate(texts), (None, "the end")]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in got] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 4096) + 2


def test_plan_is_close_to_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.3, 1, 60_000).astype(int), 1, 4096)
    histogram = np.bincount(lengths, minlength=4097)
    plan = packing.plan_slots(histogram)
    assert plan.used <= 1.003 * lengths.sum() / 4096 + 1


@pytest.mark.parametrize("counts", [{}, {4096: 5}, {1: 3}, {2049: 7}, {1500: 10, 1300: 9}])
def test_small_histograms(counts):
    histogram = np.zeros(4097, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plan = packing.plan_slots(histogram)
    assert sum(s[1] for s in plan.slots) == histogram.sum()
    assert plan.used <= sum(counts.values())


def test_fit_counts_recovers_an_exact_mixture():
    steps = packing.patterns(16, 3)
    assert sorted(map(tuple, steps.tolist())) == sorted({tuple(sorted((a, b, 16 - a - b), reverse=True)) for a in range(1, 16) for b in range(0, 16 - a + 1) if 16 - a - b >= 0 and max(a, b, 16 - a - b) < 16})
    uses = np.array([[np.count_nonzero(row == i) for row in steps] for i in range(1, 17)], float)
    x = np.zeros(len(steps))
    x[[1, 4, 9]] = [5, 2, 7]
    fitted = packing.fit_counts(uses, uses @ x)
    assert np.allclose(uses @ fitted, uses @ x, atol=1e-6) and fitted.min() >= 0


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def test_words_beyond_the_cache_and_words_without_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    words, tokenizer = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for texts in (["Abc", "naïve.", "\xa0"], ["abc!", "Straße", "\xa0", " ", "x́y"], ["q;", "zz", "Abc", "don't"]):
        wanted = {t.encode() for t in texts}
        known = words(wanted)
        for t in texts:
            assert known(t.encode()) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(words.words) <= 5 and len(words.cores) <= 5
