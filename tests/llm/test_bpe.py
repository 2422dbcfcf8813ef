import gc
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from pageframe.llm import bpe
from pageframe.llm.store import no_collection

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = np.random.default_rng(0)
    letters = list("abcdefghijklmnopqrstuvwxyzéñßçż ABC019.,!\n\t'") + ["日本", "😀", "в", "的", "  ", "'re", " ", "ـ"]
    out = ["".join(rng.choice(letters, int(rng.integers(1, 300)))) for _ in range(300)]
    out += ["a" * 3000, "ab" * 700, " " * 500 + "x", "\n" * 77, "=" * 999, "don't you're", "", "<|endoftext|>", "0123456789" * 40, "the " * 3000]
    return out


def test_ids_equal_the_library(peer):
    code = bpe.Coder(PATH, P.PATTERN)
    for text in texts():
        assert code.encode(text) == peer.encode_ordinary(text), text[:80]


def test_transducer_equals_direct_merges():
    code = bpe.Coder(PATH, P.PATTERN)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        piece = bytes(rng.choice(list(b"etaoinshr ETA\xc3\xa9\xf0\x9f"), int(rng.integers(1, 40))).tolist())
        want = [code.ranks[piece]] if piece in code.ranks else [code.ranks[t] for t in bpe.merged(piece, code.ranks)]
        assert code.pieces.encode(piece) == want


def test_decoder_streams_and_mends_bad_bytes(peer):
    code = bpe.Coder(PATH, P.PATTERN)
    rng = np.random.default_rng(2)
    for _ in range(500):
        ids = rng.integers(0, 50_000, int(rng.integers(0, 30))).tolist()
        assert code.decode(ids) == b"".join(code.decoder.tokens[i] for i in ids).decode("utf-8", "replace")
    chunks = list(code.decoder.stream(code.encode("😀 né")))
    assert "".join(chunks) == "😀 né"


def test_round_trip(spark, peer):
    rows = [*enumerate(texts()), (900, None), (None, "x"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(i, t, "clash", "") for i, t in rows], SCHEMA).repartition(3)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for i, t in rows:
        ids = peer.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, bpe.round_trip(docs, PATH, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    ids = bpe.encoded(docs, PATH, P.PATTERN)
    assert sorted((str(r.doc_id), r.text) for r in bpe.decoded(ids, PATH, P.PATTERN).collect()) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_dropped_states_need_no_collection(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 40)
    encode = bpe.Transducer(bpe.read_ranks(PATH))
    rng = random.Random(4)
    gc.collect()
    with no_collection():
        before = sum(isinstance(x, bpe.State) for x in gc.get_objects())
        for _ in range(400):
            encode("".join(rng.choices("abcdeé ", k=12)).encode())
        assert not gc.isenabled()
        assert sum(isinstance(x, bpe.State) for x in gc.get_objects()) - before < 100
    assert gc.isenabled()
