import numpy as np
import public_tokenizers as P
import pytest

from pageframe.llm import token_files as files
from pageframe.llm.store import located
from pageframe.session import fresh_path

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, n_tokens string, file string"


@pytest.mark.parametrize("block_bytes", [1 << 22, 64, 2])
def test_counts(spark, block_bytes):
    texts = ["", "a", "hello world", None, "x y z " * 700, "<|endoftext|>", "é" * 50, "", ""]
    if block_bytes == 2:
        texts = texts[:4]
    docs = spark.createDataFrame([(i, t, "", "clash") for i, t in enumerate(texts)] + [(None, "a", "", ""), (1, "a", "", "")], SCHEMA).repartition(2)
    encode = files._encoder(PATH, P.PATTERN).encode_ordinary
    want = [(i, len(encode(t or ""))) for i, t in enumerate(texts)] + [(None, 1), (1, 1)]
    got = files.token_counts(docs, PATH, P.PATTERN, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert files.token_counts(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_foreign_files_without_last_separator(spark):
    folder = fresh_path(spark, "foreign")
    system, root = located(folder)
    system.create_dir(root, recursive=True)
    for name, ids in {"a": [1, 2, 50256, 50256, 7, 8, 9], "b": [50256], "c": [4]}.items():
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(np.array(ids, "<u2").tobytes())
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    for size in (4, 6, 1024):
        got = sorted(map(tuple, files.document_counts(spark, folder, names, block_bytes=size).collect()))
        assert got == [("a", 0, 2), ("a", 1, 0), ("a", 2, 3), ("b", 0, 0), ("c", 0, 1)]
