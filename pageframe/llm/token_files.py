"""Token counts of documents in flat token files, by a scan for separators.

A token file is nothing but 16-bit ids, each document followed by the end-of-document
id; there is no index. Files are cut into blocks of bytes that tasks read on their own.
A block is compared with the separator as one vector. What crosses block borders, the
number of separators before a block and the place of the last one, is a prefix scan
over one summary row for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm.store import located, sliced, written
from pageframe.operators.scan import with_running
from pageframe.session import fresh_path

SEPARATOR = 50_256
_encoders: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Write one flat file a task; (file, ordinal, doc_id) says which document is which in a file, and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        system.create_dir(root, recursive=True)
        encoder, out, at = _encoder(vocabulary, pattern), None, 0
        name = f"{uuid.uuid4().hex}.tokens"
        for batch in sliced(batches):
            out = out or system.open_output_stream(f"{root}/{name}", compression=None)
            for content in batch.column(1).to_pylist():
                out.write(np.array([*encoder.encode_ordinary(content or ""), SEPARATOR], "<u2").tobytes())
            n = batch.num_rows
            columns = [pa.array([name] * n), pa.array(np.arange(at, at + n)), batch.column(0)]
            at += n
            yield pa.RecordBatch.from_arrays(columns, ["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return written(source.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-order")


def blocks_of(spark: SparkSession, folder: str, files: DataFrame, block_bytes: int = 1 << 22) -> DataFrame:
    """(file, block): every block of the files; sizes are asked for in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for batch in batches:
            names, numbers = [], []
            for name in batch.column(0).to_pylist():
                n = -(-system.get_file_info(f"{root}/{name}").size // block_bytes)
                names += [name] * n
                numbers += range(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["file", "block"])

    return files.select("file").distinct().mapInArrow(run, "file string, block long")


def document_counts(spark: SparkSession, folder: str, files: DataFrame, separator: int = SEPARATOR, block_bytes: int = 1 << 22) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files; tokens after the last separator of a file are one more, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for batch in batches:
            for name, block in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(f"{root}/{name}") as stream:
                    size = stream.size()
                    stream.seek(block * block_bytes)
                    ids = np.frombuffer(stream.read(block_bytes), "<u2")
                base = block * block_bytes // 2
                found = np.flatnonzero(ids == separator) + base
                if (base + len(ids)) * 2 >= size and (not len(ids) or ids[-1] != separator):
                    found = np.append(found, base + len(ids))
                n = len(found)
                columns = [pa.array([name]), pa.array([block]), pa.array([n]), pa.array([found[-1] if n else None], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "last", "ends"])

    scanned = blocks_of(spark, folder, files, block_bytes).repartition("file", "block").mapInArrow(run, "file string, block long, n long, last long, ends array<long>")
    scanned = written(scanned, "separators")
    carried = with_running(
        scanned.select("file", "block", "n", "last"),
        ["file"],
        "block",
        {"before": ("sum", F.col("n")), "previous": ("max", F.col("last"))},
        block=4096,
        exclusive=True,
    )
    joined = scanned.join(carried.select("file", "block", "before", "previous"), ["file", "block"])
    ends = joined.select("file", "block", "ends", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("previous", F.lit(-1)).alias("previous"))
    each = ends.select("file", "before", F.posexplode("ends").alias("pos", "end"), F.concat(F.array("previous"), "ends").alias("starts"))
    return each.select("file", (F.col("before") + F.col("pos")).alias("ordinal"), (F.col("end") - F.expr("starts[pos]") - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", block_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, n_tokens): write flat token files of the documents, then count by scanning them.

    A null or empty text has 0 tokens, a very long one spans blocks; equal rows each have a row; a null doc_id stays null.
    Other columns are ignored, and an empty table gives no file and no row.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    order = write_token_files(docs, folder, vocabulary, pattern, text)
    counts = document_counts(spark, folder, order, block_bytes=block_bytes)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
