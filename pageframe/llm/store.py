"""Files and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from pageframe.session import fresh_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and continue from the copy.

    The copy survives lost executors, and later reads prune its columns.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; a plain path is a local one."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds the Python objects of a few texts only."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
        pa.default_memory_pool().release_unused()


@contextmanager
def no_collection() -> Iterator[None]:
    """Without the search for rings, which walks over large caches again and again. What runs in it leaves no rings behind."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`mapInArrow` for a function that turns one batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield function(batch)

    return df.mapInArrow(run, schema)
