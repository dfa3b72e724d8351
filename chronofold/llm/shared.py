"""Helpers that several corpus operators use."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropping_shuffles, shared_dir


def scratch(spark, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a written table: later steps start from its files, whichever executors are lost.

    The shuffle files of the write are dropped with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with dropping_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the key as text, modulo `folds`; 0 is held out. A null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(1).cast("bigint"))


def documents(spark, directory: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/documents.parquet").select(*columns or ("doc_id", "text"))


def give_back() -> None:
    """Freed memory of this process goes back to the system, as far as its allocators can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, whose worker gives memory back after the task: workers outlive it, and what each step left unused in them would add up."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
