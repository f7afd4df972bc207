"""Bounded Arrow batches and further helpers for the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, ship

__all__ = ["OWN", "bounded_batches", "discard", "is_small", "lean", "materialize", "read", "text_or_empty"]

#: Prefix of helper columns; columns of the caller never clash with them.
OWN = "__cv_"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound Arrow batches by rows and bytes, so that long texts do not pile up in a worker; send this package along."""
    ship(spark)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            spark.conf.set(key, value)
        except Exception as e:  # the byte bound is missing in some releases; rows still bound the batch
            if "CANNOT_MODIFY" not in str(e):
                raise


def is_small(df: DataFrame, most_rows: int, most_cells: int, cells) -> bool:
    """Whether ``df`` may be broadcast: at most ``most_rows`` rows and ``most_cells`` of what ``cells`` counts a row."""
    n, total = df.agg(F.count("*"), F.sum(cells)).first()
    return n <= most_rows and (total or 0) <= most_cells


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, after which a worker that waits for reuse gives freed memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole
