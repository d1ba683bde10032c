"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, checkpoint_dir  # noqa: F401

#: The ASCII white space that separates words: \x20 and \x09-\x0D.
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that no other column can clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def plain_names(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., whatever they are called."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def words(text: Column) -> Column:
    """The words of a text; none for null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATOR), "")


#: Bytes of an Arrow batch, for all operators alike: plans run later than they are built.
BATCH = "6m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes too, as 10,000 long texts may not fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def trimmed(batches: Iterator) -> Iterator:
    """The batches that a task yields; at its end the worker gives freed memory back, as it lives on for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    gc.collect()
    if _TRIM:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow() over batches of bounded bytes."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def run_lengths(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def texts_of(batch, column: str = "text") -> Iterator[str]:
    """Each text of an Arrow batch, null as empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def slices(batch, column: str | int = "text", size: int = 6_000_000) -> Iterator:
    """The rows of an Arrow batch, in runs whose texts have about size bytes or less (one row at least)."""
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part, at = np.cumsum(lengths) // size, 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are saved."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
