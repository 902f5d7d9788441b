"""Common shapes of the operators: bounded Arrow batches and row-wise Python passes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch sent to a Python worker; whichever comes first ends it.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep the batches of this session's Python passes within the bounds above."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are skipped."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from make(b)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the system: a worker that is kept for later tasks holds what the largest of them took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def is_null(column: pa.Array) -> "np.ndarray":  # noqa: F821
    return column.is_null().to_numpy(zero_copy_only=False)
