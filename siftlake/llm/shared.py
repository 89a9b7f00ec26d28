"""Shared folder, stored steps and small helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a Python worker gets at a time.  An executor keeps buffers of this size for each of many threads, so it is small.
BATCH = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of this machine where that is unset, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        configured = os.path.join(tempfile.mkdtemp(prefix="siftlake-"), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: each row is computed once and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(df: DataFrame) -> DataFrame:
    """Have Spark hand Python workers about ``BATCH`` bytes at a time in this session, where it would by default send 10,000 rows of any length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_interval(*columns) -> F.Column:
    """A number in [0, 1) that is the same in every run for the same values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` units hold ``total`` units."""
    return max(least, -(-int(total or 0) // each))


def unsliced(array: pa.Array) -> pa.Array:
    """A copy with buffers of its own.  Some of Arrow's text functions misread arrays that begin inside another's buffers."""
    return pa.concat_arrays([array, array.slice(0, 0)])


def small(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The rows of the batches with about ``size`` bytes of text at a time, or one row where it has more.

    Spark cuts batches by rows, however long their texts are; what a worker holds beside a batch follows these slices.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
            yield pa.RecordBatch.from_arrays([unsliced(c.slice(a, b - a)) for c in batch.columns], schema=batch.schema)
            a = b
        del batch
        pa.default_memory_pool().release_unused()
