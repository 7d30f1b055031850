"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.session import discard, scratch


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and the files outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for table in tables:
        discard(table.sparkSession, table._scratch)


def partitions_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions for a shuffle of df: the session's number, or more where that makes them larger than each bytes by the plan's estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # where Spark knows no size, as of local rows, it takes one beyond all tables
    return known if size > 1 << 55 else max(known, min(-(-size // each), 100_000))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with null texts as empty ones; other columns go unless named."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives unused memory back at the end of a task: Python workers live on, and several share an executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def ship(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Sends this package to the executors, once a session's context: their Python may not find it otherwise.

    It also bounds the rows and bytes that go to Python at once, as texts may be long; both settings hold for the session.
    """
    import shutil
    from pathlib import Path

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    context = spark.sparkContext
    if getattr(context, "_loomrec_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='loomrec-')}/loomrec-code", "zip", root, "loomrec")
    context.addPyFile(archive)
    context._loomrec_sent = True
