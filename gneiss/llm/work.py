"""Intermediate tables in the folder that all machines share, and helpers for Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch while a table is written: texts are long, and a batch is in memory whole.
ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so lost executors cost no recomputation.

    Shuffle files of the plan go as soon as the table is there; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gneiss/{name}-{uuid.uuid4().hex}"
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(min(rows if rows > 0 else ROWS, ROWS)), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._gneiss_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> Column:
    """A whole row as one struct: beside it, columns can have any names."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpacked(row: str, names: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a packed row by their names."""
    return [F.col(row).getField(c).alias(c) for c in names if c not in without]


def give_back() -> None:
    """Returns free memory to the system: a Python worker outlives its task, idle beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidied(run):
    """``run``, a function on Arrow batches, with its memory given back when a task is over."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def text_pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary column into runs of rows of about ``limit`` bytes, at least one row each.

    Yields (first row, end row, bytes, offsets): row ``first + i`` is ``bytes[offsets[i]:offsets[i + 1]]``.
    Null rows are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def take(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> pa.Array:
    return batch.column(name).take(pa.array(rows))
