"""Shared-folder tables and Arrow helpers used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of the tables made in each ``scratch`` that is open, the innermost last.
MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, one is made in local mode only (tests): elsewhere
    a folder of one machine would lose what other machines write.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blocklens-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/blocklens/{tag}-{uuid.uuid4().hex}"
    open_, at = MADE.get(), 2 if keep else 1
    if len(open_) >= at:
        open_[-at].append(path)
    return path


def materialize(df: DataFrame, tag: str, keep: bool = False, free: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what came before.
    With ``keep`` the table outlives the scratch that is open. ``free`` is for tables made
    through large shuffles: Spark deletes a shuffle's files once the driver has collected
    what refers to it, which this asks for at once.
    """
    path = new_path(df.sparkSession, tag, keep)
    df.write.parquet(path)
    if free:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables made since its beginning, but for those to keep."""
    made: list[str] = []
    held = MADE.set((*MADE.get(), made))
    try:
        yield
    finally:
        MADE.reset(held)
        for path in made:
            delete(spark, path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by ``materialize`` once nothing reads it."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/blocklens/" in name:
            delete(df.sparkSession, name)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``, read off its plan; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def pieces_for(df: DataFrame, each: int = 1 << 22, most: int = 1 << 16, least: int = 64) -> int:
    """Into how many pieces work over ``df`` is dealt: by its size, and at least by the session's shuffle."""
    return min(most, max(shuffle_partitions(df.sparkSession), least, plan_bytes(df) // each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut rows into runs of about ``limit`` bytes; a longer row is a run of its own."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; others can't clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def with_columns(batch: pa.RecordBatch, made: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])


def as_long(value: np.ndarray) -> np.ndarray:
    return value.view(np.int64)


def null_safe_eq(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
