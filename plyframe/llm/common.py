"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20

#: Words are runs of code points other than these blanks.
WORD = r"[^\x20\x09-\x0D]+"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder of `spark.checkpoint.dir`.

    Where neither the setting nor a checkpoint folder exists, a folder in the warehouse is used in local mode, where one
    machine is all there is; on a cluster that is an error, as no folder is known to be shared.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint if `df`, counted, stays within BROADCAST_ROWS; otherwise `df` as it is, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unnamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns named by place, and the new name of each; keeps operators' own names from clashing."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `size` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, size // per)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def release() -> None:
    """Give memory that Arrow and the C library hold free back to the machine: idle Python workers then stay small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` that releases memory at the end of each task.

    Batches are held to BATCH_BYTES where the session does not say otherwise: ten thousand long texts would be one batch.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)
