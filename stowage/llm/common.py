"""What the operators share: reading tables, cutting lineage, and sizes."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts that are worked on together; a longer text is by itself.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors must see.

    Where the session names none, a folder of this machine will do if all runs in one process; else there is no fallback.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isEmpty():
        return found.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files: a lost executor then costs nothing of what came before."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of shuffle files (and checkpoints, where Spark cleans them) of steps that are done.

    Spark removes them when the driver's garbage is collected, which a driver with little to do may put off for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a value together with its class, so that executors need no copy of this package; the result gives it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many rows, and of at most SLICE_BYTES of text or one row."""
    sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and (held + n > SLICE_BYTES or i - first >= rows):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def learns(doc_id: Column) -> Column:
    """Rows that models may learn from: crc32 of the id's text, mod 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2
