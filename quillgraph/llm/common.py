"""What the training-data operators share: inputs, the shared folder, checkpoints, components.

Operators never assume that the driver and the executors share a local disk. Everything that
outlives a task goes to the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import components

__all__ = ["components", "cut", "filesystem", "free", "freed", "fresh_dir", "let", "pieces", "settle", "shared_dir", "table"]

#: Rows of an Arrow batch that Spark hands to Python; long texts make the default of 10,000 too many.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; batches are also made small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return runtime.shared_dir(spark)


def fresh_dir(spark: SparkSession, what: str) -> str:
    shared_dir(spark)
    return runtime.fresh_dir(spark, what)


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage, in reliable storage."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def settle(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again: its size is then known when joins are planned."""
    path = fresh_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder in any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also when lambdas use it many times."""
    # the lambda has one argument whatever ``body`` takes: with two, Spark passes the index as well
    return F.transform(F.array(value), lambda x: body(x))[0]


def freed(scan):
    """``scan`` (batches to batches) that gives unused memory back to the system when it ends.

    Spark keeps Python workers for later tasks; without this they keep their highest size as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds at most ``most`` bytes, or one row."""
    import numpy as np

    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("f8")))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
