"""Folders, stored tables and input helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from skarn.sources.files import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, with this package on the executors that will work on it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batch: pa.RecordBatch, column: str, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of a batch with at most `most` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application.

    Functions then travel by name, and what a worker has loaded (tokenizers, caches) serves all tasks it runs.
    """
    context = spark.sparkContext
    if getattr(context, "_skarn_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="skarn-")) / "skarn-package.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._skarn_shipped = True
