"""CSV scans, the parquet landing step and small literal tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV. Without a schema Spark reads the file twice to infer one: profiling only."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_quoted_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    key: str | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Header CSV whose quoted fields may hold commas, doubled quotes and newlines.

    Such files cannot be split between tasks, so land a big set once with `land_parquet`
    and read that from then on. `n_rows` caps the result to the first rows by `key`.
    """
    df = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .schema(schema)
        .csv(path)
    )
    if n_rows is None:
        return df
    if key is None:
        raise ValueError("a row cap needs an ordering key")
    return df.orderBy(key).limit(n_rows)


def land_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a frame once as parquet so that later scans split, prune and push down."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, which all executors share.

    Where it is unset on one machine (tests), a folder of our own is set; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    For narrow results of costly work that are read several times; they outlive lost executors.
    Inside a block of `temporary` they are deleted at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skarn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _blocks:
        _blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `stored` writes inside the block when it ends, also by an error.

    Results must have been written or counted by then; blocks may be nested.
    """
    held: list[str] = []
    _blocks.append(held)
    try:
        yield
    finally:
        _blocks.remove(held)
        for name in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_blocks: list[list[str]] = []  # tables of the open blocks of `temporary`, the innermost last


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows to as many partitions as the caller asks for in `skarn.inputPartitions`; as they are without it.

    For inputs of few splits whose rows are costly to work on. Nothing about the input is looked at.
    """
    parts = df.sparkSession.conf.get("skarn.inputPartitions", None)
    return df.repartition(int(parts), key) if parts else df


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def literal_table(spark: SparkSession, columns: dict[str, str], rows: Iterable[Sequence[object]]) -> DataFrame:
    """Small parameter table as an inline VALUES relation.

    Its exact size is known to the optimizer, which broadcasts it below
    `spark.sql.autoBroadcastJoinThreshold` without a hint.
    """
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(columns)
    frame = spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
    return frame.select(*[F.col(name).cast(dtype).alias(name) for name, dtype in columns.items()])
