"""Range cuts: an order too long for one task, stored in stretches of about equal size.

A sampled range exchange deals the rows by their place in the order, whatever they have in
common, so one day of one series spreads as well as many series do. Inside a cut the rows are
sorted, and what a row needs to know of the cuts before it comes from one small row per cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.sources.files import stored

CUT, AT = "_cut", "_at"


def in_cuts(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Add `_cut`, the number of the stretch in which a row lies, and `_at`, its place there, from 0.

    Rows that agree on all of `by` share a cut.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the id of a row is its partition, then 33 bits of its place
    return ordered.withColumns({CUT: F.spark_partition_id(), AT: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


def ranged(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """`in_cuts`, stored: sampled cuts would not come out the same twice."""
    return stored(in_cuts(df, by))


def carried(df: DataFrame, by: Sequence[str | Column], key: Sequence[str], fact: str, keep: Sequence[str]) -> DataFrame:
    """Of rows sorted by `by`, those with no `fact`, and `_last`, the last fact before them with the same key.

    `by` starts with `key`. Columns: *key, *keep, _last, _cut. The rows go through one exchange
    and are carried forward as they leave its sort; what is stored are the asking rows and, per
    key and cut, its last fact. Where a cut begins in the middle of a key, the last fact of the
    cuts before it is put in afterwards.
    """
    key, keep = list(key), list(keep)
    cut = in_cuts(df, by).select(*key, *keep, fact, CUT)
    schema = cut.withColumnRenamed(fact, "_last").withColumn("_end", F.lit(False)).schema
    filled = stored(cut.mapInArrow(_forward(key, keep, fact), schema))
    asking, ends = filled.where("not _end").drop("_end"), filled.where("_end")
    # a place in each cut that asks, and the ends of the cuts before it
    open_cuts = asking.where("_last is null").select(*key, CUT).distinct().withColumn("_last", F.lit(None).cast(filled.schema["_last"].dataType))
    marks = ends.select(*key, CUT, "_last").unionByName(open_cuts)
    both = marks.groupBy(*key, CUT).agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*key).orderBy(CUT).rowsBetween(Window.unboundedPreceding, -1)
    starts = both.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(CUT).alias("_kc"), F.last("_last", ignorenulls=True).over(before).alias("_start"))
    same = F.col(CUT) == F.col("_kc")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = asking.join(starts.where("_start is not null"), same, "left")
    return joined.select(*key, *keep, F.coalesce("_last", "_start").alias("_last"), CUT)


def _forward(key: list[str], keep: list[str], fact: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, *keep, "_last", CUT, "_end"]
        before: pa.RecordBatch | None = None  # the last row of the batches before
        held: pa.Array | None = None  # the last fact of its key

        def end_rows(of: pa.RecordBatch, facts: pa.Array) -> pa.RecordBatch:
            empty = [pa.nulls(len(of), of.column(c).type) for c in keep]
            return pa.RecordBatch.from_arrays(
                [*[of.column(c) for c in key], *empty, facts, of.column(CUT), pa.array([True] * len(of))], names
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            for c in key:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            change[0] = before is None or any(batch.column(c)[0] != before.column(c)[0] for c in key)
            facts = batch.column(fact)
            known = facts.is_valid().to_numpy(zero_copy_only=False)
            if change[0] and held is not None:
                yield end_rows(before, held)
                held = None
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(change, row, 0))  # where the row's key begins in this batch
            last = np.maximum.accumulate(np.where(known, row, -1))
            # place 0 is the fact held from before, which serves the key that goes on from there
            place = np.where(last >= start, last + 1, np.where((start == 0) & (not change[0]) & (held is not None), 0, -1))
            pool = pa.concat_arrays([held if held is not None else pa.nulls(1, facts.type), facts])
            filled = pool.take(pa.array(place, mask=place < 0))
            asks = pa.array(~known)
            columns = [*[batch.column(c) for c in (*key, *keep)], filled, batch.column(CUT), pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(asks)
            closed = np.flatnonzero(change[1:])  # last rows of the keys that end inside the batch
            closed = pa.array(closed[place[closed] >= 0])
            if len(closed):
                yield end_rows(batch.take(closed), filled.take(closed))
            before = batch.slice(n - 1, 1)
            held = filled.slice(n - 1, 1) if place[-1] >= 0 else None
        if before is not None and held is not None:
            yield end_rows(before, held)

    return run
