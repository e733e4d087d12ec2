"""Membership tests inside the row, for sets that a join would have to meet.

A Bloom filter of a column's values becomes a constant of the plan. Rows that surely lack a
value are dropped where they are read, before anything costly is done to them or any exchange;
whoever needs certainty joins what is left.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # at most: 1 MB; a fuller filter only lets more through
HASHES = 3


def _bits(value: Column, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(size)) for k in range(HASHES)]


def likely_in(df: DataFrame, column: str, most: int | None = None) -> Callable[[Column], Column]:
    """A test that every value of the column passes, and few others: true or false, NULL is never in.

    Types must agree, as the hash of a value depends on its type. Two passes over the column;
    no more than `most` bits reach the driver, however many values there are.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null")
    size = min(most or BITS, max(64, 1 << (16 * values.count() - 1).bit_length()))
    places = values.select(F.explode(F.array(*_bits(F.col("v"), size))).alias("bit"))
    cells = places.groupBy(F.shiftright("bit", 6).cast("int").alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits")
    )
    held = [0] * (size // 64)
    for r in cells.collect():
        held[r["cell"]] = r["bits"]
    table = F.from_json(F.lit(json.dumps(held)), "array<bigint>")  # folded when the plan is made

    def test(value: Column) -> Column:
        passed = value.isNotNull()
        for bit in _bits(value, size):
            passed = passed & (F.getbit(F.get(table, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1)
        return passed

    return test
