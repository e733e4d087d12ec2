"""Date parsing, parts and shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column, strict: bool = True) -> Column:
    """'yyyy-M-d' text, padded or not. Junk raises, or gives NULL with `strict=False`."""
    if strict:
        return F.to_date(text, "yyyy-M-d")
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def parse_timestamp(text: Column, strict: bool = True) -> Column:
    """General date or timestamp text in ISO form."""
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def date_parts(date: Column) -> list[Column]:
    return [F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day")]
