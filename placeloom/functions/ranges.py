"""Byte ranges of HTTP: parsing, clamping, what cannot be served."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: one range, ``a-b``, ``a-`` or the last ``-n`` bytes.
RANGE = r"^\s*bytes\s*=\s*(?:([0-9]+)-([0-9]*)|-([0-9]+))\s*$"


def parse_range(header: Column) -> Column:
    """(first, last, suffix), one of the first two or the third null; null for a header that asks for the whole: none, malformed, of several ranges."""
    part = lambda i: F.nullif(F.regexp_extract(header, RANGE, i), F.lit("")).try_cast("decimal(38,0)")
    first, last, suffix = part(1), part(2), part(3)
    usable = F.when(suffix.isNotNull(), suffix > 0).otherwise(first.isNotNull() & (last.isNull() | (last >= first)))
    return F.when(F.coalesce(header.rlike(RANGE), F.lit(False)) & usable, F.struct(first.alias("first"), last.alias("last"), suffix.alias("suffix")))


def served(asked: Column, size: Column) -> Column:
    """(status, first, last) of an object of ``size`` bytes: 200 whole, 206 a part, 416 with no bytes if there are none to serve."""
    end = size - 1
    bytes_of = lambda status, a, b: F.struct(F.lit(status).alias("status"), a.cast("long").alias("first"), b.cast("long").alias("last"))
    none = F.lit(None).cast("long")
    return (
        F.when(asked.isNull(), bytes_of(200, F.lit(0), end))
        .when((size <= 0) | (asked["first"] >= size), bytes_of(416, none, none))
        .when(asked["first"].isNull(), bytes_of(206, size - F.least(asked["suffix"], size), end))
        .otherwise(bytes_of(206, asked["first"], F.least(F.coalesce(asked["last"], end), end)))
    )
