"""Three clocks that are never one column: instants in UTC, wall-clock minutes of a place, calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an instant, a wall-clock time and a day look like; an instant must say its offset.
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d$"
DAY = r"^\d{4}-\d{2}-\d{2}$"


def instant(text: Column) -> Column:
    """Struct (at, refused): the instant, or why there is none; a time without an offset is refused, never taken as UTC."""
    at = F.when(text.rlike(INSTANT), F.try_to_timestamp(text))
    refused = F.when(text.isNull(), "missing").when(text.rlike(DAY), "a day, no instant").when(~text.rlike(INSTANT), "no offset").when(at.isNull(), "no such time")
    return F.struct(at.alias("at"), refused.alias("refused"))


def clock_minute(text: Column) -> Column:
    """Minutes since midnight of ``hh:mm``; null for anything else, times with an offset too."""
    return F.when(text.rlike(CLOCK), F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int"))


def calendar_day(text: Column) -> Column:
    """The date of ``yyyy-mm-dd``; null for anything else: the day of an instant depends on where one is."""
    return F.when(text.rlike(DAY), text.try_cast("date"))


def require_clocks(df: DataFrame, instants=(), minutes=(), days=()) -> DataFrame:
    """The table, or an error if a column has the type of another clock."""
    wanted = {c: T.TimestampType for c in instants} | {c: T.IntegralType for c in minutes} | {c: T.DateType for c in days}
    for column, kind in wanted.items():
        if not isinstance(df.schema[column].dataType, kind):
            raise TypeError(f"{column} is {df.schema[column].dataType.simpleString()}, not {kind.__name__}")
    return df
