"""Scalar helpers as column expressions."""

from __future__ import annotations

from numbers import Number

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: str | Number | Column) -> Column:
    """An operand: a number, a text that reads as a number, a column name, or a column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, Number):
        return F.lit(float(x))
    return F.lit(float(x)) if is_number(x) else F.col(x)


def is_number(x: str | Number) -> bool:
    try:
        float(x)
    except (TypeError, ValueError):
        return False
    return True


def parse_day(day: Column) -> Column:
    """Midnight of a YYYYMMDD text; null where that is no day of the calendar."""
    return F.when(day.rlike("^[0-9]{8}$"), F.try_to_timestamp(day, F.lit("yyyyMMdd")))


def normalise_time(value: Column, kind: str) -> Column:
    """A timestamp from any of the forms in which time columns arrive."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return value.cast("timestamp")
    if kind == "bigint":
        return F.timestamp_millis(value)
    if kind in ("int", "smallint"):
        return F.timestamp_seconds(value)
    raise TypeError(f"a {kind} column is no time")


def finite(x: Column) -> Column:
    """The value where it is a finite number, else null."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def contains_text(value: Column, needle: str) -> Column:
    """Whether the text form of a value of any type holds the needle, letters compared without case."""
    return F.coalesce(F.lower(value.cast("string")).contains(needle.lower()), F.lit(False))


def shorten(value: Column, width: int = 48) -> Column:
    """The text form, cut at ``width`` characters with an ellipsis after the cut."""
    text = value.cast("string")
    return F.when(F.char_length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def near(columns: list[Column], within: float) -> Column:
    """Whether each neighbouring pair of columns differs by ``within`` at most; null values and single columns never do."""
    out = F.lit(len(columns) > 1)
    for a, b in zip(columns, columns[1:]):
        out = out & F.coalesce(F.abs(a - b) <= within, F.lit(False))
    return out
