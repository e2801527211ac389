"""Cleaning of series: fills, repairs, coercions.  A frame is keyed (symbol, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions.scalar import finite


def series() -> WindowSpec:
    """All rows of a symbol in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def past() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def future() -> WindowSpec:
    return series().rowsBetween(0, Window.unboundedFollowing)


def repaired(x: Column) -> Column:
    """Null and non-finite values become the last finite one before, else the next one after, else 0."""
    f = finite(x)
    return F.coalesce(F.last(f, ignorenulls=True).over(past()), F.first(f, ignorenulls=True).over(future()), F.lit(0.0))


def filled(x: Column) -> Column:
    """Nulls are filled forward, then backward; what is not finite after that becomes 0."""
    x = x.cast("double")
    carried = F.coalesce(F.last(x, ignorenulls=True).over(past()), F.first(x, ignorenulls=True).over(future()))
    return F.coalesce(finite(carried), F.lit(0.0))


def _checked(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def clean_series(df: DataFrame, columns: list[str], how: str = "repair") -> DataFrame:
    """``columns`` cleaned in place; ``how`` is "repair" or "fill"."""
    _checked(df, columns)
    rule = {"repair": repaired, "fill": filled}[how]
    return df.withColumns({c: rule(F.col(c)) for c in columns})


def to_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; missing columns are an error."""
    _checked(df, columns)
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def strict_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; columns of a type other than a number are an error, nulls stay null."""
    _checked(df, columns)
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, NumericType)]
    if wrong:
        raise TypeError(f"not numeric: {', '.join(wrong)}")
    return to_double(df, columns)
