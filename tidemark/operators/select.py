"""Column choice and row filters of frames."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import contains_text, shorten


def pull(df: DataFrame, *fields: str) -> DataFrame:
    """Key columns and the named fields; a field that is not there is an error."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.select("symbol", "ts", *[f for f in fields if f not in ("symbol", "ts")])


def as_series(df: DataFrame, column: str, alias: str) -> DataFrame:
    """``(symbol, ts, alias)``: one column as doubles under a new name."""
    return df.select("symbol", "ts", F.col(column).cast("double").alias(alias))


def with_any(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which one of the columns is not null."""
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())


def closed(trades: DataFrame) -> DataFrame:
    return with_any(trades, "exit_ts", "limit_ts")


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the columns (all, if none is named); NaN is a value and stays."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns or df.columns], F.lit(True)))


def matching(df: DataFrame, column: str, needle: str) -> DataFrame:
    return df.where(contains_text(F.col(column), needle))


def shortened(df: DataFrame, *columns: str, width: int = 48) -> DataFrame:
    return df.withColumns({c: shorten(F.col(c), width) for c in columns})
