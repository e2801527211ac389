"""Bars, prices and fundamentals from files, JSON replies and raw ticks."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ohlc_bars(ticks: DataFrame, symbol: str | Column, ts: str | Column, price: str | Column, every: str = "day", tiebreak: tuple[str, ...] = (), volume: str | Column | None = None) -> DataFrame:
    """One bar per symbol and interval: first, highest, lowest and last price, and the volume (number of ticks without one).

    Ticks with equal times are ordered by ``tiebreak``.  One aggregation; partial bars are made before the shuffle.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    t = as_col(ts).cast("timestamp")
    order = F.struct(t.alias("t"), *tiebreak)
    rows = ticks.select(as_col(symbol).alias("symbol"), F.date_trunc(every, t).alias("ts"), as_col(price).cast("double").alias("price"), order.alias("at"), (as_col(volume) if volume is not None else F.lit(1)).cast("double").alias("size"))
    return rows.groupBy("symbol", "ts").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume"))


def in_days(df: DataFrame, first: str | None, last: str | None, ts: str = "ts") -> DataFrame:
    """Rows from midnight of ``first`` to midnight of ``last``, both YYYYMMDD and both included; a day that is none is an error."""
    for d, keep in ((first, F.col(ts).__ge__), (last, F.col(ts).__le__)):
        if d is not None:
            df = df.where(keep(F.lit(_midnight(d)).cast(df.schema[ts].dataType)))
    return df


def _midnight(day: str) -> str:
    try:
        if len(day) != 8 or not (day.isascii() and day.isdigit()):
            raise ValueError
        return f"{date(int(day[:4]), int(day[4:6]), int(day[6:])).isoformat()} 00:00:00"
    except ValueError:
        raise ValueError(f"not a day: {day}") from None


def of_symbols(df: DataFrame, symbols: Iterable | None, symbol: str = "symbol") -> DataFrame:
    return df if symbols is None else df.where(F.col(symbol).isin(list(symbols)))


@dataclass(frozen=True)
class Source:
    """Where a table is: format, path and reader options; ``schema`` is declared, not guessed, where it is given."""

    path: str
    format: str = "parquet"
    schema: StructType | str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)


class Sources:
    """Named sources of a job; a name used twice is an error, and so is one that is unknown."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._known = spark, {}

    def add(self, name: str, source: Source) -> Sources:
        if name in self._known:
            raise ValueError(f"source {name} is there already")
        self._known[name] = source
        return self

    def scan(self, name: str, symbols: Iterable | None = None, first: str | None = None, last: str | None = None, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
        """The table, restricted to symbols and days in a way that reaches the file reader."""
        if name not in self._known:
            raise KeyError(f"no source {name}")
        return in_days(of_symbols(self._known[name].read(self.spark), symbols, symbol), first, last, ts)

    def together(self, names: Iterable[str], **restrict) -> DataFrame:
        """Several sources as one frame with a ``source`` column; columns that one lacks are null."""
        out = None
        for name in names:
            part = self.scan(name, **restrict).withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("no sources named")
        return out


def records_from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The records of JSON arrays (or of single objects) in a text column, a row each."""
    text = F.trim(F.col(column))
    array = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return df.select(*[c for c in df.columns if c != column], F.inline(F.from_json(array, f"array<struct<{schema}>>")))


#: Types in the text of a variant's schema, at the places where a type stands; names that are no plain words are quoted there.
_TYPES = re.compile(r"`(?:[^`]|``)*`|(?:(?<=: )|(?<=^)|(?<=ARRAY<))(?:OBJECT<|VARIANT\b|VOID\b|DECIMAL\(\d+,\d+\))")


def _ddl(variant_schema: str) -> str:
    def plain(m: re.Match) -> str:
        found = m[0]
        return found if found[0] == "`" else "STRUCT<" if found == "OBJECT<" else "DOUBLE" if found[0] == "D" else "STRING"

    return _TYPES.sub(plain, variant_schema)


def _records(df: DataFrame, column: str) -> DataFrame:
    """``df`` and ``_record``, a row for each object in the column, as variants."""
    v = F.try_parse_json(F.col(column).cast("string"))
    many = F.expr("CASE WHEN schema_of_variant(_v) LIKE 'ARRAY<%' THEN try_variant_get(_v, '$', 'array<variant>') ELSE array(_v) END")
    rows = df.withColumn("_v", v).withColumn("_record", F.explode(many)).drop("_v")
    return rows.where(F.schema_of_variant("_record").startswith("OBJECT<"))


def inferred_schema(df: DataFrame, column: str) -> str | None:
    """The schema of all JSON records in a text column, as DDL; None where there are none.

    One aggregation merges the types of all records, none is sampled.  Whole and other numbers make doubles; types that clash
    otherwise, and fields that are always null, are texts.
    """
    found = _records(df, column).agg(F.schema_of_variant_agg("_record")).first()[0]
    return _ddl(found) if found.startswith("OBJECT<") and found != "OBJECT<>" else None


def records_without_schema(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """The records of JSON arrays, or of single objects, in a text column, a row each, with the fields and types that they have.

    Texts that are no JSON, nulls, and values that are no objects give no row; a field that a record lacks is null; nested
    records are structs and lists arrays.  A field named as another column of ``df`` comes as ``<column>_<field>``.  ``schema``
    is what ``inferred_schema`` gave before, for a stream or for the same replies again.
    """
    schema = schema or inferred_schema(df, column)
    keep = [c for c in df.columns if c != column]
    if schema is None:
        return df.limit(0).select(*keep)
    read = F.try_variant_get("_record", "$", schema).alias("_fields")
    rows = _records(df, column).select(*keep, read)
    names = rows.schema["_fields"].dataType.names
    return rows.select(*keep, *[F.col("_fields").getField(n).alias(f"{column}_{n}" if n in keep else n) for n in names])
