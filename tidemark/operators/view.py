"""Looking at frames: counts, sorting, filters and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.select import matching, shortened

PAGE_SIZES = (25, 50, 100, 250, 500)


def sizes(frames: dict[str, DataFrame]) -> DataFrame:
    """``(name, n_rows, n_columns)`` of several frames, one row each."""
    out = None
    for name, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out


def in_time_order(df: DataFrame) -> DataFrame:
    return df.orderBy("symbol", "ts")


def sort_by(df: DataFrame, column: str, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Nulls come last either way; ``ties`` settle the order of equal values."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """Rows of one page of a sorted frame; pages count from 0."""
    if size not in PAGE_SIZES:
        raise ValueError(f"page sizes are {PAGE_SIZES}")
    return df.offset(number * size).limit(size)


def page_after(df: DataFrame, key: str, last, size: int = 50) -> DataFrame:
    """The page after a known key: no row before it is sorted or skipped, however deep it is."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(size)


class Pages:
    """A sorted frame on disk, in ranges whose numbers of rows are known: a page by its number reads the ranges it lies in, no others.

    ``order`` are the sort columns, as ``orderBy`` takes them; they should settle all ties, or rows of equal keys may change
    places between calls.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, order: list, size: int = 50) -> None:
        if size not in PAGE_SIZES:
            raise ValueError(f"page sizes are {PAGE_SIZES}")
        self.order, self.size, self._columns = order, size, schema.names
        self._rows = spark.read.schema(StructType([*schema.fields, StructField("_range", IntegerType())])).parquet(path)
        ends = 0
        self._ranges: list[tuple[int, int, int]] = []  # range, rows before it, rows up to its end; a few bytes for each range
        for r in self._rows.groupBy("_range").count().orderBy("_range").collect():  # from the files' footers
            self._ranges.append((r["_range"], ends, ends + r["count"]))
            ends += r["count"]
        self.n_rows = ends

    @classmethod
    def write(cls, df: DataFrame, path: str, order: list, size: int = 50, ranges: int | None = None) -> Pages:
        """Sorts ``df`` once into ``ranges`` ranges (as many as shuffle partitions) under ``path``."""
        ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
        dealt.sortWithinPartitions("_range", *order).write.mode("overwrite").partitionBy("_range").parquet(path)
        return cls(df.sparkSession, path, df.schema, order, size)

    def page(self, number: int) -> DataFrame:
        """The rows of a page, which counts from 0, in order; none after the last page."""
        first = number * self.size
        if number < 0:
            raise ValueError("pages count from 0")
        met = [(r, start) for r, start, end in self._ranges if start < first + self.size and end > first]
        rows = self._rows.where(F.col("_range").isin([r for r, _ in met])).orderBy("_range", *self.order)
        return rows.offset(first - met[0][1] if met else 0).limit(self.size).select(*self._columns)


def preview(df: DataFrame, rows: int = 40) -> DataFrame:
    return df.limit(rows)


def table_view(df: DataFrame, needle: str | None = None, needle_column: str | None = None, sort: str | None = None, descending: bool = False, number: int = 0, size: int = 50, ties: tuple[str, ...] = (), text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Filter, then sort, then page: one plan that keeps the page's rows only."""
    if needle:
        df = matching(df, needle_column or df.columns[0], needle)
    if sort:
        df = sort_by(df, sort, descending, ties)
    df = page(df, number, size)
    return shortened(df, *text_columns) if text_columns else df
