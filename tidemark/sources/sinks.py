"""Publishing of frames, charts and trade results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``symbol_bucket``, by which published tables are laid out, so a scan of few symbols reads few folders."""
    return df.withColumn("symbol_bucket", _bucket(F.col("symbol"), buckets))


def publish(frames: dict[str, DataFrame], folder: str, buckets: int = BUCKETS, mode: str = "overwrite") -> dict[str, str]:
    """Write every frame as Parquet under its name; returns the paths.

    Rows are gathered by bucket with a rebalance, which adaptive execution cuts by size: a hot bucket is written by several
    tasks, small ones share a task, and their number follows the size of the frame.
    """
    paths = {}
    for name, df in frames.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        if "symbol" in df.columns:
            dealt = with_bucket(df, buckets).hint("rebalance", "symbol_bucket")
            dealt.sortWithinPartitions("symbol_bucket", "symbol").write.mode(mode).partitionBy("symbol_bucket").parquet(paths[name])
        else:
            df.write.mode(mode).parquet(paths[name])
    return paths


def read_published(spark: SparkSession, path: str, symbols: Iterable | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A published frame; of some symbols only their bucket folders are read."""
    df = spark.read.parquet(path)
    if symbols is None:
        return df.drop("symbol_bucket")
    wanted = [F.lit(s).cast(df.schema["symbol"].dataType) for s in symbols]
    return df.where(F.col("symbol_bucket").isin(*[_bucket(s, buckets) for s in wanted]) & F.col("symbol").isin(*wanted)).drop("symbol_bucket")
