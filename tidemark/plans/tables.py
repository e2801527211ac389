"""Frames that the registered queries work on, made from the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bars import ohlc_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices per supplier."""
    lines = table(spark, sf_dir, "lineitem")
    return ohlc_bars(lines, "l_suppkey", "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), "day", ("l_orderkey", "l_linenumber"), "l_quantity")


def event_bars(spark: SparkSession, sf_dir: str, every: str = "day") -> DataFrame:
    return ohlc_bars(table(spark, sf_dir, "events"), "event_type", "ts", "value", every, ("event_id",))


def gapped_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier bars whose close is missing, not a number or infinite on some rows, by the day of the month."""
    day = F.dayofmonth("ts")
    bad = F.when(day % 7 == 0, F.lit(None).cast("double")).when(day % 11 == 0, F.lit(float("nan"))).when(day % 13 == 0, F.lit(float("inf"))).otherwise(F.col("close"))
    return supplier_bars(spark, sf_dir).withColumn("close", bad)


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly figures per supplier: earnings per unit and units sold, dated to the last order of the month."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sold = lines.select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    by = sold.groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("month", "o_orderdate").alias("month"))
    cents = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))  # exact, so the order of the rows does not matter
    figures = by.agg(F.date_trunc("day", F.max("o_orderdate")).alias("filed_ts"), (cents.cast("double") / F.sum("l_quantity")).alias("eps"), F.sum("l_quantity").alias("outstanding_shares"))
    return figures.select("symbol", "filed_ts", "eps", "outstanding_shares")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, period, known, eps)``: monthly earnings per unit as first filed, and as restated 45 days later without returned units."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sold = lines.select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    kept = F.col("l_returnflag") != "R"

    def per_unit(where: Column) -> Column:
        return F.sum(F.when(where, F.col("l_extendedprice").cast("decimal(18,2)"))).cast("double") / F.sum(F.when(where, F.col("l_quantity")))

    by = sold.groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("month", "o_orderdate").alias("period"))
    months = by.agg(F.date_trunc("day", F.max("o_orderdate")).alias("known"), per_unit(F.lit(True)).alias("eps"), per_unit(kept).alias("restated"))
    later = F.col("known") + F.expr("INTERVAL 45 DAYS")
    return months.select("symbol", "period", F.inline(F.array(F.struct("known", "eps"), F.struct(later.alias("known"), F.col("restated").alias("eps")))))


BARS = """bars AS (
  SELECT l_suppkey AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS price, row(l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem)
  GROUP BY 1, 2)"""

EVENT_BARS = """ebars AS (
  SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(value, k) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, k) AS close, count(*)::DOUBLE AS volume
  FROM (SELECT event_type, event_id, value, ts, row(ts, event_id) AS k FROM events)
  GROUP BY 1, 2)"""

GAPPED = """gapped AS (
  SELECT symbol, ts, open, high, low, volume,
         CASE WHEN day(ts) % 7 = 0 THEN NULL WHEN day(ts) % 11 = 0 THEN 'NaN'::DOUBLE WHEN day(ts) % 13 = 0 THEN 'Infinity'::DOUBLE ELSE close END AS close
  FROM bars)"""

FUNDAMENTALS = """fundamentals AS (
  SELECT l_suppkey AS symbol, date_trunc('day', max(o_orderdate))::TIMESTAMP AS filed_ts, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity) AS eps, sum(l_quantity) AS outstanding_shares
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey, date_trunc('month', o_orderdate))"""

FILINGS = """months AS (
  SELECT l_suppkey AS symbol, date_trunc('month', o_orderdate)::TIMESTAMP AS period, date_trunc('day', max(o_orderdate))::TIMESTAMP AS known,
         sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity) AS eps,
         (sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag <> 'R'))::DOUBLE / sum(l_quantity) FILTER (l_returnflag <> 'R') AS restated
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), filings AS (
  SELECT symbol, period, known, eps FROM months UNION ALL SELECT symbol, period, known + INTERVAL 45 DAY, restated FROM months)"""

INDEXED = """ix AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""
