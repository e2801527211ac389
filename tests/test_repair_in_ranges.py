"""Repairs of few and very long series: rows are walked once, whatever lies ahead of them."""

import random

import pytest
from pyspark.sql import functions as F
from series_help import values

from tidemark.functions import clean
from tidemark.operators import long_series


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ranges_repair_as_whole_series(spark, frame, small_batches, parts):
    r = random.Random(parts)
    bad = [None, float("nan"), float("inf"), -float("inf")]
    series = {
        "a": [r.choice([*bad, 1.0, -0.5, 7.0]) for _ in range(200)], "late": [None] * 120 + [3.0, None, 5.0] + bad * 20, "early": [2.0] + [None] * 150, "none": bad * 25, "one": [4.0], "full": [float(i) for i in range(60)],
    }
    df = frame(series)
    df = df.unionByName(df.where("symbol = 'a'").withColumn("symbol", F.lit(None).cast("string")))
    key = lambda rows: sorted((str(v.symbol), v.ts, v.r) for v in rows.collect())
    got = long_series.repaired(df, "x", "r", ["symbol", "ts", "x"], parts)
    assert got.columns == ["symbol", "ts", "x", "r"]
    assert key(got) == key(df.withColumn("r", clean.repaired(F.col("x"))))


def test_buckets_look_ahead_at_no_row(spark, frame):
    """A window from each row to the end of its bucket costs the square of the bucket."""
    df = long_series.with_index(frame({"a": [None] * 20 + [float(i) if i % 3 else None for i in range(60)]}))
    out = long_series.bucketed_repair(df, "x", "r", 8)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and ", 1, unboundedfollowing$()" not in plan
    assert values(out, "r") == values(df.withColumn("r", clean.repaired(F.col("x"))), "r")


def test_more_rows_take_more_ranges(spark):
    rows, least = spark.range(1000), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert long_series.ranges(rows) == least and long_series.ranges(rows, 100) == 10
