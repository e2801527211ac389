"""Published frames come back whole, and reads of few symbols open few folders."""

import re

import duckdb
from test_registry import DATA, TABLES, same

from tidemark.sources import sinks


def test_published_bars_come_back_whole(spark):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    wanted = con.execute(entry.oracle_sql()["K5_published_bars"]).df()
    assert wanted.symbol.nunique() == con.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem").fetchone()[0]
    assert same(entry.queries()["K5_published_bars"](spark, DATA).toPandas(), wanted)


def test_few_symbols_read_few_folders(spark, frame, tmp_path):
    df = frame({f"s{i:03d}": [1.0 * i, 2.0] for i in range(300)})
    path = sinks.publish({"all": df}, f"file://{tmp_path}")["all"]
    assert sorted(sinks.read_published(spark, path).select("symbol", "ts", "x").collect()) == sorted(df.collect())
    few = sinks.read_published(spark, path, ["s003", "s250"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 4 and "PartitionFilters: [symbol_bucket" in plan
    assert re.search(r"PartitionFilters: \[symbol_bucket#\d+ IN \(\d+,\d+\)", plan)


def test_a_hot_symbol_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(200_000).selectExpr("'hot' AS symbol", "timestamp_seconds(id) AS ts", "rand(1) AS x")
    known = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500k")
    try:
        path = sinks.publish({"all": df}, f"file://{tmp_path}")["all"]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", known)
    back = sinks.read_published(spark, path)
    assert back.count() == 200_000 and len(back.inputFiles()) > 2
