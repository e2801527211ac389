import random

import pytest
from series_help import alike, values
from pyspark.sql import functions as F

from tidemark.functions import clean, scalar
from tidemark.operators import calc, charts, long_series, view
from tidemark.sources import sinks
from tidemark.sources.bars import Source, Sources, in_days, ohlc_bars, records_from_json


def test_buckets_equal_whole_series(frame):
    r = random.Random(2)
    x = [r.choice([None, float("nan"), 1.0, 2.5, 7.0]) for _ in range(70)]
    y = [round(100 * r.random(), 3) for _ in range(70)]
    df = long_series.with_index(frame({"a": list(zip(x, y)), "b": list(zip(x[:3], y[:3]))}, ("x", "y")))
    assert values(df, "idx") == list(range(70))
    plain = df.withColumns({"m": calc.moving_average("y", 5), "v": calc.volatility("y", 5), "r": clean.repaired(F.col("x"))})
    assert alike(values(long_series.bucketed_average(df, "y", "m", 5, 8), "m"), values(plain, "m"))
    assert alike(values(long_series.bucketed_volatility(df, "y", "v", 5, 8), "v"), values(plain, "v"))
    assert alike(values(long_series.bucketed_repair(df, "x", "r", 8), "r"), values(plain, "r"))
    with pytest.raises(ValueError):
        long_series.with_halo(df, 3, 4)


def test_bars_break_ties(spark):
    ticks = spark.createDataFrame([("a", "2024-01-01 01:00", 5.0, 2), ("a", "2024-01-01 01:00", 4.0, 1), ("a", "2024-01-01 03:00", 6.0, 3), ("a", "2024-01-02 00:00", 1.0, 4)], "s string, t string, p double, k int")
    got = ohlc_bars(ticks, "s", "t", "p", tiebreak=("k",)).orderBy("ts").collect()
    assert [(b.open, b.high, b.low, b.close, b.volume) for b in got] == [(4.0, 6.0, 4.0, 6.0, 3.0), (1.0, 1.0, 1.0, 1.0, 1.0)]


def test_sources(spark, frame, tmp_path):
    frame({"a": [1.0, 2.0, 3.0], "b": [4.0]}).write.parquet(str(tmp_path / "p"))
    known = Sources(spark).add("p", Source(str(tmp_path / "p")))
    assert known.scan("p", ["a"], "20240102", "20240103").count() == 2
    assert known.together(["p", "p"], symbols=["b"]).columns[-1] == "source"
    plan = known.scan("p", ["a"], "20240102")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(symbol), IsNotNull(ts), EqualTo(symbol,a)" in plan
    for wrong in (lambda: known.add("p", Source("x")), lambda: in_days(frame({"a": [1.0]}), "20240231", None)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        known.scan("q")
    records = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]'), (2, '{"a": 3}'), (3, None), (4, "[]")], "k int, j string")
    assert [(r.k, r.a) for r in records_from_json(records, "j", "a int").orderBy("k", "a").collect()] == [(1, 1), (1, 2), (2, 3)]
    paths = sinks.publish({"p": frame({"a": [1.0]})}, str(tmp_path / "out"))
    assert spark.read.parquet(paths["p"]).count() == 1


def test_scalars(spark):
    days = spark.createDataFrame([("20240229",), ("20240231",), ("2024-1-1",), (None,)], "d string")
    assert [str(r[0])[:10] for r in days.select(scalar.parse_day(F.col("d"))).collect()] == ["2024-02-29", "None", "None", "None"]
    assert spark.range(1).select(scalar.shorten(F.lit("x" * 50))).first()[0] == "x" * 48 + "…"
    assert spark.range(1).select(scalar.contains_text(F.lit(None).cast("string"), "a")).first()[0] is False
    with pytest.raises(TypeError):
        scalar.normalise_time(F.lit("x"), "string")


def test_charts_and_views(frame):
    df = frame({"a": [(1.0, 4.0, 0.5, 3.0), (None, 5.0, 1.0, 2.0)]}, ("open", "high", "low", "close"))
    chart = charts.stack(charts.line(df, "open", "open", "close"), charts.candle(df), charts.bar(df, "high"))
    assert chart.groupBy("kind").count().orderBy("kind").collect() == [("bar", 2), ("candle", 2), ("line", 4)]
    b = charts.bounds(chart).first()
    assert (b.y_min, b.y_max) == (0.5 - 25, 30.0)
    assert [r.label for r in charts.axis_labels(df.withColumn("ts", F.lit(1))).collect()] == [0, 1]
    assert values(charts.candle_bodies(df), "up") == [True, None]
    rows = view.sort_by(df, "open", descending=True).collect()
    assert rows[-1].open is None
    assert view.table_view(df, "4", "high", "high", size=25).count() == 1
    assert view.sizes({"x": df}).first() == ("x", 2, 6)
    with pytest.raises(ValueError):
        view.page(df, 0, 7)
