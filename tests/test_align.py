import math
import random
from datetime import timedelta

import pandas as pd
import pytest
from series_help import START, values

from tidemark.operators import align, long_series, select


def timed(spark, rows, column="v"):
    return spark.createDataFrame([(s, START + timedelta(minutes=m), v) for s, m, v in rows], f"symbol string, ts timestamp, {column} double")


@pytest.mark.parametrize("minutes", [None, 7])
def test_asof_equals_merge_asof(spark, minutes):
    r = random.Random(5)
    left = [(s, m, float(m)) for s in "ab" for m in sorted(r.sample(range(300), 60))]
    right = [(s, m, r.choice([None, 1.0 * m])) for s in "ab" for m in sorted(r.sample(range(300), 25))]
    tolerance = None if minutes is None else timedelta(minutes=minutes)
    got = align.asof_backward(timed(spark, left, "x"), timed(spark, right), ["v"], tolerance).toPandas().sort_values(["ts", "symbol"])
    a = pd.DataFrame([(s, START + timedelta(minutes=m), v) for s, m, v in left], columns=["symbol", "ts", "x"]).sort_values(["ts", "symbol"])
    b = pd.DataFrame([(s, START + timedelta(minutes=m), v) for s, m, v in right if v is not None], columns=["symbol", "ts", "v"]).sort_values("ts")
    wanted = pd.merge_asof(a, b, on="ts", by="symbol", tolerance=tolerance)
    assert got.v.fillna(-1).tolist() == wanted.v.fillna(-1).tolist() and got.x.tolist() == wanted.x.tolist()


def test_asof_without_other_rows(spark):
    got = align.asof_backward(timed(spark, [("a", 1, 1.0)], "x"), timed(spark, []), ["v"]).collect()
    assert [(r.x, r.v) for r in got] == [(1.0, None)]


def test_exact_and_position(spark, frame):
    a, b = frame({"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0]}), frame({"a": [7.0, 8.0, 9.0], "b": [5.0]})
    assert values(align.align_exact([(a, "x", "E0"), (b, "x", "X0"), (a, "x", "E1")]), "X0") == [7.0, 8.0, 9.0]
    got = align.align_position([(a, "x", "E0"), (b, "x", "X0")])
    assert {r.symbol for r in got.collect()} == {"a"} and values(got, "X0") == [7.0, 8.0, 9.0]


def test_finest_timeline_is_master(spark):
    days, hours = timed(spark, [("a", 1440 * i, float(i)) for i in range(4)]), timed(spark, [("a", 60 * i, float(i)) for i in range(30)])
    assert [r.step for r in align.median_steps(hours).collect()] == [3_600_000]
    assert align.choose_master([days, hours]) == 1
    got = align.align_asof([(days, "v", "E0"), (hours, "v", "X0")], timedelta(hours=2))
    assert got.count() == 30 and got.where("E0 IS NOT NULL").count() == 3 + 3
    assert align.choose_master([timed(spark, []), timed(spark, [])]) == 0
    with pytest.raises(ValueError):
        align.align_asof([(timed(spark, []), "v", "E0"), (timed(spark, []), "v", "X0")], timedelta(1))


NAN = float("nan")


def test_nan_is_a_value(spark, frame):
    df = frame({"a": [1.0, None, NAN, 4.0]})
    assert [r.ts.day for r in select.without_nulls(df).orderBy("ts").collect()] == [1, 3, 4]
    left = timed(spark, [("a", m, 0.0) for m in (1, 3, 5)], "x")
    right = timed(spark, [("a", 0, 1.0), ("a", 2, NAN), ("a", 4, None)])
    got = [r.v for r in align.asof_backward(left, right, ["v"]).orderBy("ts").collect()]
    assert got[0] == 1.0 and math.isnan(got[1]) and math.isnan(got[2])
    both = align.align_asof([(left, "x", "E0"), (right, "v", "X0")], timedelta(minutes=3)).orderBy("ts").collect()
    assert [r.X0 for r in both][0] == 1.0 and all(math.isnan(r.X0) for r in both[1:])


@pytest.mark.parametrize("minutes", [None, 7])
@pytest.mark.parametrize("size", [3, 1000])
def test_asof_of_long_series_is_the_same(spark, minutes, size):
    r = random.Random(6)
    left = timed(spark, [(s, m, float(m)) for s in "ab" for m in sorted(r.sample(range(300), 60))], "x")
    right = timed(spark, [(s, m, r.choice([None, 1.0 * m])) for s in "ab" for m in sorted(r.sample(range(300), 25))])
    tolerance = None if minutes is None else timedelta(minutes=minutes)
    a, b = (sorted((x.symbol, x.ts, x.x, x.v) for x in f.collect()) for f in (align.asof_backward(left, right, ["v"], tolerance), long_series.asof_backward(left, right, ["v"], tolerance, size)))
    assert str(a) == str(b) and len(a) == 120


def test_missing_field_is_an_error(frame):
    with pytest.raises(ValueError, match="no such"):
        select.pull(frame({"a": [1.0]}), "close")
