"""Calculation sets, figures as known, charts by pixels, pages by number and searches by an index of letters."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from series_help import START, alike, values

from tidemark.operators import align, calc, charts, select, view
from tidemark.operators.calc import Calc
from tidemark.operators.calc_sets import CalcSets, Use, run_sets, without_repeats
from tidemark.plans.registry import spread_sets
from tidemark.sources import text_index


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sets_share_what_is_the_same(frame):
    df = frame({"a": [float(i * i % 17) for i in range(40)]})
    calcs = spread_sets().expand(Use("fan", "f", {"x": "x"}), Use("spread", "s", {"x": "x", "fast": 5, "slow": "20"}))
    once, at = without_repeats(calcs)
    assert (len(calcs), len(once)) == (13, 7)  # three averages, three distances, one sum
    assert at["s_distance"] == at["f_middle_distance"] == "f_middle_distance"
    out = run_sets(df, spread_sets(), Use("fan", "f", {"x": "x"}), Use("spread", "s", {"x": "x", "fast": 5, "slow": 20}))
    assert out.columns[:3] == ["symbol", "ts", "x"] and set(out.columns[3:]) == {o for c in calcs for o in c.outputs}
    plain = calc.run_calcs(df, calcs)
    for name in ("f_path", "s_distance", "f_far_slow"):
        assert alike(values(out, name), values(plain, name))
    assert shuffles(out) == 1


def test_sets_that_are_wrong(frame):
    df, average = frame({"a": [1.0, 2.0]}), Calc("SMA", ("$x", 2), "m")
    sets = CalcSets().add("one", ("x",), average).add("loop", (), Use("back", "b")).add("back", (), Use("loop", "l")).add("odd", (), Calc("SMA", ("$y", 2), "m"))
    sets.add("ring", (), Calc("SUM", ("q", "x"), "p"), Calc("SUM", ("p", "x"), "q"))
    for use, kind, what in (
        (Use("loop", "o"), ValueError, "loop > back > loop"), (Use("none", "o"), KeyError, "no set"), (Use("one", "o"), ValueError, "takes x"),
        (Use("odd", "o"), ValueError, "no parameter y"), (Use("ring", "o"), ValueError, "in a circle"), (Use("one", "o", {"x": "nowhere"}), ValueError, "no such columns"),
    ):
        with pytest.raises(kind, match=what):
            run_sets(df, sets, use)
    with pytest.raises(ValueError, match="there already"):
        sets.add("one", ())
    with pytest.raises(ValueError, match="named twice"):
        run_sets(df, sets, Use("one", "o", {"x": "x"}), Use("one", "o", {"x": "x"}))
    with pytest.raises(ValueError, match="are there already"):
        run_sets(df.withColumn("o_m", F.lit(1.0)), sets, Use("one", "o", {"x": "x"}))


def test_figures_as_known_equal_brute_force(spark):
    r, day = random.Random(4), lambda n: START + timedelta(days=n)
    versions = [(r.choice(["a", "b", None]), r.choice([day(30 * r.randrange(6)), None]), r.choice([day(r.randrange(200)), None]), r.choice([None, float(r.randrange(9))])) for _ in range(120)]
    versions += [("a", day(0), day(10), 1.0), ("a", day(0), day(10), 2.0)] * 2
    rows = [(r.choice(["a", "b", "c", None]), day(r.randrange(-5, 210)), k) for k in range(80)] + [("a", None, 99)]
    v = spark.createDataFrame(versions, "symbol string, month timestamp, filed timestamp, eps double")
    m = spark.createDataFrame(rows, "symbol string, ts timestamp, _row int").withColumn("_at", F.lit("mine"))

    def expected(symbol, at):
        low = lambda x: (x is not None, x if x is not None else 0.0)
        seen = [(p, k, low(e), e) for s, p, k, e in versions if s == symbol and p and k and at and k <= at]
        return max(seen)[:2] + (max(seen)[3],) if seen else (None, None, None)

    wanted = sorted((k, *expected(s, at)) for s, at, k in rows)
    for slice in (None, timedelta(days=17)):
        got = align.asof_known(m, v, ["month", "filed", "eps"], "month", "filed", slice)
        assert got.columns == ["symbol", "ts", "_row", "_at", "month", "filed", "eps"]
        assert sorted((x["_row"], x["month"], x["filed"], x["eps"]) for x in got.collect()) == wanted, slice
    none = align.asof_known(m, v.limit(0), ["eps"], "month", "filed", timedelta(days=17)).collect()
    assert len(none) == len(rows) and all(x["eps"] is None for x in none)
    last = {(x["symbol"], x["month"]): (x["filed"], x["eps"]) for x in align.as_known(v, day(100), ["eps"], "month", "filed").collect()}
    keys = {(s, p) for s, p, k, _ in versions if p and k and k <= day(100)}
    assert set(last) == keys
    assert last["a", day(0)][0] == max(k for s, p, k, _ in versions if s == "a" and p == day(0) and k and k <= day(100))


def test_slices_are_not_windows_over_a_symbol(spark, frame):
    v = frame({"a": [1.0, 2.0]}).select("symbol", F.col("ts").alias("period"), F.col("ts").alias("known"), "x")
    plan = align.asof_known(frame({"a": [1.0] * 9}), v, ["x"], slice=timedelta(days=2))._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window [" in line and "_seen" in line]
    assert rows and all("_slice" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in rows)


def test_pixels_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(s, START + timedelta(seconds=r.randrange(900)), r.choice([None, float("nan"), *map(float, range(12))])) for s in ("a", "b", None) for _ in range(400)] + [("one", START, 3.0), ("a", None, 99.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, y double")
    for width in (1, 7, 2000):
        wanted = set()
        for s in ("a", "b", None, "one"):
            of = [(t, y) for n, t, y in rows if n == s and t and y is not None and y == y]
            a, b = min(t for t, _ in of), max(t for t, _ in of)
            step = (b - a) // timedelta(microseconds=1) // width + 1
            pixel = lambda t: (t - a) // timedelta(microseconds=1) // step  # noqa: E731, B023
            for p in {pixel(t) for t, _ in of}:
                here = [x for x in of if pixel(x[0]) == p]
                wanted |= {(s, *x) for x in (min(here), max(here), min(here, key=lambda x: x[::-1]), max(here, key=lambda x: x[::-1]))}
        got = [(x.symbol, x.ts, x.y) for x in charts.pixel_line(df, "y", width).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    clean = df.where("ts IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    assert charts.bounds(charts.pixel_line(df, "y", 3)).first() == charts.bounds(charts.line(clean, "y")).first()
    assert charts.pixel_line(df.limit(0), "y", 3).count() == 0
    with pytest.raises(ValueError):
        charts.pixel_line(df, "y", 0)


def test_candles_by_pixels(frame):
    df = frame({"a": [(1.0, 5.0, 0.5, 2.0), (2.0, 6.0, 1.0, None), (None, 4.0, 0.1, 7.0), (8.0, 9.0, 7.0, 8.5)]}, ("open", "high", "low", "close"))
    got = charts.pixel_candles(df, 2).orderBy("ts").collect()
    assert [(x.open, x.high, x.low, x.close) for x in got] == [(1.0, 6.0, 0.5, 2.0), (8.0, 9.0, 0.1, 8.5)]
    assert charts.pixel_candles(df, 50).count() == 4


def test_pages_open_their_ranges(spark, tmp_path):
    df = spark.range(1003).select((F.col("id") * 7919 % 500).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("id"))
    order = [F.col("x").desc_nulls_last(), "id"]
    pages = view.Pages.write(df, str(tmp_path / "p"), order, 25, 8)
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    assert pages.n_rows == 1003
    for n in (0, 1, 5, 17, 39, 40, 41, 900):
        assert [tuple(r) for r in pages.page(n).collect()] == whole[25 * n : 25 * n + 25]
    again = view.Pages(spark, str(tmp_path / "p"), df.schema, order, 25)
    page = again.page(20)
    page.collect()
    scan = [line for line in page._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert scan and "_range" in scan[0].split("PartitionFilters")[1] and len(page.inputFiles()) <= 8
    assert sum(len(r) for r in [{r for r, a, b in again._ranges if a < 525 and b > 500}]) <= 2
    empty = view.Pages.write(df.limit(0), str(tmp_path / "e"), order, 25, 8)
    assert empty.n_rows == 0 and empty.page(0).collect() == [] and empty.page(3).columns == df.columns
    for wrong in (lambda: pages.page(-1), lambda: view.Pages.write(df, str(tmp_path / "w"), order, 7)):
        with pytest.raises(ValueError):
            wrong()


def test_search_by_letters_equals_a_scan(spark, tmp_path):
    r = random.Random(6)
    texts = ["".join(r.choice("abcÄß😀. ") for _ in range(r.choice([0, 1, 2, 30, 60]))) for _ in range(300)] + [None, "Needle in a\nhaystack", "x" * 5000 + "needle"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = str(tmp_path / "t")
    text_index.write_indexed(df, "text", path, 6)
    for needle in ("needle", "IN A\nHAY", "äß", "ab", "", "abc", "b😀", "😀.", "c😀a", "zzz", "ca. "):
        wanted = {x.id for x in select.matching(df, "text", needle).collect()}
        assert {x.id for x in text_index.search(spark, path, "text", needle, df.schema).collect()} == wanted, needle
    assert text_index.files_that_may_hold(spark, path, "ab") is None
    every = text_index.search(spark, path, "text", "ab", df.schema).inputFiles()
    assert 0 < len(text_index.search(spark, path, "text", "haystack", df.schema).inputFiles()) < len(every)
    assert text_index.search(spark, path, "text", "qqq", df.schema).columns == ["id", "text"]
