"""Plans for few, very long series: entries by transitions, fits by moments, selection by counts."""

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from series_help import START

from tidemark.operators import align, calc, long_series, trades


def picks_by_definition(at, step):
    out, free = [], 0
    for i in sorted(at):
        if i >= free:
            out.append(i)
            free = i + step
    return out


@pytest.mark.parametrize(("step", "size"), [(1, 4), (3, 5), (7, 7), (12, 5), (40, 64)])
def test_transitions_pick_as_a_walk(spark, step, size):
    r = random.Random(step)
    sets = {1: list(range(200)), 2: [0], 3: [199], 4: [5, 150], **{k: sorted(r.sample(range(400), r.choice([3, 60, 300]))) for k in range(5, 12)}}
    rows = spark.createDataFrame([(k, i) for k, at in sets.items() for i in at], "symbol long, idx long").repartition(3)
    got = {}
    for p in trades.greedy_picks_by_transitions(rows, step, size).collect():
        got.setdefault(p.symbol, []).append(p.idx)
    assert {k: sorted(v) for k, v in got.items()} == {k: picks_by_definition(at, step) for k, at in sets.items()}
    assert trades.greedy_picks_by_transitions(rows.limit(0), step, size).count() == 0


@pytest.mark.parametrize(("hold", "stop"), [(0, 0.2), (1, 0.1), (5, 0.05), (30, 0.5)])
def test_trades_in_buckets_equal_a_walk(spark, frame, hold, stop):
    r = random.Random(hold)
    df = frame({s: [(r.uniform(8, 12), r.uniform(8, 12)) for _ in range(n)] for s, n in (("a", 150), ("b", 1), ("c", 33))}, ("open", "close"))
    rule = trades.Rule(("close", "open"), 0.8, ("open", "close"), 0.1, stop, hold)
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows.drop("trade_type").collect())
    walk = key(trades.find_trades(df, rule))
    assert key(trades.find_trades(df, rule, picks="transitions", size=8)) == walk and len(walk) > 5


def windows_by_symbol_alone(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [w for w in re.findall(r"Window \[.*?\], \[(.*?)\]", plan) if re.fullmatch(r"symbol#\d+", w)]


def test_buckets_lay_no_window_over_a_series(spark, frame):
    df = frame({"a": [(1.0 + i % 7, 2.0) for i in range(60)]}, ("open", "close"))
    rule = trades.Rule(("close", "open"), 0.5, ("open", "close"), 3.0, 0.1, 5)
    assert windows_by_symbol_alone(trades.find_trades(df, rule))
    assert not windows_by_symbol_alone(trades.find_trades(df, rule, picks="transitions", size=8))
    assert windows_by_symbol_alone(calc.linear_regression(df, "close", "fit"))
    # what is left are sums over the parts of a series, a row each
    assert "_own" in long_series.linear_regression(df, "close", "fit", parts=4)._jdf.queryExecution().analyzed().toString()


def test_fits_by_moments(spark, frame):
    r = random.Random(2)
    far = 1e9
    series = {
        "walk": [far + i * 0.5 + r.uniform(-1, 1) for i in range(300)], "gaps": [None if r.random() < 0.3 else r.uniform(0, 9) for _ in range(80)], "late": [None] * 40 + [3.0, 5.0], "one": [7.0],
        "none": [None, None, None], "point": [None, 4.0, None], "flat": [2.0] * 50,
    }
    df = frame(series)
    for parts in (1, 3, 7):
        close = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6 * (1 + abs(b)))
        got = {r.symbol: r for r in long_series.line_coefficients(df, "x", parts).collect()}
        wanted = {r.symbol: r for r in calc.line_coefficients(df, "x").collect()}
        assert got.keys() == wanted.keys() and all(close(got[s][c], wanted[s][c]) for s in wanted for c in ("intercept", "slope", "first_value", "n")), (got, wanted)
        for relative in (False, True):
            a = {(r.symbol, r.ts): r.fit for r in long_series.linear_regression(df, "x", "fit", relative, parts).collect()}
            b = {(r.symbol, r.ts): r.fit for r in calc.linear_regression(df, "x", "fit", relative).collect()}
            assert a.keys() == b.keys() and all(close(a[k], b[k]) for k in b)


def test_selection_by_counts(spark):
    r = random.Random(6)
    sets = {"one": [5], "same": [3] * 40, "wide": [r.randrange(1 << 59) for _ in range(101)], "small": [r.randrange(10) for _ in range(64)], "edges": [0, 4095, 4096, (1 << 24) - 1, 1 << 24]}
    df = spark.createDataFrame([(s, v) for s, vs in sets.items() for v in vs], "symbol string, v long").repartition(5)
    for nth, place in ((lambda n: F.floor(n / 2), lambda n: n // 2), (lambda n: F.lit(0), lambda n: 0), (lambda n: n - 1, lambda n: n - 1)):
        assert {g.symbol: g.v for g in long_series.selected(df, "v", nth).collect()} == {s: sorted(vs)[place(len(vs))] for s, vs in sets.items()}


def test_median_steps_over_borders(spark):
    r = random.Random(9)
    rows = [(s, START + timedelta(milliseconds=t)) for s, n in (("a", 300), ("b", 2), ("c", 1)) for t in [r.randrange(100_000) for _ in range(n)]]
    df = spark.createDataFrame([*rows, *rows[:20], ("d", None)], "symbol string, ts timestamp")
    wanted = {g.symbol: g.step for g in align.median_steps(df).collect()}
    assert {g.symbol: g.step for g in long_series.median_steps(df, 6).collect()} == wanted and set(wanted) == {"a", "b"}


def test_back_test_over_frames_and_in_buckets(spark, frame):
    r = random.Random(1)
    values = [(r.uniform(8, 12), r.uniform(8, 12)) for _ in range(80)]
    day, level = frame({"a": values}, ("open", "close")), frame({"a": [10.0] * 80}, ("level",))
    rule = trades.Rule(("day.close", "flat.level"), 0.5, ("day.open", "flat.level"), 0.2, 0.1, 4)
    out = {picks: trades.back_test({"day": day, "flat": level}, rule, day, picks=picks) for picks in ("walk", "transitions")}
    for name in ("trades", "results", "summary"):
        a, b = (sorted(map(str, out[p][name].collect())) for p in out)
        assert a == b and a
