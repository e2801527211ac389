import math
import random
import statistics

import numpy as np
import pytest
from series_help import alike, values
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import calc

INF, NAN = float("inf"), float("nan")


def series(n, seed=0):
    r = random.Random(seed)
    return [round(50 + 20 * r.random(), 3) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 13, 14, 15, 40])
def test_rolling_forms(frame, n):
    x = series(n)
    df = frame({"a": x, "b": series(20, 9)})
    got = df.withColumns({"m": calc.moving_average("x"), "late": calc.moving_average("x", align="delayed"), "mid": calc.moving_average("x", align="centered", fill=0.0), "v": calc.volatility("x")})
    mean = [statistics.fmean(x[i - 13 : i + 1]) if i >= 13 else None for i in range(n)]
    assert alike(values(got, "m"), mean)
    assert alike(values(got, "late"), [None] * min(7, n) + mean[: max(0, n - 7)])
    assert alike(values(got, "mid"), [v or 0.0 for v in mean[7:]] + [0.0] * min(7, n))
    assert alike(values(got, "v"), [statistics.stdev(x[i - 13 : i + 1]) if i >= 13 else 0.0 for i in range(n)])


def test_wrapped_average_goes_round(frame):
    x = series(20)
    got = values(calc.wrapped_average(frame({"a": x}), "x", "m", 4), "m")
    mean = [statistics.fmean(x[i - 3 : i + 1]) if i >= 3 else None for i in range(20)]
    assert alike(got, mean[-2:] + mean[:-2])


def test_nulls_in_a_window(frame):
    got = frame({"a": [1.0, 2.0, None, 4.0, 5.0, 6.0]}).withColumns({"m": calc.moving_average("x", 3), "c": calc.moving_average("x", 3, "centered")})
    assert alike(values(got, "m"), [None] * 5 + [5.0])
    assert alike(values(got, "c"), [None, 1.0, 2.0, 3.0, 5.0, None])


def test_return_volatility_needs_positive_prices(frame):
    x = [10.0, 11.0, 0.0, 12.0, 13.0, 12.5, 14.0]
    got = calc.with_return_volatility(frame({"a": x}), "x", "v", 2, scale=1.0)
    r = [math.log(b / a) if a > 0 and b > 0 else None for a, b in zip(x, x[1:])]
    wanted = [None, None] + [statistics.stdev([a, b]) * math.sqrt(252) if a is not None and b is not None else None for a, b in zip(r, r[1:])]
    assert alike(values(got, "v"), wanted)
    assert alike(values(got, "v_pos"), [None if w is None else p * (1 + w) for p, w in zip(x, wanted)])


@pytest.mark.parametrize("x", [[], [None, None], [None, 5.0, None], [3.0, None, 4.0, 9.0], [2.0] * 6, series(30)])
def test_regression_line(frame, x):
    got = values(calc.linear_regression(frame({"a": x, "b": [1.0, 2.0]}), "x", "line"), "line")
    known = [(i, v) for i, v in enumerate(x) if v is not None]
    slope, start = np.polyfit(*zip(*known), 1) if len(known) > 1 else (0.0, known[0][1] if known else 0.0)
    assert alike(got, [slope * i + start for i in range(len(x))])


def test_operand_forms(frame):
    df = frame({"a": [(4.0, 2.0), (4.0, 0.0)]}, ("x", "y"))
    got = df.withColumns({"q": calc.quotient("x", "y"), "s": calc.total(["x", "y", "3"]), "p": calc.product(["x", 2]), "k": calc.constant("no number"), "w": calc.index_weighted("x"), "l": calc.index_line(1, 2)})
    assert [values(got, c) for c in "qspkwl"] == [[2.0, None], [9.0, 7.0], [8.0, 8.0], [0.0, 0.0], [0.0, 4.0], [1.0, 3.0]]
    assert list(calc.differences(["x", "y", "x"], "d")) == ["d_0", "d_1"]


def test_repair_and_fill(frame):
    r = random.Random(3)
    for _ in range(3):
        x = [r.choice([None, NAN, INF, -INF, 1.0, 2.0, 3.0]) for _ in range(12)]
        df = frame({"a": x}).withColumns({"r": clean.repaired(F.col("x")), "f": clean.filled(F.col("x"))})
        ok = [v if v is not None and math.isfinite(v) else None for v in x]
        wanted = [next((v for v in [*ok[: i + 1][::-1], *ok[i:]] if v is not None), 0.0) for i in range(12)]
        assert alike(values(df, "r"), wanted)
        carried = [next((v for v in [*x[: i + 1][::-1], *x[i:]] if v is not None), None) for i in range(12)]
        assert alike(values(df, "f"), [v if v is not None and math.isfinite(v) else 0.0 for v in carried])


def test_calc_order_and_errors(frame):
    df = frame({"a": series(20)})
    wanted = [calc.Calc("SUM", ("d", "m"), "s"), calc.Calc("DIFFERENCE", ("x", "m"), "d"), calc.Calc("SMA", ("x", "3"), "m")]
    assert [[c.out for c in w] for w in calc.in_waves(wanted)] == [["m"], ["d"], ["s"]]
    got = calc.run_calcs(df, wanted)
    assert got.columns == ["symbol", "ts", "x", "s", "d", "m"]
    assert values(got, "m")[:2] == [None, None]  # outputs are not repaired, only what later calculations read
    with pytest.raises(ValueError, match="twice"):
        calc.in_waves([wanted[0], wanted[0]])
    with pytest.raises(ValueError, match="no such"):
        calc.run_calcs(df, [calc.Calc("SMA", ("nothing",), "m")])


def test_a_chain_of_windows_is_one_shuffle_and_one_sort(frame):
    df = frame({"a": series(20), "b": series(20)})
    wanted = [calc.Calc("SMA", ("x",), "m"), calc.Calc("VOLATILITY", ("x",), "v"), calc.Calc("RETURN_VOLATILITY", ("x",), "r"), calc.Calc("DIFFERENCE", ("x", "m"), "d")]
    plan = calc.run_calcs(df, wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan
