"""Row-wise and rolling calculations on frames keyed (symbol, ts), and runs of several that depend on each other.

All rolling forms use one window specification, so a chain of them plans to one shuffle on symbol and one sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import repaired, series
from tidemark.functions.scalar import as_column, is_number

PERIOD = 14


def row_index() -> Column:
    return F.row_number().over(series()) - 1


def rolling(n: int):
    return series().rowsBetween(-(n - 1), 0)


def _full(n: int) -> Column:
    return F.count(F.lit(1)).over(rolling(n)) == n


def constant(value) -> Column:
    """A constant; what is no number is 0."""
    return F.lit(float(value) if is_number(value) else 0.0)


def difference(a, b) -> Column:
    return as_column(a) - as_column(b)


def differences(names: list, out: str) -> dict[str, Column]:
    """First minus second; of more than two columns, one difference for every neighbouring pair."""
    pairs = list(zip(names, names[1:]))
    if not pairs:
        raise ValueError("a difference takes two columns at least")
    return {out if len(pairs) == 1 else f"{out}_{i}": difference(a, b) for i, (a, b) in enumerate(pairs)}


def total(names: list) -> Column:
    return reduce(add, map(as_column, names))


def product(names: list) -> Column:
    return reduce(mul, map(as_column, names))


def quotient(a, b) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(as_column(a), as_column(b))


def moving_average(x, n: int = PERIOD, align: str = "trailing", fill: float | None = None) -> Column:
    """Mean of n rows; null before n rows are there and where one of them is null.

    align: "trailing" ends at the row, "delayed" comes n // 2 rows later, "centered" looks n // 2 rows ahead, takes nulls
    as nothing but still divides by n.  ``fill`` replaces nulls at the ends.
    """
    x = as_column(x)
    f = rolling(n)
    if align == "centered":
        out = F.lead(F.when(_full(n), F.sum(F.coalesce(x, F.lit(0.0))).over(f) / n), n // 2).over(series())
    else:
        out = F.when(F.count(x).over(f) == n, F.avg(x).over(f))
        if align == "delayed":
            out = F.lag(out, n // 2).over(series())
        elif align != "trailing":
            raise ValueError(f"no alignment {align}")
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def wrapped_average(df: DataFrame, x: str, out: str, n: int = PERIOD) -> DataFrame:
    """The delayed average whose last n // 2 values come round to the front of the series."""
    rows = df.withColumn("_idx", row_index()).withColumn("_avg", moving_average(x, n)).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    moved = rows.select("symbol", F.pmod(F.col("_idx") + n // 2, F.col("_len")).alias("_idx"), F.col("_avg").alias(out))
    return rows.join(moved, ["symbol", "_idx"], "left").drop("_idx", "_avg", "_len")


def volatility(x, n: int = PERIOD) -> Column:
    """Sample standard deviation of the level over n rows; 0 before n rows are there."""
    if n <= 1:
        return F.lit(0.0)
    return F.coalesce(F.when(_full(n), F.stddev_samp(as_column(x)).over(rolling(n))), F.lit(0.0))


def bands(x, vol, out: str, scale: float = 0.5, keep_null: bool = False) -> dict[str, Column]:
    """``out_pos`` and ``out_neg``: the level times one plus and minus ``scale`` times the volatility."""
    x, vol = as_column(x), as_column(vol)
    if not keep_null:
        x, vol = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.nanvl(vol, F.lit(0.0)), F.lit(0.0))
    return {f"{out}_pos": x * (1 + scale * vol), f"{out}_neg": x * (1 - scale * vol)}


def log_return(x) -> Column:
    """ln of the ratio to the row before; null unless both are positive."""
    x = as_column(x)
    before = F.lag(x).over(series())
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def return_volatility(r, n: int = PERIOD, per_year: int = 252) -> Column:
    """Yearly sample standard deviation of n log returns; null unless all n are there.  ``r`` is a column of log returns."""
    r = as_column(r)
    f = rolling(n)
    return F.when(F.count(r).over(f) == n, F.stddev_samp(r).over(f) * math.sqrt(per_year))


def with_return_volatility(df: DataFrame, x: str, out: str, n: int = PERIOD, scale: float | None = None) -> DataFrame:
    df = df.withColumn("_r", log_return(x)).withColumn(out, return_volatility("_r", n)).drop("_r")
    return df if scale is None else df.withColumns(bands(x, out, out, scale, keep_null=True))


def line_coefficients(df: DataFrame, y: str) -> DataFrame:
    """``(symbol, intercept, slope, first_value, n)``: least squares of y on the row index, over rows where y is not null.

    Fewer than two points, or points that leave no slope, give slope 0 through the first value; no point gives 0.
    """
    rows = df.select("symbol", "ts", F.col(y).cast("double").alias("y"), row_index().cast("double").alias("i"))
    fit = rows.groupBy("symbol").agg(F.regr_slope("y", "i").alias("b"), F.regr_intercept("y", "i").alias("a"), F.min_by("y", F.when(F.col("y").isNotNull(), F.col("i"))).alias("first_value"), F.count("y").alias("n"))
    first = F.coalesce("first_value", F.lit(0.0))
    return fit.select("symbol", F.coalesce(F.when(F.col("n") > 1, F.col("a")), first).alias("intercept"), F.coalesce(F.when(F.col("n") > 1, F.col("b")), F.lit(0.0)).alias("slope"), "first_value", "n")


def linear_regression(df: DataFrame, y: str, out: str, relative: bool = False) -> DataFrame:
    """The fitted line on every row; ``relative`` gives it as a change from the first value.

    An aggregate joined back, so a long series needs no unbounded window; the join is left to the planner, as the number
    of symbols has no bound.
    """
    fit = line_coefficients(df, y).select("symbol", "intercept", "slope", "first_value")
    rows = df.withColumn("_i", row_index()).join(fit, "symbol")
    line = F.col("slope") * F.col("_i") + F.col("intercept")
    if relative:
        line = F.try_divide(line, F.col("first_value")) - 1
    return rows.withColumn(out, line).drop("_i", "intercept", "slope", "first_value")


def index_weighted(y) -> Column:
    return row_index() * as_column(y)


def index_line(a: float, b: float) -> Column:
    return F.lit(float(a)) + F.lit(float(b)) * row_index()


def series_sums(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy("symbol").agg(F.sum(F.col(y).cast("double")).alias("total"))


@dataclass(frozen=True)
class Calc:
    """One calculation: inputs (columns or numbers), operation, output name, options of the operation."""

    op: str
    inputs: tuple
    out: str
    options: dict = field(default_factory=dict)

    @property
    def outputs(self) -> list[str]:
        if self.op == "DIFFERENCE" and len(self.inputs) > 2:
            return [f"{self.out}_{i}" for i in range(len(self.inputs) - 1)]
        return [self.out, f"{self.out}_pos", f"{self.out}_neg"] if "VOLATILITY" in self.op else [self.out]

    @property
    def needs(self) -> list[str]:
        return [] if self.op == "CONSTANT" else [x for x in self.inputs if isinstance(x, str) and not is_number(x)]


def in_waves(calcs: list[Calc]) -> list[list[Calc]]:
    """Calculations in an order in which inputs come first; those that depend on nothing open stand in one wave."""
    names = [o for c in calcs for o in c.outputs]
    twice = sorted({o for o in names if names.count(o) > 1})
    if twice:
        raise ValueError(f"named twice: {', '.join(twice)}")
    waves, open_, done = [], list(calcs), set()
    while open_:
        ready = [c for c in open_ if not (set(c.needs) & set(names)) - done]
        if not ready:
            return [*waves, open_]  # a circle: these fail when their inputs are looked up
        waves.append(ready)
        open_ = [c for c in open_ if c not in ready]
        done |= {o for c in ready for o in c.outputs}
    return waves


def _apply(df: DataFrame, c: Calc, read: dict[str, str]) -> DataFrame:
    ins = [read.get(x, x) if isinstance(x, str) else x for x in c.inputs]
    opts = dict(c.options)
    if c.op in ("SMA", "VOLATILITY", "DOUBLE_VOLATILITY") and len(ins) > 1:
        opts["n"] = int(float(ins[1]))
    if c.op == "CONSTANT":
        return df.withColumn(c.out, constant(ins[0]))
    if c.op == "DIFFERENCE":
        return df.withColumns(differences(ins, c.out))
    if c.op in ("SUM", "MULTIPLY"):
        return df.withColumn(c.out, (total if c.op == "SUM" else product)(ins))
    if c.op == "DIVIDE":
        return df.withColumn(c.out, quotient(*ins))
    if c.op == "SMA":
        return df.withColumn(c.out, moving_average(ins[0], **opts))
    if c.op in ("VOLATILITY", "DOUBLE_VOLATILITY"):
        df = df.withColumn(c.out, volatility(ins[0], **opts))
        return df.withColumns(bands(ins[0], c.out, c.out, 0.5 if c.op == "VOLATILITY" else 1.0))
    if c.op == "RETURN_VOLATILITY":
        return with_return_volatility(df, ins[0], c.out, scale=opts.pop("scale", 0.5), **opts)
    if c.op == "LINEAR_REGRESSION":
        return linear_regression(df, ins[0], c.out, **opts)
    raise ValueError(f"no operation {c.op}")


def run_calcs(df: DataFrame, calcs: list[Calc], clean_inputs: bool = True) -> DataFrame:
    """``df`` with the outputs of all calculations.

    Calculations read repaired copies of their inputs; the columns of ``df`` and the outputs themselves stay as they are.
    """
    keep = [*df.columns, *(o for c in calcs for o in c.outputs)]
    for wave in in_waves(calcs):
        needed = sorted({x for c in wave for x in c.needs})
        missing = [x for x in needed if x not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        read = {x: f"_clean_{x}" for x in needed} if clean_inputs else {}
        df = df.withColumns({to: repaired(F.col(x)) for x, to in read.items()}) if read else df
        for c in wave:
            df = _apply(df, c, read)
        df = df.drop(*read.values())
    return df.select(*keep)
