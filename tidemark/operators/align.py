"""Joining series in time: exactly, as-of with a tolerance, and by position."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.select import as_series, with_any, without_nulls

Series = tuple[DataFrame, str, str]
"""(frame, column, alias)"""


def _grouped(series: list[Series]) -> list[tuple[DataFrame, list[tuple[str, str]]]]:
    """Columns by frame: series of one frame need no join."""
    out: list[tuple[DataFrame, list[tuple[str, str]]]] = []
    for df, column, alias in series:
        for known, columns in out:
            if known is df:
                columns.append((column, alias))
                break
        else:
            out.append((df, [(column, alias)]))
    return out


def align_exact(series: list[Series]) -> DataFrame:
    """``(symbol, ts, aliases)`` at the times that all series share."""
    parts = [df.select("symbol", "ts", *[F.col(c).cast("double").alias(a) for c, a in columns]) for df, columns in _grouped(series)]
    return reduce(lambda a, b: a.join(b, ["symbol", "ts"]), parts).select("symbol", "ts", *[a for _, _, a in series])


def align_position(series: list[Series]) -> DataFrame:
    """Row i beside row i of every frame, times from the first; symbols whose frames differ in length are left out."""
    w, every = Window.partitionBy("symbol").orderBy("ts"), Window.partitionBy("symbol")
    parts = []
    for k, (df, columns) in enumerate(_grouped(series)):
        time = [F.col("ts")] if not k else []
        parts.append(df.select("symbol", (F.row_number().over(w) - 1).alias("_idx"), F.count(F.lit(1)).over(every).alias("_rows"), *time, *[F.col(c).cast("double").alias(a) for c, a in columns]))
    return reduce(lambda a, b: a.join(b, ["symbol", "_idx", "_rows"]), parts).select("symbol", "ts", *[a for _, _, a in series])


def unique_times(df: DataFrame) -> DataFrame:
    """Rows that differ in some column, each once."""
    return df.dropDuplicates()


def asof_backward(master: DataFrame, other: DataFrame, columns: list[str], tolerance: timedelta | None = None) -> DataFrame:
    """``master`` with the columns of the last row of ``other`` at or before its time, null if that is older than ``tolerance``.

    Both sides are stacked and carried forward in one window per symbol: one shuffle of each side and no range join.
    Rows of ``other`` whose columns are null are left out before.
    """
    value = F.struct(F.col("ts").alias("at"), *columns)
    right = without_nulls(other.select("symbol", "ts", *columns), *columns).select("symbol", "ts", F.lit(0).alias("_side"), value.alias("_value"))
    left = master.select(F.col("symbol"), F.col("ts"), F.lit(1).alias("_side"), F.struct(*master.columns).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("ts", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(order)).where(F.col("_side") == 1)
    if tolerance is not None:
        limit = F.make_dt_interval(secs=F.lit(tolerance.total_seconds()))
        seen = seen.withColumn("_seen", F.when(F.col("ts") - F.col("_seen.at") <= limit, F.col("_seen")))
    return seen.select("_row.*", *[F.col(f"_seen.{c}").alias(c) for c in columns])


def as_known(versions: DataFrame, at, columns: list[str], period: str = "period", known: str = "known") -> DataFrame:
    """``(symbol, period, known, columns)``: of every period the version that was known last at the time ``at`` (text, time or column).

    Versions known later do not count, nor do rows without a period or a time; of versions of one time the greatest counts.  A
    version whose figures are null takes the figures back.  One aggregate, so restatements are reduced before the shuffle.
    """
    at = at if isinstance(at, Column) else F.lit(at)
    rows = versions.where(F.col(period).isNotNull() & (F.col(known) <= at.cast(versions.schema[known].dataType)))
    last = rows.groupBy("symbol", period).agg(F.max(F.struct(known, *[c for c in columns if c not in (period, known)])).alias("_v"))
    return last.select("symbol", period, F.col(f"_v.{known}").alias(known), *[F.col(f"_v.{c}").alias(c) for c in columns if c not in (period, known)])


def asof_known(master: DataFrame, versions: DataFrame, columns: list[str], period: str = "period", known: str = "known", slice: timedelta | None = None) -> DataFrame:
    """``master`` with the columns of the newest period that was known at its time, in the version known then; null before any was.

    A restatement of an older period never hides a newer period, and no row sees a version that came after it.  Both sides
    are stacked, and what is known is a running greatest (period, known, columns): one shuffle of each side, one sort, no range
    join.  ``columns`` may name ``period`` and ``known``.  Rows of ``versions`` without a period or a time, and rows of
    ``master`` without a time, see nothing and are not seen; of versions of one period and time the greatest counts.

    ``slice`` cuts series by time, for symbols with very many rows: slices are tasks of their own, and what was known before
    each comes from the greatest of every slice, a row for each.
    """
    value = F.struct(F.col(period).alias("_0"), F.col(known).alias("_1"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(columns, 2)])
    right = versions.where(F.col(period).isNotNull() & F.col(known).isNotNull()).select("symbol", F.col(known).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), value.alias("_value"))
    left = master.select("symbol", F.col("ts").cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.struct(*master.columns).alias("_row"))
    both, keys = left.unionByName(right, allowMissingColumns=True), ["symbol"]
    if slice is not None:
        both, keys = both.withColumn("_slice", F.floor(F.unix_micros("_at") / int(slice.total_seconds() * 1e6))), ["symbol", "_slice"]
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.max("_value").over(order))
    if slice is not None:
        past = Window.partitionBy("symbol").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = both.groupBy(*keys).agg(F.max("_value").alias("_end"))
        slices = ends.select(F.col("symbol").alias("_s"), F.col("_slice").alias("_c"), F.max("_end").over(past).alias("_past"))
        seen = seen.join(slices, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("_slice").eqNullSafe(F.col("_c")), "left").withColumn("_seen", F.greatest("_seen", "_past"))
    at = F.when(F.col("_at").isNotNull(), F.col("_seen"))
    return seen.where("_side = 1").select("_row.*", *[at[f"_{k}"].alias(c) for k, c in enumerate(columns, 2)])


def median_steps(df: DataFrame) -> DataFrame:
    """``(symbol, step)``: the upper median of the positive steps between neighbouring times, in milliseconds."""
    w = Window.partitionBy("symbol").orderBy("ts")
    step = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag(F.col("ts").cast("timestamp")).over(w))
    ranked = df.select("symbol", step.alias("step")).where("step > 0")
    ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy("step"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return ranked.where(F.col("_k") - 1 == F.floor(F.col("_n") / 2)).select("symbol", "step")


def choose_master(frames: list[DataFrame]) -> int:
    """The place of the frame with the finest timeline: least median step of any of its symbols; the first of equals."""
    steps = reduce(DataFrame.unionAll, [median_steps(df).select(F.lit(i).alias("frame"), "step") for i, df in enumerate(frames)])
    best = steps.agg(F.min(F.struct("step", "frame")).alias("best")).first()["best"]
    return 0 if best is None else best["frame"]


def align_asof(series: list[Series], tolerance: timedelta) -> DataFrame:
    """All series on the finest timeline among them, each carried forward within the tolerance; an error if nothing overlaps."""
    tables = [without_nulls(as_series(df, column, alias)) for df, column, alias in series]
    at = choose_master(tables)
    out = unique_times(tables[at])
    for k, (table, (_, _, alias)) in enumerate(zip(tables, series)):
        if k != at:
            out = asof_backward(out, table, [alias], tolerance)
    aliases = [a for _, _, a in series]
    out = with_any(out, *aliases).select("symbol", "ts", *aliases)
    if out.isEmpty():
        raise ValueError("the series do not overlap")
    return out


def open_prices(frame: DataFrame) -> DataFrame:
    """``(symbol, ts, open)`` without nulls; of rows of one time the last in order of price."""
    return frame.where(F.col("ts").isNotNull() & F.col("open").isNotNull()).groupBy("symbol", "ts").agg(F.max(F.col("open").cast("double")).alias("open"))


def append_by_position(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """``df`` with a column of ``other``, row i to row i of each symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    right = other.select("symbol", F.row_number().over(w).alias("_idx"), column)
    return df.withColumn("_idx", F.row_number().over(w)).join(right, ["symbol", "_idx"], "left").drop("_idx")
