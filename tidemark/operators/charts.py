"""Chart datasets in one long form: series, kind, symbol, ts, y, open, high, low, close."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calc import row_index


def _values(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    rows = df.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)])
    return rows.unpivot(["symbol", "ts"], list(dict.fromkeys(columns)), "series", "y").select("series", F.lit(kind).alias("kind"), "symbol", "ts", "y")


def line(df: DataFrame, *columns: str) -> DataFrame:
    return _values(df, list(columns), "line")


def bar(df: DataFrame, column: str) -> DataFrame:
    return _values(df, [column], "bar")


def candle(df: DataFrame, open: str = "open", high: str = "high", low: str = "low", close: str = "close", series: str = "candles") -> DataFrame:
    parts = [F.col(c).cast("double").alias(n) for n, c in (("open", open), ("high", high), ("low", low), ("close", close))]
    return df.select(F.lit(series).alias("series"), F.lit("candle").alias("kind"), "symbol", "ts", *parts)


def _in_pixels(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``_px``, the place of each in ``width`` equal stretches of its symbol's time.

    The ends of each symbol are an aggregate of their own, a row a symbol, and joined back in the shape that the planner
    takes for its size.  Places are whole numbers of microseconds, so no rounding moves a row.
    """
    if width < 1:
        raise ValueError("a chart is one pixel wide at least")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.withColumn("_at", at).where("_at IS NOT NULL")
    ends = rows.groupBy("symbol").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    step = F.expr(f"(_to - _from) DIV {width} + 1")
    places = ends.select(F.col("symbol").alias("_of"), "_from", step.alias("_step"))
    # symbols without a name make a series too
    return rows.join(places, F.col("symbol").eqNullSafe(F.col("_of"))).withColumn("_px", F.expr("(_at - _from) DIV _step")).drop("_at", "_of", "_from", "_step")


def pixel_line(df: DataFrame, column: str, width: int) -> DataFrame:
    """A line as it looks ``width`` pixels wide: of each symbol and pixel the first, last, least and greatest value, each row once.

    Drawn at that width it covers the pixels of the whole line, and its bounds are those of all rows.  Nulls and NaN give no
    point.  Of rows of one time the first has the least and the last the greatest value; of equal extremes the least has the
    first and the greatest the last time.  Four points a pixel and symbol whatever the length of a series, in one aggregate with
    partial sums before its shuffle, so a symbol with most rows is no large task.
    """
    y = F.col(column).cast("double")
    rows = _in_pixels(df.select("symbol", "ts", y.alias("y")).where("y IS NOT NULL AND NOT isnan(y)"), width)
    in_time, in_value = F.struct("ts", "y"), F.struct("y", "ts")
    ends = rows.groupBy("symbol", "_px").agg(F.min(in_time).alias("a"), F.max(in_time).alias("b"), F.min(in_value).alias("c"), F.max(in_value).alias("d"))
    turned = [F.struct(F.col(f"{c}.ts").alias("ts"), F.col(f"{c}.y").alias("y")) for c in "cd"]
    points = ends.select("symbol", F.inline(F.array_distinct(F.array("a", "b", *turned))))
    return points.select(F.lit(column).alias("series"), F.lit("line").alias("kind"), "symbol", "ts", "y")


def pixel_candles(df: DataFrame, width: int, open: str = "open", high: str = "high", low: str = "low", close: str = "close", series: str = "candles") -> DataFrame:
    """Candles merged to one for each symbol and pixel: first open, greatest high, least low, last close, at the time of the first.

    Nulls are passed over part by part; a part that a pixel has nowhere is null.  Of rows of one time the order of their values decides.
    """
    parts = {"open": open, "high": high, "low": low, "close": close}
    rows = _in_pixels(df.select("symbol", "ts", *[F.col(c).cast("double").alias(n) for n, c in parts.items()]), width)
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("ts", c))
    merged = rows.groupBy("symbol", "_px").agg(F.min("ts").alias("ts"), F.min(at("open"))["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(at("close"))["close"].alias("close"))
    return merged.select(F.lit(series).alias("series"), F.lit("candle").alias("kind"), "symbol", "ts", *parts)


def stack(*datasets: DataFrame) -> DataFrame:
    """Several draw commands as one dataset, with the columns of all."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), datasets)


def axis_labels(df: DataFrame) -> DataFrame:
    """``(symbol, idx, label)``: times in milliseconds, or row numbers where there is no time column."""
    label = F.unix_millis(F.col("ts").cast("timestamp")) if "ts" in df.columns and df.schema["ts"].dataType.simpleString() in ("timestamp", "timestamp_ntz", "date") else row_index().cast("long")
    return df.select("symbol", row_index().alias("idx"), label.alias("label"))


def bounds(chart: DataFrame, padding: float = 25.0) -> DataFrame:
    """Least and greatest value over all series, the greatest 0 at least, padded."""
    has = lambda c: F.col(c) if c in chart.columns else F.lit(None).cast("double")
    low = F.least(F.min(has("y")), F.min(has("low")))
    high = F.greatest(F.max(has("y")), F.max(has("high")), F.lit(0.0))
    return chart.agg((low - padding).alias("y_min"), (high + padding).alias("y_max"))


def trade_rects(marked: DataFrame) -> DataFrame:
    """Boxes from entry to exit (green) or limit (red), at the close of the entry row; ``marked`` has entry, exit, limit ids and close.

    An id that closes twice makes one box, at its first close; one that never closes makes none.
    """
    entries = marked.where("entry IS NOT NULL").groupBy("symbol", F.col("entry").alias("id")).agg(F.max("ts").alias("x_start"), F.max_by(F.coalesce("close", F.lit(0.0)), "ts").alias("strike"))
    closes = marked.select("symbol", "ts", F.explode(F.array(F.struct(F.col("exit").alias("id"), F.lit("green_rect").alias("kind")), F.struct(F.col("limit").alias("id"), F.lit("red_rect").alias("kind")))).alias("c"))
    closes = closes.where("c.id IS NOT NULL").groupBy("symbol", F.col("c.id").alias("id")).agg(F.min(F.struct("ts", "c.kind")).alias("c"))
    return entries.join(closes, ["symbol", "id"]).where(F.col("c.ts") >= F.col("x_start")).select("symbol", "id", F.col("c.kind").alias("kind"), "x_start", F.col("c.ts").alias("x_end"), "strike")


def candle_bodies(candles: DataFrame) -> DataFrame:
    """The box of each candle: low and high end, middle, and whether it went up."""
    o, c = F.col("open"), F.col("close")
    low: Column = F.least(o, c)
    return candles.select("symbol", "ts", low.alias("box_low"), F.greatest(o, c).alias("box_high"), ((o + c) / 2).alias("box_mid"), (c >= o).alias("up"))
