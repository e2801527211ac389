"""Plans for few, very long series: windows over buckets of rows instead of whole symbols.

``idx`` comes from a range partitioning and per-partition counts, so no task sorts a whole series.  Rolling windows run
inside buckets of ``size`` rows, into which the last rows of the bucket before are copied (halo) and dropped afterwards.
Fills run inside buckets and are then carried over the small table of bucket ends; ``repaired`` does so along range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tidemark.functions.scalar import finite
from tidemark.functions.storage import checkpointed, scratch
from tidemark.operators.select import without_nulls


def with_index(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` with ``idx``, the place of each row in its series, without a window over the series.

    Rows are range-partitioned by (symbol, ts); a partition numbers its own rows, and counts of the partitions before
    (one row per symbol and partition) are added.  The dealt rows are checkpointed, as partition numbers must not change.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, "symbol", "ts").withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("symbol", "_part").count()
    before = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("symbol", "_part").orderBy("ts")) - 1
    return dealt.withColumn("idx", own).join(offsets, ["symbol", "_part"]).withColumn("idx", F.col("idx") + F.col("_offset")).drop("_part", "_offset")


def _dealt(df: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part`` and ``_own``, their place within it, and ``(symbol, _part, _offset)``, the rows of the series before."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, "symbol", "ts").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("symbol", "_part").count().select("symbol", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return dealt.withColumn("_own", F.row_number().over(Window.partitionBy("symbol", "_part").orderBy("ts")) - 1), offsets


def _fit(rows: DataFrame, offsets: DataFrame, y: str) -> DataFrame:
    """``(symbol, intercept, slope, first_value, n)`` from moments of the parts.

    Each part gives count, means and centred sums of squares over its own places; a place in the series is the place in the
    part and the rows before it, so a mean moves by these and centred sums stay.  Parts then merge by the distance of
    their means from the common one, which keeps the figures as exact as those of one pass.
    """
    x, value = F.col("_own").cast("double"), F.col(y).cast("double")
    known = F.when(value.isNotNull(), F.col("_own"))
    own = rows.groupBy("symbol", "_part").agg(
        F.count(value).alias("k"), F.regr_avgx(value, x).alias("mx"), F.regr_avgy(value, x).alias("my"), F.regr_sxx(value, x).alias("xx"), F.regr_sxy(value, x).alias("xy"), F.min_by(value, known).alias("y0")
    )
    own = own.join(offsets, ["symbol", "_part"]).withColumn("mx", F.col("mx") + F.col("_offset"))
    k = F.sum("k")
    whole = own.groupBy("symbol").agg(k.alias("n"), (F.sum(F.col("k") * F.col("mx")) / k).alias("x_"), (F.sum(F.col("k") * F.col("my")) / k).alias("y_"), F.min_by("y0", F.when(F.col("k") > 0, F.col("_part"))).alias("first_value"))
    dx, dy = F.col("mx") - F.col("x_"), F.col("my") - F.col("y_")
    both = own.select("symbol", "k", "mx", "my", "xx", "xy").join(whole, "symbol").groupBy("symbol", "n", "x_", "y_", "first_value")
    sums = both.agg(F.sum(F.col("xx") + F.col("k") * dx * dx).alias("xx"), F.sum(F.col("xy") + F.col("k") * dx * dy).alias("xy"))
    slope = F.coalesce(F.when(F.col("n") > 1, F.try_divide("xy", "xx")), F.lit(0.0))
    level = F.when((F.col("n") > 1) & (F.col("xx") > 0), F.col("y_") - slope * F.col("x_"))
    return sums.select("symbol", F.coalesce(level, "first_value", F.lit(0.0)).alias("intercept"), slope.alias("slope"), "first_value", "n")


def line_coefficients(df: DataFrame, y: str, parts: int | None = None) -> DataFrame:
    """As ``calc.line_coefficients``, for few and very long series: no window over a series, and no row number either."""
    return _fit(*_dealt(df.select("symbol", "ts", y), parts), y)


def linear_regression(df: DataFrame, y: str, out: str, relative: bool = False, parts: int | None = None) -> DataFrame:
    """As ``calc.linear_regression``, for few and very long series."""
    rows, offsets = _dealt(df, parts)
    fit = _fit(rows, offsets, y).select("symbol", F.col("intercept").alias("_a"), F.col("slope").alias("_b"), F.col("first_value").alias("_y"))
    # one row a symbol and part: the line in terms of a row's own place
    lines = offsets.join(fit, "symbol").select("symbol", "_part", (F.col("_a") + F.col("_b") * F.col("_offset")).alias("_a"), "_b", "_y")
    line = F.col("_a") + F.col("_b") * F.col("_own")
    if relative:
        line = F.try_divide(line, F.col("_y")) - 1
    return rows.join(lines, ["symbol", "_part"]).withColumn(out, line).drop("_part", "_own", "_a", "_b", "_y")


#: Bits of a value that one round of a selection settles, and bits of the values.
DIGIT, BITS = 12, 60


def selected(values: DataFrame, x: str, nth) -> DataFrame:
    """``(symbol, x)``: of each symbol the value that ``nth(count)`` values come before, exactly.

    Values are whole numbers from 0 up to 2^60.  Equal ones are counted first.  Each round counts the values that share the
    digits found so far by their next digit, in partial sums, and finds the digit in which the place lies: five rounds
    whatever the number of rows, of at most 4,096 sums a symbol each, and no task holds or sorts a symbol's values.
    """
    rows = checkpointed(values.select("symbol", F.col(x).cast("long").alias("_x")).groupBy("symbol", "_x").agg(F.count(F.lit(1)).alias("_n")))
    found = rows.groupBy("symbol").agg(F.sum("_n").alias("_all")).select("symbol", nth(F.col("_all")).cast("long").alias("_k"), F.lit(0).cast("long").alias("_head"))
    upto = Window.partitionBy("symbol").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        here = rows.join(found, "symbol").where(F.shiftright("_x", shift + DIGIT) == F.col("_head"))
        sums = here.groupBy("symbol", "_k", "_head", F.shiftright("_x", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("_digit")).agg(F.sum("_n").alias("_n"))
        sums = sums.withColumn("_past", F.sum("_n").over(upto)).where((F.col("_past") > F.col("_k")) & (F.col("_past") - F.col("_n") <= F.col("_k")))
        found = checkpointed(sums.select("symbol", (F.col("_k") - F.col("_past") + F.col("_n")).alias("_k"), (F.shiftleft("_head", DIGIT) + F.col("_digit")).alias("_head")))
    return found.select("symbol", F.col("_head").alias(x))


def median_steps(df: DataFrame, parts: int | None = None) -> DataFrame:
    """As ``align.median_steps``, for few and very long series: steps inside range partitions and over their borders, then a
    selection by counts."""
    times = df.select("symbol", F.col("ts").cast("timestamp").alias("ts"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(times.where("ts IS NOT NULL").repartitionByRange(parts, "symbol", "ts").withColumn("_part", F.spark_partition_id()))
    ends = dealt.groupBy("symbol", "_part").agg(F.max("ts").alias("_end"))
    past = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "_part", F.max("_end").over(past).alias("_before"))
    own = F.lag("ts").over(Window.partitionBy("symbol", "_part").orderBy("ts"))
    rows = dealt.withColumn("_own", own).join(ends, ["symbol", "_part"])
    step = F.unix_millis("ts") - F.unix_millis(F.coalesce("_own", "_before"))
    return selected(rows.select("symbol", step.alias("step")).where("step > 0"), "step", lambda n: F.floor(n / 2))


def with_halo(df: DataFrame, size: int, back: int, ahead: int = 0) -> DataFrame:
    """Rows with ``bucket`` and ``halo``; rows near a border come once more, as halo of the bucket beside it."""
    if max(back, ahead) > size:
        raise ValueError("a bucket must hold its halo")
    home = F.floor(F.col("idx") / size)
    place = F.col("idx") % size
    beside = [F.struct(home.alias("bucket"), F.lit(False).alias("halo"))]
    if back:
        beside.append(F.when(place >= size - back, F.struct((home + 1).alias("bucket"), F.lit(True).alias("halo"))))
    if ahead:
        beside.append(F.when((place < ahead) & (home > 0), F.struct((home - 1).alias("bucket"), F.lit(True).alias("halo"))))
    copies = df.withColumn("_b", F.explode(F.array_compact(F.array(*beside))))
    return copies.withColumns({"bucket": F.col("_b.bucket"), "halo": F.col("_b.halo")}).drop("_b")


def bucketed(df: DataFrame, make, size: int, back: int, ahead: int = 0) -> DataFrame:
    """``df`` (with ``idx``) with the columns that ``make(window)`` gives; ``make`` maps names to columns over the window.

    Equal to the same columns over whole series as long as they look no further than ``back`` rows back and ``ahead``
    rows ahead.
    """
    window = Window.partitionBy("symbol", "bucket").orderBy("idx")
    return with_halo(df, size, back, ahead).withColumns(make(window)).where(~F.col("halo")).drop("bucket", "halo")


def bucketed_average(df: DataFrame, x: str, out: str, n: int, size: int) -> DataFrame:
    def make(window) -> dict[str, Column]:
        f = window.rowsBetween(-(n - 1), 0)
        return {out: F.when(F.count(x).over(f) == n, F.avg(x).over(f))}

    return bucketed(df, make, size, n - 1)


def bucketed_volatility(df: DataFrame, x: str, out: str, n: int, size: int) -> DataFrame:
    def make(window) -> dict[str, Column]:
        f = window.rowsBetween(-(n - 1), 0)
        return {out: F.coalesce(F.when(F.count(F.lit(1)).over(f) == n, F.stddev_samp(x).over(f)), F.lit(0.0))}

    return bucketed(df, make, size, n - 1)


def bucketed_carry(df: DataFrame, x: str, out: str, size: int) -> DataFrame:
    """The last value of ``x`` at or before each row that is not null: inside buckets first, then from the buckets before."""
    rows = df.withColumn("bucket", F.floor(F.col("idx") / size))
    ends = rows.groupBy("symbol", "bucket").agg(F.max_by(x, F.when(F.col(x).isNotNull(), F.col("idx"))).alias("_end"))
    past = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "bucket", F.last("_end", ignorenulls=True).over(past).alias("_past"))
    own = F.last(x, ignorenulls=True).over(Window.partitionBy("symbol", "bucket").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(ends, ["symbol", "bucket"]).withColumn(out, F.coalesce("_own", "_past")).drop("bucket", "_own", "_past")


def asof_backward(master: DataFrame, other: DataFrame, columns: list[str], tolerance: timedelta | None = None, size: int = 1_000_000) -> DataFrame:
    """As ``align.asof_backward``, for few and very long series: both sides are dealt by time and carried in buckets of ``size`` rows."""
    value = F.struct(F.col("ts").alias("at"), *columns)
    left = master.select("symbol", F.struct("ts", F.lit(1).alias("side"), F.lit(None).cast(other.select(value.alias("v")).schema["v"].dataType).alias("value")).alias("ts"), F.struct(*master.columns).alias("_row"))
    right = without_nulls(other.select("symbol", "ts", *columns), *columns).select("symbol", F.struct("ts", F.lit(0).alias("side"), value.alias("value")).alias("ts"))
    both = with_index(left.unionByName(right, allowMissingColumns=True)).withColumn("_value", F.col("ts.value"))
    seen = bucketed_carry(both, "_value", "_seen", size).where("ts.side = 1")
    if tolerance is not None:
        limit = F.make_dt_interval(secs=F.lit(tolerance.total_seconds()))
        seen = seen.withColumn("_seen", F.when(F.col("ts.ts") - F.col("_seen.at") <= limit, F.col("_seen")))
    return seen.select("_row.*", *[F.col(f"_seen.{c}").alias(c) for c in columns])


def bucketed_repair(df: DataFrame, x: str, out: str, size: int) -> DataFrame:
    """Null and non-finite values repaired as in whole series: inside buckets first, then from the buckets before, or with
    the first finite value of the series where none is before."""
    rows = df.withColumn("bucket", F.floor(F.col("idx") / size)).withColumn("_f", finite(F.col(x)))
    ends = rows.groupBy("symbol", "bucket").agg(F.max_by("_f", F.when(F.col("_f").isNotNull(), F.col("idx"))).alias("_end"), F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("idx"))).alias("_start"))
    back = F.last("_f", ignorenulls=True).over(Window.partitionBy("symbol", "bucket").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_back", back).join(ends.select("symbol", "bucket", _before("bucket").alias("_past")), ["symbol", "bucket"])
    return both.withColumn(out, F.coalesce("_back", "_past")).drop("bucket", "_f", "_back", "_past")


def _before(place: str) -> Column:
    """What comes into a part of a series: the last ``_end`` of the parts before, else the first ``_start`` of all, else 0."""
    order = Window.partitionBy("symbol").orderBy(place)
    past = F.last("_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(past, F.first("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))


def ranges(df: DataFrame, rows: int = 2_000_000) -> int:
    """Range partitions for ``df``: those of the session, more where they held more than ``rows`` rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def repaired(df: DataFrame, x: str, out: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """``columns`` and ``out``, the repaired ``x``, as ``bucketed_repair``, from rows ``(symbol, ts, ...)`` without ``idx``.

    Rows are dealt by ranges of (symbol, ts) and sorted once.  A task carries the last finite value along its rows and tells
    the first and the last one of every run of a symbol; they are written once, and rows before the first one of their run
    are then completed from the runs before, a row each.
    """
    spark, folder = df.sparkSession, f"{scratch(df.sparkSession, 'repaired')}/rows"
    kept = list(dict.fromkeys(["symbol", *columns]))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [k.alias(f"_key{i}") for i, k in enumerate(_order(df))]
    order = ["symbol", *(f"_key{i}" for i in range(len(keys)))]
    dealt = df.select(*keys, finite(F.col(x)).alias("_f"), *kept).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select(*kept, "_f", F.spark_partition_id().alias("_part"))
    fields = [StructField(f.name, f.dataType) for f in dealt.drop("_f").schema]
    extra = [StructField("_out", DoubleType()), StructField("_start", DoubleType()), StructField("_end", DoubleType()), StructField("_run", BooleanType())]
    dealt.mapInArrow(_carried, StructType([*fields, *extra])).write.parquet(folder)
    written = spark.read.schema(StructType([*fields, *extra])).parquet(folder)
    rows, runs = written.where("_run IS NULL"), written.where("_run").select("symbol", "_part", "_start", "_end")
    into = runs.select(F.col("symbol").alias("_symbol"), F.col("_part").alias("_at"), _before("_part").alias("_into"))
    done = rows.where("_out IS NOT NULL").select(*columns, F.col("_out").alias(out))
    left = rows.where("_out IS NULL").join(into, (F.col("_part") == F.col("_at")) & F.col("symbol").eqNullSafe(F.col("_symbol")))
    return done.unionByName(left.select(*columns, F.col("_into").alias(out)))


def _order(df: DataFrame) -> list[Column]:
    """The order of ``ts`` by its fields, if it has some, as a struct is slow to compare as a whole."""
    ts, kind = F.col("ts"), df.schema["ts"]
    if not isinstance(kind.dataType, StructType):
        return [ts]
    return [*(ts.getField(f.name) for f in kind.dataType), *([ts.isNotNull()] if kind.nullable else [])]


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with ``_out``, the last ``_f`` of their symbol at or before them, and a row ``_run`` for every run of a symbol."""
    empty, run = None, None  # of the run at hand: symbol, part, first and last value
    nan = float("nan")

    def ends(runs: list[list]) -> pa.RecordBatch:
        columns = {f.name: pa.nulls(len(runs), f.type) for f in empty.schema if f.name != "_f"}
        symbols, numbers, starts, lasts = zip(*runs)
        columns |= {"symbol": pa.array(symbols, empty.schema.field("symbol").type), "_part": pa.array(numbers, empty.schema.field("_part").type), "_out": pa.nulls(len(runs), pa.float64())}
        known = lambda values: pa.array(values, pa.float64(), from_pandas=True)
        return pa.RecordBatch.from_pydict(columns | {"_start": known(starts), "_end": known(lasts), "_run": pa.array([True] * len(runs))})

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        empty = batch.slice(0, 0)
        symbols = pc.dictionary_encode(batch.column("symbol"), null_encoding="encode")
        starts = np.flatnonzero(np.diff(symbols.indices.to_numpy(), prepend=-1))
        names = symbols.dictionary.take(symbols.indices.take(pa.array(starts))).to_pylist()
        part = batch.column("_part")[0].as_py()
        f = batch.column("_f").to_numpy(zero_copy_only=False)
        own = np.maximum.accumulate(np.where(np.isnan(f), -1, np.arange(n)))
        filled = np.where(own >= np.repeat(starts, np.diff(starts, append=n)), f[own], nan)
        over = []
        for name, a, b in zip(names, starts.tolist(), [*starts[1:].tolist(), n]):
            if run is None or a or name != run[0]:
                if run is not None:
                    over.append(run)
                run = [name, part, nan, nan]
            values = f[a:b]
            missing = np.isnan(values)
            if run[3] == run[3]:
                filled[a:b] = np.where(np.isnan(filled[a:b]), run[3], filled[a:b])
            if not missing.all():
                if run[2] != run[2]:
                    run[2] = float(values[missing.argmin()])
                run[3] = float(values[b - a - 1 - missing[::-1].argmin()])
        columns = {f.name: batch.column(f.name) for f in batch.schema if f.name != "_f"}
        none = pa.nulls(n, pa.float64())
        yield pa.RecordBatch.from_pydict(columns | {"_out": pa.array(filled, pa.float64(), from_pandas=True), "_start": none, "_end": none, "_run": pa.nulls(n, pa.bool_())})
        if over:
            yield ends(over)
    if run is not None:
        yield ends([run])
