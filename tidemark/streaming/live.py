"""Live sources, bars, rolling calculations and the trade rule on streams.

Row-wise calculations need nothing here: the functions of the batch side work on streams as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.operators.calc import PERIOD
from tidemark.operators.trades import Rule
from tidemark.streaming.processors import InTime, OpenTrade, Packed, Rolling, pack


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful operators here keep lists per symbol, which need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_source(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", **options: str) -> DataFrame:
    """New files of a folder as a stream, with a declared schema."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def in_name_order(spark: SparkSession, folder: str) -> None:
    """Set the times of a folder's Parquet files in order of their names; a stream takes files in order of their times."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: sorted([(f.getPath().getName(), f.getModificationTime(), f.getPath()) for f in fs.listStatus(hadoop) if f.getPath().getName().endswith(".parquet")], key=lambda f: f[0])
    files = names()
    start = max((t for _, t, _ in files), default=0)
    for i, (_, _, path) in enumerate(files):
        fs.setTimes(path, start + 1000 * i, -1)
    times = [t for _, t, _ in names()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise OSError(f"{folder}: this storage keeps no times that are set")


def run_live(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, seconds: float | None = None, mode: str = "append") -> StreamingQuery:
    """Poll every interval for a duration; without an interval take what is there and end."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if every is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
    return query


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Start a query from its checkpoint until a start finds nothing new; the number of batches.

    A source without limits of its own takes one batch a start, and none after a batch that was cut off and is run again.
    """
    done = 0
    while True:
        before = done

        def counted(batch: DataFrame, number: int) -> None:
            nonlocal done
            sink(batch, number)
            done += 1

        run_live(df, counted, checkpoint)
        if done == before:
            return done


def live_bars(ticks: DataFrame, symbol: str, ts: str, price: str, every: str = "1 day", late: str = "1 hour", tiebreak: tuple[str, ...] = (), volume: str | Column | None = None) -> DataFrame:
    """Bars of tumbling windows; ticks that come later than ``late`` after the newest are left out."""
    size = F.lit(1) if volume is None else (F.col(volume) if isinstance(volume, str) else volume)
    rows = ticks.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("t"), F.col(price).cast("double").alias("price"), size.cast("double").alias("size"), *tiebreak)
    rows = rows.withWatermark("t", late).withColumn("at", F.struct("t", *tiebreak))
    bars = rows.groupBy("symbol", F.window("t", every).alias("w")).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


#: Rows without a time come last.
NO_TIME = (1 << 63) - 1


def _time(c: str) -> Column:
    return F.timestamp_micros(F.nullif(F.col(c), F.lit(NO_TIME)))


def _stateful(rows: DataFrame, ties: tuple[str, ...], processor, schema: str, late: timedelta | None, idle: timedelta | None) -> DataFrame:
    """A processor over packs of a symbol's rows: as they come, or in order of time behind a watermark."""
    if late is None and idle is not None:
        raise ValueError("symbols are forgotten by event time, which takes a watermark")
    if late is not None:
        rows = rows.where("ts IS NOT NULL").withWatermark("ts", f"{late.total_seconds()} seconds")
    rows = rows.withColumn("at_us", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME))).drop("ts")
    held = to_arrow_schema(rows.drop("symbol").schema)
    packs = rows.mapInArrow(pack, StructType([rows.schema["symbol"], StructField("pack", BinaryType())])).groupBy("symbol")
    if late is None:
        return packs.transformWithStateInPandas(Packed(processor, held, ties), schema, "Append", "None")
    inner = InTime(processor, held, ties, None if idle is None else int(idle.total_seconds() * 1000))
    return packs.transformWithStateInPandas(inner, schema, "Append", "EventTime")


def live_rolling(df: DataFrame, x: str, n: int = PERIOD, kind: str = "mean", late: timedelta | None = None, idle: timedelta | None = None, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """``(symbol, ts, x, value)``, row by row: rolling mean ("mean"), sample deviation with 0 before n rows ("std"), log
    return ("log_return"), or yearly deviation of n log returns, null unless all are there ("return").

    Without ``late`` rows of a symbol must come in order of time from batch to batch; inside a batch they are sorted.  With
    it they may come in any order, as late as that behind the newest; they come out once the watermark has passed them, and
    rows that come after later ones of their symbol came out are left out.  A symbol without rows for ``idle`` is forgotten.
    ``tiebreak`` names columns that order a symbol's rows of one time; rows without a time come last, with ``late`` not at all.
    """
    if kind not in ("mean", "std", "log_return", "return"):
        raise ValueError(f"no rolling calculation {kind}")
    symbol = df.schema["symbol"].dataType.simpleString()
    ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tiebreak)]
    rows = df.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col(x).cast("double").alias("x"), *ties)
    out = _stateful(rows, tuple(f"_tie{i}" for i in range(len(ties))), Rolling(n, kind), f"symbol {symbol}, at_us long, x double, value double", late, idle)
    return out.select("symbol", _time("at_us").alias("ts"), "x", "value")


def live_trades(signals: DataFrame, rule: Rule, late: timedelta | None = None, idle: timedelta | None = None, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """``(symbol, entry_ts, exit_ts, limit_ts)`` when a trade closes, from rows ``(symbol, ts, entry, exit, e0, x0)``.

    The batch rule looks forward only as far as its hold, so a state machine gives the same trades; one that is still
    open stays open, where a batch closes it on the last row.  ``late``, ``idle`` and ``tiebreak`` as in ``live_rolling``.
    """
    symbol = signals.schema["symbol"].dataType.simpleString()
    ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tiebreak)]
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("entry", "exit")]
    rows = signals.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *flags, *[F.col(c).cast("double").alias(c) for c in ("e0", "x0")], *ties)
    out = _stateful(rows, tuple(f"_tie{i}" for i in range(len(ties))), OpenTrade(rule.stop, rule.hold), f"symbol {symbol}, entry_us long, exit_us long, limit_us long", late, idle)
    return out.select("symbol", *[_time(f"{c}_us").alias(f"{c}_ts") for c in ("entry", "exit", "limit")])


def upsert_into(path: str, keys: list[str], notify: Callable[[int], None] | None = None, merge_every: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest version of every key in Parquet tables and says which batch is out.

    A batch writes its changed rows alone, as ``version=N``; every ``merge_every`` batches all rows so far are written
    together as ``whole=N``, after which older folders are not read any more.  Only complete folders count, so a batch
    that is run again leaves the same table.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark, base = batch.sparkSession, path.rstrip("/")
        batch.write.mode("overwrite").parquet(f"{base}/version={number}")
        if number % merge_every == merge_every - 1:
            newest(spark, path, keys, number).write.mode("overwrite").parquet(f"{base}/whole={number}")
        if notify:
            notify(number)

    return sink


def _complete(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the complete folders by kind."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"version": [], "whole": []}
    if files.exists(path_of(path)):
        for f in files.listStatus(path_of(path)):
            kind, _, number = f.getPath().getName().partition("=")
            if kind in out and files.exists(path_of(f.getPath(), "_SUCCESS")):
                out[kind].append(int(number))
    return out


def newest(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The table that ``upsert_into`` keeps: the row of the latest batch for every key."""
    found = _complete(spark, path)
    last = lambda numbers: [n for n in numbers if upto is None or n <= upto]
    whole = max(last(found["whole"]), default=-1)
    parts = [(whole, f"{path.rstrip('/')}/whole={whole}")] * (whole >= 0) + [(n, f"{path.rstrip('/')}/version={n}") for n in sorted(last(found["version"])) if n > whole]
    if not parts:
        raise FileNotFoundError(path)
    rows = [spark.read.parquet(p).select("*", F.lit(n).alias("_batch")) for n, p in parts]
    names = [c for c in rows[0].columns if c != "_batch"]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy(*keys).agg(F.max_by(F.struct(*names), "_batch").alias("_row")).select("_row.*")
