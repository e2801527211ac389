"""Registered queries of the streaming rows: each replays the events table as a stream to its end and returns what came out."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import storage
from tidemark.functions.scalar import near
from tidemark.operators import calc, trades
from tidemark.sources import polled
from tidemark.sources.bars import records_from_json
from tidemark.streaming import live


def scratch(spark: SparkSession) -> str:
    """A new folder in the storage that the cluster shares."""
    return storage.scratch(spark, "live")


def replayed(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now; a row set of append mode, or the last result of complete mode."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)

    def sink(batch: DataFrame, number: int) -> None:
        part = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(part)

    live.run_live(df, sink, f"{folder}/checkpoint", mode=mode)
    return spark.read.schema(df.schema).parquet(f"{folder}/out").select(*df.columns)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stream's path is a folder or a pattern; this pattern meets the one file
    return live.live_source(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


#: Rows of a micro-batch at most, where an operator takes a symbol's rows of a batch at once; the same, about, where rows come late.
BATCH_ROWS, LATE_ROWS = 500_000, 2_000_000
#: Files of a large micro-batch, so that as many tasks read it.
FILES = 8
#: What the live queries take of an event.
EVENT = ("event_id", "ts", "event_type", "value")


def ordered_stream(spark: SparkSession, sf_dir: str, rows: int = BATCH_ROWS) -> DataFrame:
    """The events as a stream in order of time, in micro-batches of at most ``rows`` rows, however large the table is.

    The rows are dealt by ranges of time and written as files whose names are in order of time; a batch takes as many
    files as hold ``rows`` rows if each were as large as the largest.
    """
    events, folder = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT), f"{scratch(spark)}/in"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, -(-events.count() // rows)))
    dealt = events.repartitionByRange(parts, "ts", "event_id").sortWithinPartitions("ts", "event_id")
    dealt.write.option("maxRecordsPerFile", max(1, rows // FILES)).parquet(folder)
    live.in_name_order(spark, folder)
    files = spark.read.schema(events.schema).parquet(folder).groupBy(F.col("_metadata.file_name")).count()
    largest = files.agg(F.max("count")).first()[0] or rows
    return live.live_source(spark, folder, events.schema, maxFilesPerTrigger=str(max(1, rows // largest)))


def shuffled_stream(spark: SparkSession, sf_dir: str, batches: int = 8) -> DataFrame:
    """The events as a stream in which each comes up to six hours too late, with a last row of no symbol far ahead, behind
    which the watermark passes all others; in ``batches`` batches, in more where these held more than ``LATE_ROWS`` rows."""
    events, folder = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), f"{scratch(spark)}/in"
    total, last = events.agg(F.count(F.lit(1)), F.unix_micros(F.max("ts"))).first()
    batches = max(batches, -(-total // LATE_ROWS))
    files = max(1, min(FILES, total // batches // 50_000))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), (F.timestamp_micros(F.lit(last).cast("long")) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600))
    rows = events.unionByName(end).withColumn("at", arrival)
    rows.repartitionByRange(batches * files, "at").drop("at").write.parquet(folder)
    live.in_name_order(spark, folder)
    return live.live_source(spark, folder, rows.drop("at").schema, maxFilesPerTrigger=str(files))


def _ticks(spark: SparkSession, sf_dir: str, stream=events_stream) -> DataFrame:
    return stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


def replies_of_events(spark: SparkSession, sf_dir: str) -> str:
    """The events as a service would reply: a folder per type, files by day, a record a line."""
    folder = f"{scratch(spark)}/replies"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    records = events.select(F.to_json(F.struct("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")).alias("value"), F.col("event_type").alias("ticker"), F.to_date("ts").alias("poll"))
    records.write.partitionBy("ticker", "poll").text(folder)
    return folder


def st1_polled(spark: SparkSession, sf_dir: str, every: str = "500 milliseconds", seconds: float = 2) -> DataFrame:
    """Replies polled every interval for a duration; the query then starts again from its checkpoint and takes the rest."""
    polled.use_polled(spark)
    replies, folder = replies_of_events(spark, sf_dir), scratch(spark)
    stream = lambda **o: spark.readStream.format(polled.FORMAT).options(path=replies, **o).load()
    rows = lambda df: records_from_json(df.select("ticker", "reply"), "reply", "event_id bigint, at bigint, value double").select(F.col("ticker").alias("symbol"), F.timestamp_micros("at").alias("ts"), "value", "event_id")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    live.run_live(rows(stream(filesPerTrigger="3")), sink, f"{folder}/checkpoint", every, seconds)
    last = rows(stream())
    live.run_to_end(last, sink, f"{folder}/checkpoint")
    return spark.read.schema(last.schema).parquet(f"{folder}/out").select(*last.columns)


#: What orders events of one time.
TIES = ("event_id",)
LIVE_RULE = trades.Rule(("value", "level"), 2.0, ("value", "goal"), 0.5, 0.5, 25)


def with_signals(ticks: DataFrame) -> DataFrame:
    """Rows that enter near 10 and leave near 20."""
    v = F.col("value")
    return ticks.select("symbol", "ts", "event_id", near([v, F.lit(10.0)], 2.0).alias("entry"), near([v, F.lit(20.0)], 0.5).alias("exit"), v.alias("e0"), v.alias("x0"))


def st1_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(_ticks(spark, sf_dir))


def st2_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = live.live_bars(events_stream(spark, sf_dir), "event_type", "ts", "value", tiebreak=("event_id",))
    return replayed(bars, "complete").select("symbol", "ts", "open", "high", "low", "close", "volume")


def st3_row_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ticks(spark, sf_dir).withColumns({"twice": calc.product(["value", 2]), "less": calc.difference("value", "10"), "part": calc.quotient("value", 4)})
    return replayed(rows).select("event_id", "twice", "less", "part")


def st4_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    return replayed(live.live_rolling(_ticks(spark, sf_dir, ordered_stream), "value", 14, tiebreak=TIES)).select("symbol", "ts", "x", F.round("value", 4).alias("value"))


def st4_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly volatility of log returns, row by row."""
    live.use_rocksdb(spark)
    return replayed(live.live_rolling(_ticks(spark, sf_dir, ordered_stream), "value", 14, "return", tiebreak=TIES)).select("symbol", "ts", "x", F.round("value", 4).alias("value"))


LATE = timedelta(hours=7)


def st4_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling mean of rows that come in another order than that of their times."""
    live.use_rocksdb(spark)
    out = live.live_rolling(_ticks(spark, sf_dir, shuffled_stream), "value", 14, late=LATE, idle=timedelta(days=20), tiebreak=TIES)
    return replayed(out).where("symbol IS NOT NULL").select("symbol", "ts", "x", F.round("value", 4).alias("value"))


def st5_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    return replayed(live.live_trades(with_signals(_ticks(spark, sf_dir, shuffled_stream)), LIVE_RULE, LATE, tiebreak=TIES)).where("symbol IS NOT NULL")


def st5_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    return replayed(live.live_trades(with_signals(_ticks(spark, sf_dir, ordered_stream)), LIVE_RULE, tiebreak=TIES))


def st6_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of every symbol, kept by upserts."""
    folder = scratch(spark)
    last = _ticks(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    live.run_live(last, live.upsert_into(f"{folder}/table", ["symbol"]), f"{folder}/checkpoint", mode="update")
    return live.newest(spark, f"{folder}/table", ["symbol"]).select("symbol", "ts", "value")


QUERIES = {"ST1_live_source": st1_source, "ST1_polled_source": st1_polled, "ST2_live_bars": st2_bars, "ST3_live_row_wise": st3_row_wise, "ST4_live_rolling": st4_rolling, "ST4_live_returns": st4_returns, "ST4_late_rows": st4_late, "ST5_late_rows": st5_late, "ST5_live_trades": st5_trades, "ST6_upserts": st6_newest}

ORACLES = {
    "ST1_live_source": "SELECT event_type AS symbol, ts, value, event_id FROM events",
    "ST1_polled_source": "SELECT event_type AS symbol, ts, value, event_id FROM events",
    "ST2_live_bars": """SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2""",
    "ST3_live_row_wise": "SELECT event_id, value * 2 AS twice, value - 10 AS less, value / 4 AS part FROM events",
    "ST4_live_rolling": """SELECT event_type AS symbol, ts, value AS x, round(CASE WHEN row_number() OVER w >= 14 THEN avg(value) OVER r END, 4) AS value
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts), r AS (PARTITION BY event_type ORDER BY ts ROWS 13 PRECEDING)""",
    "ST4_live_returns": """WITH r AS (
        SELECT event_type AS symbol, ts, value AS x, CASE WHEN value > 0 AND lag(value) OVER w > 0 THEN ln(value / lag(value) OVER w) END AS r FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)
      ) SELECT symbol, ts, x, round(CASE WHEN count(r) OVER n = 14 THEN stddev_samp(r) OVER n * sqrt(252) END, 4) AS value FROM r WINDOW n AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)""",
    "ST5_live_trades": """WITH RECURSIVE s AS MATERIALIZED (
        SELECT event_type AS symbol, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, abs(value - 10) <= 2 AS ent, abs(value - 20) <= 0.5 AS ext FROM events
      ), c AS MATERIALIZED (
        SELECT symbol, idx, min(idx) OVER (PARTITION BY symbol ORDER BY idx RANGE BETWEEN 25 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s WHERE ent
      ), p AS (
        SELECT symbol, min(idx) AS idx FROM c GROUP BY symbol
        UNION ALL
        SELECT c.symbol, c.nxt FROM p JOIN c ON c.symbol = p.symbol AND c.idx = p.idx WHERE c.nxt IS NOT NULL
      ), o AS (
        SELECT p.symbol, p.idx AS pick, s.ts AS entry_ts, s.value * 0.5 AS stop FROM p JOIN s USING (symbol, idx)
      ), k AS (
        SELECT o.symbol, o.pick, o.entry_ts, min(CASE WHEN s.ext OR (s.idx = o.pick + 25 AND NOT s.value < o.stop) THEN s.idx END) AS x, min(CASE WHEN s.value < o.stop THEN s.idx END) AS l
        FROM o JOIN s ON s.symbol = o.symbol AND s.idx > o.pick AND s.idx <= o.pick + 25 GROUP BY ALL
      )
      SELECT k.symbol, k.entry_ts, a.ts AS exit_ts, b.ts AS limit_ts FROM k
      LEFT JOIN s a ON a.symbol = k.symbol AND a.idx = k.x AND (k.l IS NULL OR k.x <= k.l) LEFT JOIN s b ON b.symbol = k.symbol AND b.idx = k.l AND (k.x IS NULL OR k.l < k.x)
      WHERE k.x IS NOT NULL OR k.l IS NOT NULL""",
    "ST6_upserts": "SELECT event_type AS symbol, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1",
}
ORACLES["ST4_late_rows"], ORACLES["ST5_late_rows"] = ORACLES["ST4_live_rolling"], ORACLES["ST5_live_trades"]
