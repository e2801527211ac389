"""Live operators hand packs of rows to their processors: what comes out is what a walk over ordered rows gives."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_registry import DATA

from tidemark.operators.trades import Rule
from tidemark.plans import live as plans
from tidemark.streaming import live

LATE, SECONDS = timedelta(seconds=60), 300


def streamed(spark, folder, rows, batches, schema):
    """Rows ``(symbol, second, id, ...)`` as a stream in which each comes up to 50 s too late, and a last one far ahead."""
    r = random.Random(len(rows))
    rows = sorted(rows, key=lambda row: row[1] + r.uniform(0, 50))
    size = -(-len(rows) // batches)
    for i, part in enumerate([*(rows[i : i + size] for i in range(0, len(rows), size)), [(None, 10_000, -1, *[None] * (len(rows[0]) - 3))]]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{folder}/in/{i}")
    schema = spark.read.parquet(f"{folder}/in/0").schema
    return live.live_source(spark, f"{folder}/in/*", schema, maxFilesPerTrigger="1")


def ran(df, folder):
    out = []
    query = live.run_live(df, lambda batch, _: out.extend(batch.where("symbol IS NOT NULL").collect()), f"{folder}/state")
    return out, max(p.stateOperators[0].numRowsTotal for p in query.recentProgress)


def walk(rows, stop, hold):
    out, entry, free = [], None, 0
    for i, (ts, ent, ext, e0, x0) in enumerate(rows):
        if entry is not None:
            kind = "exit" if ext else "limit" if x0 < e0_ * (1 - stop) else "exit" if i == entry + hold else None
            if kind:
                out.append((rows[entry][0], ts if kind == "exit" else None, ts if kind == "limit" else None))
                entry = None
        if entry is None and ent and i >= free:
            if hold:
                entry, e0_ = i, e0
            else:
                out.append((ts, ts, None))
            free = i + max(hold, 1)
    return out


@pytest.mark.parametrize(("hold", "stop"), [(0, 0.1), (6, 0.2), (2000, 0.9)])
def test_late_trades_wait_in_packs(spark, tmp_path, hold, stop):
    """Thousands of rows wait in a few packs; rows of one time are ordered by their id."""
    live.use_rocksdb(spark)
    r = random.Random(hold)
    rows = [(s, r.randrange(SECONDS), i, r.random() < 0.1, r.random() < 0.05, r.uniform(5, 10), r.uniform(5, 10)) for i, s in enumerate(["a"] * 2500 + ["b"] * 500 + ["c"])]
    stream = streamed(spark, tmp_path, rows, 4, "symbol string, ts long, id long, entry boolean, exit boolean, e0 double, x0 double")
    out, held = ran(live.live_trades(stream, Rule(("x", "y"), 1, ("x", "y"), 1, stop, hold), LATE, tiebreak=("id",)), tmp_path)
    seconds = lambda t: None if t is None else int(t.timestamp())
    for s in "abc":
        ordered = [(t, *rest) for _, t, _, *rest in sorted((row for row in rows if row[0] == s), key=lambda row: (row[1], row[2]))]
        assert sorted([(seconds(t.entry_ts), seconds(t.exit_ts), seconds(t.limit_ts)) for t in out if t.symbol == s], key=str) == sorted(walk(ordered, stop, hold), key=str)
    assert len(out) > (0 if hold > 100 else 100) and held <= 40


@pytest.mark.parametrize("kind", ["mean", "std", "return"])
def test_late_rolling_waits_in_packs(spark, tmp_path, kind):
    live.use_rocksdb(spark)
    r = random.Random(3)
    rows = [(s, r.randrange(SECONDS), i, r.uniform(1, 9)) for i, s in enumerate(["a"] * 1500 + ["b"] * 300 + ["c"] * 4)]
    stream = streamed(spark, tmp_path, rows, 4, "symbol string, ts long, id long, x double")
    out, held = ran(live.live_rolling(stream, "x", 5, kind, LATE, timedelta(seconds=290), ("id",)), tmp_path)
    plain = lambda v: None if v is None or v != v else round(v, 6)
    for s in "abc":
        x = pd.Series([x for _, _, _, x in sorted((row for row in rows if row[0] == s), key=lambda row: (row[1], row[2]))])
        wanted = {"mean": x.rolling(5).mean(), "std": x.rolling(5).std().fillna(0.0), "return": np.log(x / x.shift()).rolling(5).std() * np.sqrt(252)}[kind]
        key = lambda rows: sorted([(x, plain(v)) for x, v in rows], key=str)
        assert key((v.x, v.value) for v in out if v.symbol == s) == key(zip(x, wanted))
    assert held <= 40


def test_late_batches_grow_in_number(spark, tmp_path, monkeypatch):
    """Of a larger table more batches are made, not larger ones."""
    monkeypatch.setattr(plans, "LATE_ROWS", 40)
    total, sizes = spark.read.parquet(f"{DATA}/events.parquet").count(), []
    live.run_live(plans.shuffled_stream(spark, DATA), lambda batch, _: sizes.append(batch.count()), f"{tmp_path}/state")
    assert sum(sizes) == total + 1 and len(sizes) > 20 and max(sizes) <= 80


def test_ordered_batches_are_even_and_narrow(spark, tmp_path):
    """Batches are as many as their bound asks for, of several files each, with the columns that are used."""
    total, rows, sizes = spark.read.parquet(f"{DATA}/events.parquet").count(), 160, []
    stream = plans.ordered_stream(spark, DATA, rows)
    assert set(stream.columns) == {"event_id", "ts", "event_type", "value"}
    live.run_live(stream, lambda batch, _: sizes.append((batch.count(), batch.select(F.input_file_name()).distinct().count())), f"{tmp_path}/state")
    assert sum(n for n, _ in sizes) == total and max(n for n, _ in sizes) <= rows
    assert len(sizes) <= -(-total // rows) and max(files for _, files in sizes) == plans.FILES


def test_waiting_symbols_take_rows_behind_the_watermark(spark, tmp_path):
    """Nothing of them has come out yet, so a row behind the watermark is still in order; one before what came out is not."""
    live.use_rocksdb(spark)
    batches = [[("a", 100)], [("a", 50), ("a", 400)], [("a", 60), ("a", 1000)], [("a", 45)], [("end", 5000)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, t, float(t)) for s, t in rows], "symbol string, t int, x double").selectExpr("symbol", "timestamp_seconds(t) AS ts", "x").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema, out = spark.read.parquet(f"{tmp_path}/in/0").schema, []
    stream = live.live_source(spark, f"{tmp_path}/in/*", schema, maxFilesPerTrigger="1")
    rolling = live.live_rolling(stream, "x", 2, late=timedelta(seconds=25), idle=timedelta(seconds=200))
    live.run_live(rolling, lambda df, _: out.extend(df.where("symbol = 'a'").collect()), f"{tmp_path}/state")
    plain = lambda v: None if v is None or v != v else v
    assert [(r.x, plain(r.value)) for r in sorted(out, key=lambda r: r.ts)] == [(50, None), (100, 75.0), (400, None), (1000, None)]
