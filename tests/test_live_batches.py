"""Live operators take micro-batches of bounded size, and give what one batch over the table gives."""

import duckdb
from test_registry import DATA, same

from tidemark.plans import live as plans
from tidemark.streaming import live

ROWS = 400


def test_batches_are_bounded_and_in_order(spark, tmp_path):
    total, sizes = spark.read.parquet(f"{DATA}/events.parquet").count(), []

    def sink(batch, number):
        rows = batch.select("ts").collect()
        sizes.append((len(rows), min(rows).ts, max(rows).ts))

    live.run_live(plans.ordered_stream(spark, DATA, ROWS), sink, f"{tmp_path}/state")
    assert sum(n for n, _, _ in sizes) == total and max(n for n, _, _ in sizes) <= ROWS and len(sizes) >= total / ROWS > 2
    assert all(a[2] <= b[1] for a, b in zip(sizes, sizes[1:]))


def test_small_batches_change_no_result(spark, monkeypatch):
    def queries():
        return plans.st4_rolling(spark, DATA).toPandas(), plans.st5_trades(spark, DATA).toPandas()

    whole = queries()
    small = plans.ordered_stream
    monkeypatch.setattr(plans, "ordered_stream", lambda spark, sf_dir: small(spark, sf_dir, ROWS))
    cut = queries()
    assert same(cut[0], whole[0]) and same(cut[1], whole[1]) and len(whole[1]) > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    assert same(cut[0], con.execute(plans.ORACLES["ST4_live_rolling"]).df())


def test_upserts_write_changes_only(spark, tmp_path):
    path, keys = f"file://{tmp_path}/table", ["k"]
    sink = live.upsert_into(path, keys, merge_every=3)
    rows = {}
    for number in range(7):
        batch = {(number * 2 + i) % 5: number for i in range(2)}
        rows |= batch
        df = spark.createDataFrame(list(batch.items()), "k long, v long")
        sink(df, number)
        if number == 4:
            sink(df, number)  # a batch that is run again
        assert spark.read.parquet(f"{path}/version={number}").count() == 2
        assert {r.k: r.v for r in live.newest(spark, path, keys).collect()} == rows
    assert spark.read.parquet(f"{path}/whole=5").count() == 5


def test_rolling_returns(spark, tmp_path):
    import math

    x = [10.0, 11.0, 0.0, 12.0, 13.0, 12.5, 14.0, 13.0]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "symbol string, i int, x double").selectExpr("symbol", "timestamp_seconds(i) AS ts", "x")
    for part in range(3):
        rows.where(f"unix_seconds(ts) BETWEEN {3 * part} AND {3 * part + 2}").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    live.use_rocksdb(spark)
    r = [None] + [math.log(b / a) if a > 0 and b > 0 else None for a, b in zip(x, x[1:])]
    for kind, wanted in (("log_return", r), ("return", [None, None] + [abs(a - b) / math.sqrt(2) * math.sqrt(252) if a is not None and b is not None else None for a, b in zip(r[1:], r[2:])])):
        out = []
        stream = live.live_source(spark, f"{tmp_path}/in/*", rows.schema, maxFilesPerTrigger="1")
        live.run_live(live.live_rolling(stream, "x", 2, kind), lambda df, _: out.extend(df.collect()), f"{tmp_path}/{kind}")
        got = [v.value for v in sorted(out, key=lambda v: v.ts)]
        assert all((a is None or a != a) == (b is None) and (b is None or abs(a - b) < 1e-9) for a, b in zip(got, wanted)), (got, wanted)


def test_late_rows_and_idle_symbols(spark, tmp_path):
    """Rows in any order inside the watermark give what ordered rows give; later ones are left out, idle symbols start anew."""
    from datetime import timedelta

    live.use_rocksdb(spark)
    batches = [[("a", 30), ("a", 10), ("b", 5)], [("a", 20), ("a", 40), ("b", 35)], [("a", 100)], [("a", 15), ("a", 95), ("b", 400)], [("end", 4000)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, t, float(t)) for s, t in rows], "symbol string, t int, x double").selectExpr("symbol", "timestamp_seconds(t) AS ts", "x").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    out = []
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = live.live_source(spark, f"{tmp_path}/in/*", schema, maxFilesPerTrigger="1")
    rolling = live.live_rolling(stream, "x", 2, late=timedelta(seconds=25), idle=timedelta(seconds=200))
    live.run_live(rolling, lambda df, _: out.extend(df.collect()), f"{tmp_path}/state")
    got = {s: [(r.x, r.value) for r in sorted((r for r in out if r.symbol == s), key=lambda r: r.ts)] for s in ("a", "b")}
    plain = lambda v: None if v is None or v != v else v
    assert [(x, plain(v)) for x, v in got["a"]] == [(10, None), (20, 15.0), (30, 25.0), (40, 35.0), (95, 67.5), (100, 97.5)]  # 15 comes too late
    assert [(x, plain(v)) for x, v in got["b"]] == [(5, None), (35, 20.0), (400, None)]  # forgotten between 35 and 400
