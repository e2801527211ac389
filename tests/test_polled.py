"""Records without a schema, and replies that are polled: as a table, as a stream, for a duration, and started again."""

import json
import time

from pyspark.sql import functions as F

from tidemark.sources import polled
from tidemark.sources.bars import inferred_schema, records_without_schema
from tidemark.streaming import live


def test_schema_comes_from_all_records(spark):
    replies = [
        (1, '{"k": 1, "at": {"day": "x", "hours": [1, 2]}, "VOID": null}'), (2, '[{"k": 2.5, "b c": true}, {"k": null, "mixed": "text"}, 7]'), (3, None), (4, "no json"), (5, "[]"),
        (6, '  {"mixed": 12, "at": {"hours": [3.5]}, "i": "clash"}'), (7, '{"VARIANT": "OBJECT<x: VOID>"}'), (8, "[1, 2]"), (9, '{"mixed": {"a": 1}}'),
    ]
    df = spark.createDataFrame(replies, "i int, reply string").repartition(3)
    got = records_without_schema(df, "reply")
    types = dict(got.dtypes)
    assert types == {"i": "int", "VARIANT": "string", "VOID": "string", "at": "struct<day:string,hours:array<double>>", "b c": "boolean", "reply_i": "string", "k": "double", "mixed": "string"}
    rows = sorted(got.collect(), key=lambda r: (r.i, str(r.k)))
    assert [(r.i, r.k, r.mixed, r["b c"], r.reply_i) for r in rows] == [(1, 1.0, None, None, None), (2, 2.5, None, True, None), (2, None, "text", None, None), (6, None, "12", None, "clash"), (7, None, None, None, None), (9, None, '{"a":1}', None, None)]
    assert rows[0]["at"].hours == [1.0, 2.0] and rows[3]["at"].day is None and rows[4].VARIANT == "OBJECT<x: VOID>"
    assert inferred_schema(df.where("i IN (3, 4, 5, 8)"), "reply") is None and records_without_schema(df.where("i = 8"), "reply").columns == ["i"]
    assert records_without_schema(df.limit(0), "reply").count() == 0


def put(folder, ticker, name, *records):
    path = folder / f"ticker={ticker}"
    path.mkdir(parents=True, exist_ok=True)
    (path / ".part").write_text("not complete")
    (path / name).write_text("\n".join(json.dumps(r) for r in records))


def test_filters_leave_out_tickers(spark, tmp_path):
    polled.use_polled(spark)
    for ticker in ("a", "b", "c d"):
        put(tmp_path, ticker, "1.json", {"x": 1}, [{"x": 2}, {"x": 3}])
    table = spark.read.format(polled.FORMAT).option("path", f"file://{tmp_path}").load()
    assert table.count() == 6 and table.rdd.getNumPartitions() == 3
    some = table.where(F.col("ticker").isin("a", "x"))
    assert some.rdd.getNumPartitions() == 1 and table.where("ticker = 'c d'").rdd.getNumPartitions() == 1
    assert sorted(r.x for r in records_without_schema(some, "reply").collect()) == [1, 2, 3]
    assert table.where("ticker = 'x'").count() == 0
    assert spark.read.format(polled.FORMAT).option("path", f"file://{tmp_path}/none").load().count() == 0


def test_polls_for_a_duration_and_goes_on_where_it_stopped(spark, tmp_path):
    polled.use_polled(spark)
    folder, out, seen = tmp_path / "in", [], []

    def sink(batch, number):
        rows = [(r.ticker, r.file, r.reply) for r in batch.collect()]
        seen.append((number, rows))

    def stream(**options):
        return spark.readStream.format(polled.FORMAT).options(path=f"file://{folder}", **options).load()

    for i in range(4):
        put(folder, "a", f"{i:03}.json", {"i": i})
    began = time.time()
    live.run_live(stream(filesPerTrigger="1"), sink, f"{tmp_path}/state", "200 milliseconds", 12)
    assert 12 <= time.time() - began < 40
    put(folder, "a", "004.json", {"i": 4})
    put(folder, "b", "000.json", {"i": 5})
    live.run_to_end(stream(), sink, f"{tmp_path}/state")
    batches = dict(seen)  # a batch that was cut off comes again under its number
    out = [r for n in sorted(batches) for r in batches[n]]
    assert sorted((t, f) for t, f, _ in out) == [("a", f"{i:03}.json") for i in range(5)] + [("b", "000.json")]
    assert len(batches) > 3 and sorted(json.loads(r)["i"] for _, _, r in out) == list(range(6))
    before = len(seen)
    assert live.run_to_end(stream(), sink, f"{tmp_path}/state") == 0 and len(seen) == before
