import random
from datetime import timedelta

import pytest
from series_help import START
from pyspark.sql import functions as F

from tidemark.operators import trades
from tidemark.streaming import live


def scan(rows, rule):
    """The rule by definition, one row after another: ``[(entry, exit, limit)]`` as row numbers."""
    close = lambda cols, t: len(cols) > 1 and all(a is not None and b is not None and abs(a - b) <= t for a, b in zip(cols, cols[1:]))
    found, free = [], 0
    for r, row in enumerate(rows):
        if r < free or not close(row[:2], rule.within_entry):
            continue
        free = r + max(rule.hold, 1)
        end = (min(r + rule.hold, len(rows) - 1), "exit")
        for k in range(r + 1, min(r + rule.hold, len(rows) - 1) + 1):
            if close(rows[k][2:], rule.within_exit):
                end = (k, "exit")
                break
            if rows[k][2] is not None and rows[k][2] < row[0] * (1 - rule.stop):
                end = (k, "limit")
                break
        found.append((r, *((end[0], None) if end[1] == "exit" else (None, end[0]))))
    last = {x: e for e, x, _ in found if x is not None}
    return [(e, x, li) for e, x, li in found if x is None or last[x] == e]


def rows_of(seed, n):
    r = random.Random(seed)
    return [tuple(None if r.random() < 0.03 else round(100 + 10 * r.gauss(0, 1), 2) for _ in range(4)) for _ in range(n)]


RULES = [(2.0, 1.0, 0.1, 10), (5.0, 0.1, 0.02, 3), (1.0, 1.0, 0.1, 0), (4.0, 0.0, 0.5, 400), (3.0, 2.0, 0.05, 1)]


@pytest.mark.parametrize(("entry", "exit", "stop", "hold"), RULES)
def test_trades_equal_a_plain_scan(frame, entry, exit, stop, hold):
    rule = trades.Rule(("p", "q"), entry, ("x", "y"), exit, stop, hold)
    data = {"a": rows_of(1, 120), "b": rows_of(2, 60), "c": rows_of(3, 1), "d": []}
    got = trades.find_trades(frame(data, ("p", "q", "x", "y")), rule).collect()
    day = lambda t: None if t is None else (t - START).days
    for symbol, rows in data.items():
        assert sorted((day(t.entry_ts), day(t.exit_ts), day(t.limit_ts)) for t in got if t.symbol == symbol) == sorted(scan(rows, rule), key=lambda t: t[0]), symbol
    assert len({t.id for t in got}) == len(got)


@pytest.mark.parametrize("batch", [1, 7])
def test_the_last_pick_is_carried_over_batches(spark, frame, batch):
    data = {s: rows_of(k, n) for k, (s, n) in enumerate([("a", 90), ("b", 1), ("c", 40), (None, 30), ("d", 33)])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for entry, exit, stop, hold in RULES:
            rule = trades.Rule(("p", "q"), entry, ("x", "y"), exit, stop, hold)
            got = trades.find_trades(frame(data, ("p", "q", "x", "y")), rule).collect()
            for symbol, rows in data.items():
                own = sorted((t.entry_idx, t.close_idx) for t in got if t.symbol == symbol)
                assert own == sorted((e, li if x is None else x) for e, x, li in scan(rows, rule)), symbol
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_walk_shuffles_rows_once(frame):
    df = frame({"a": rows_of(1, 50), "b": rows_of(2, 50)}, ("p", "q", "x", "y"))
    rows = trades.with_picks(trades.signals(df, trades.Rule(("p", "q"), 2.0, ("x", "y"), 1.0, 0.1, 5)).drop("n"), "entry", 5, ("idx", "ts", "e0"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_doubling_gives_the_same_picks(spark):
    r = random.Random(4)
    rows = [(s, i) for s in "abc" for i in sorted(r.sample(range(400), 150))]
    df = spark.createDataFrame(rows, "symbol string, idx long")
    for step in (1, 7, 500):
        assert sorted(trades.greedy_picks(df, step).collect()) == sorted(trades.greedy_picks_by_doubling(df, step).collect())


def test_trades_by_doubling_are_the_same(frame):
    df = frame({"a": rows_of(1, 120), "b": rows_of(2, 60), "c": rows_of(3, 1)}, ("p", "q", "x", "y"))
    for entry, exit, stop, hold in RULES[:3]:
        rule = trades.Rule(("p", "q"), entry, ("x", "y"), exit, stop, hold)
        a, b = (sorted(map(str, trades.find_trades(df, rule, picks=p).collect())) for p in ("walk", "doubling"))
        assert a == b and a
    with pytest.raises(ValueError):
        trades.find_trades(df, rule, picks="other")


@pytest.mark.parametrize("how", ["exact", "position", "asof"])
def test_trades_over_two_frames(frame, how):
    rows = rows_of(5, 80)
    whole = frame({"a": rows}, ("p", "q", "x", "y"))
    one, two = whole.select("symbol", "ts", "p", "x"), whole.select("symbol", "ts", "q", "y")
    rule = trades.Rule(("one.p", "two.q"), 3.0, ("one.x", "two.y"), 1.0, 0.1, 9)
    joined, own = trades.over_frames({"one": one, "two": two}, rule, how, timedelta(0) if how == "asof" else None)
    got = sorted((t.entry_idx, t.close_idx) for t in trades.find_trades(joined, own).collect())
    wanted = scan(rows, trades.Rule(("p", "q"), 3.0, ("x", "y"), 1.0, 0.1, 9))
    if how != "asof":  # an as-of join leaves out nulls of a column before it carries values
        assert got == sorted((e, li if x is None else x) for e, x, li in wanted)
    assert got and joined.columns == ["symbol", "ts", "E0", "E1", "X0", "X1"]
    paired, _ = trades.over_frames({"one": one, "two": two.withColumn("symbol", F.lit("b"))}, rule, "position", pair="a/b")
    assert {r.symbol for r in paired.collect()} == {"a/b"} and paired.count() == 80
    with pytest.raises(ValueError, match="no such column"):
        trades.over_frames({"one": one}, rule)


def test_long_lists_of_deltas_are_cut(spark):
    results = spark.createDataFrame([("a", i, float(i)) for i in range(1, 8)] + [("b", 1, 5.0)], "symbol string, trade_no int, delta double")
    got = {(r.symbol, r.chunk): r.deltas for r in trades.delta_lists(results, 3).collect()}
    assert got == {("a", 0): [1.0, 2.0, 3.0], ("a", 1): [4.0, 5.0, 6.0], ("a", 2): [7.0], ("b", 0): [5.0]}


def test_rules_are_checked():
    for bad in ((("p",), ("x",), 1), (("p", "q"), (), 1), (("p", "q"), ("x",), -1)):
        with pytest.raises(ValueError):
            trades.Rule(bad[0], 1.0, bad[1], 1.0, 0.1, bad[2])


def test_summary_and_boxes(spark, frame):
    base = frame({"a": [(10.0, 1.0), (14.0, 1.0), (8.0, 1.0), (8.0, 1.0)]}, ("open", "z"))
    days = [r.ts for r in base.orderBy("ts").collect()]
    found = spark.createDataFrame([("a", "t1", days[0], days[1], None), ("a", "t2", days[1], None, days[2]), ("a", "t3", days[2], days[3], None)], "symbol string, id string, entry_ts timestamp, exit_ts timestamp, limit_ts timestamp")
    results = trades.trade_results(found, base)
    assert [(r.trade_no, r.delta, r.stopped) for r in results.orderBy("trade_no").collect()] == [(1, 4.0, False), (2, -6.0, True), (3, 0.0, False)]
    s = trades.trade_summary(results).first()
    assert (s.total_trades, s.win_rate) == (3, 50.0)
    assert abs(s.avg_win_per_1000 - 0.04 / 3) < 1e-12 and abs(s.avg_loss_per_1000 + 0.084 / 3) < 1e-12
    assert trades.delta_lists(results).first().deltas == [4.0, -6.0, 0.0]
    box = trades.trade_boxes(found, base, 0.1).where("id = 't2'").first()
    assert [p.y for p in box.profit_box] == [8.0, 8.0, 14.0, 14.0] and [round(p.y, 6) for p in box.stop_box] == [14.0, 14.0, 12.6, 12.6]
    assert trades.trade_boxes(found, base.drop("open"), 0.1).count() == 0
    assert trades.trade_summary(results.limit(0)).collect() == []


def test_live_trades_equal_batch_for_closed_trades(spark, frame, tmp_path):
    rule = trades.Rule(("p", "q"), 4.0, ("x", "y"), 0.4, 0.05, 6)
    signals = trades.signals(frame({"a": rows_of(1, 90), "b": rows_of(2, 50)}, ("p", "q", "x", "y")), rule)
    wanted = trades.find_trades(frame({"a": rows_of(1, 90), "b": rows_of(2, 50)}, ("p", "q", "x", "y")), rule, drop_overwritten=False)
    last = {"a": 89, "b": 49}
    wanted = sorted((t.symbol, t.entry_ts, t.exit_ts or t.limit_ts) for t in wanted.collect() if t.close_idx < last[t.symbol])
    rows = signals.select("symbol", "ts", "entry", "exit", "e0", "x0")
    for part, (lo, hi) in enumerate([(0, 20), (20, 55), (55, 100)]):  # three files, one after the other
        rows.where(F.datediff("ts", F.lit(START)).between(lo, hi - 1)).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    live.use_rocksdb(spark)
    out = []
    stream = live.live_source(spark, f"{tmp_path}/in/*", rows.schema, maxFilesPerTrigger="1")
    live.run_live(live.live_trades(stream, rule), lambda df, _: out.extend(df.collect()), f"{tmp_path}/state")
    got = sorted((t.symbol, t.entry_ts, t.exit_ts or t.limit_ts) for t in out)
    closes = {(s, e): x for s, e, x in got}
    assert all(closes[s, e] == x for s, e, x in wanted) and len(got) - len(wanted) <= 4
