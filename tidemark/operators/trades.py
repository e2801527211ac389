"""Back-test of one entry and exit rule over aligned frames.

An entry is a row whose entry columns lie close together.  Entries are taken greedily: after one at row r the next is at
row r + max(hold, 1) or later.  A trade closes at the first row of r + 1 ... r + hold where its exit columns lie close
together (exit) or its first exit column is under the stop (limit); failing that, at row min(r + hold, last row) (exit).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clean import series
from tidemark.functions.scalar import near
from tidemark.functions.storage import checkpointed
from tidemark.operators import long_series
from tidemark.operators.align import align_asof, align_exact, align_position, open_prices

TRADES = "symbol, id, entry_ts, exit_ts, limit_ts"


@dataclass(frozen=True)
class Rule:
    """Columns and thresholds of entry and exit, stop as a share of the entry price, hold in rows, and the kind of trade."""

    entry: tuple[str, ...]
    within_entry: float
    exit: tuple[str, ...]
    within_exit: float
    stop: float
    hold: int
    trade_type: str = "stock"

    def __post_init__(self) -> None:
        if self.hold < 0:
            raise ValueError("hold is a number of rows, 0 or more")
        if len(self.entry) < 2 or not self.exit:
            raise ValueError("a rule has two entry columns and one exit column at least")
        if self.trade_type not in ("stock", "option_call", "option_put"):
            raise ValueError(f"no trade type {self.trade_type}")

    @property
    def step(self) -> int:
        return max(self.hold, 1)


def signals(frame: DataFrame, rule: Rule, indexed: bool = False) -> DataFrame:
    """``(symbol, ts, idx, n, entry, exit, e0, x0)``: both signals and the two prices that stops compare, for every row.

    A frame that is ``indexed`` has its ``idx`` already; no window is laid over its series then, and ``n`` is left out.
    """
    d = lambda names: [F.col(c).cast("double") for c in names]
    place = [F.col("idx").cast("long").alias("idx")] if indexed else [(F.row_number().over(series()) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n")]
    return frame.select(
        "symbol", "ts", *place,
        near(d(rule.entry), rule.within_entry).alias("entry"), near(d(rule.exit), rule.within_exit).alias("exit"), d(rule.entry)[0].alias("e0"), d(rule.exit)[0].alias("x0"),
    )


def with_picks(rows: DataFrame, wanted: str, step: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (with symbol and idx), ``pick``: whether a row where ``wanted`` holds is taken, when each pick shuts out the
    ``step`` - 1 rows after it, and ``last_<column>``: the columns ``keep`` of the last pick before the row, null before the first.

    ``rows`` must come with each symbol in one partition, in order of idx, as a window over the series leaves them: they are
    not shuffled again.  A pick depends on the one before, so a symbol's wanted rows are walked in order; all else works on
    whole batches.  A task holds a batch and the last pick, however long a series is.
    """
    schema = T.StructType([*rows.schema, T.StructField("pick", T.BooleanType()), *[T.StructField(f"last_{c}", rows.schema[c].dataType) for c in keep]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, free, held = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.flatnonzero(batch.column(wanted).fill_null(False).to_numpy(zero_copy_only=False))
            own = batch.take(pa.array(at))
            pick = np.zeros(n, dtype=bool)
            for k, s, i in zip(at.tolist(), own.column("symbol").to_pylist(), own.column("idx").to_pylist()):
                if s != symbol:
                    symbol, free = s, i
                if i >= free:
                    pick[k] = True
                    free = i + step
            columns = [*batch.columns, pa.array(pick)]
            if keep:
                place, code = np.arange(n), batch.column("symbol").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                begin = np.maximum.accumulate(np.where(np.concatenate([[False], code[1:] != code[:-1]]), place, 0))
                before = np.concatenate([[-1], np.maximum.accumulate(np.where(pick, place, -1))[:-1]])
                goes_on = held is not None and held.column("symbol")[0].as_py() == batch.column("symbol")[0].as_py()
                inside = before >= begin
                source = pa.array(np.where(inside, before, n), mask=~(inside | (goes_on & (begin == 0))))
                carried = batch.slice(0, 1) if held is None else held
                columns += [pa.concat_arrays([batch.column(c), carried.column(c)]).take(source) for c in keep]
                if pick.any():
                    held = batch.take(pa.array(np.flatnonzero(pick)[-1:]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(walk, schema)


def greedy_picks(candidates: DataFrame, step: int) -> DataFrame:
    """Of rows ``(symbol, idx)``, those that are taken."""
    rows = candidates.select("symbol", F.col("idx").cast("long").alias("idx"), F.lit(True).alias("wanted"))
    return with_picks(rows.repartition("symbol").sortWithinPartitions("symbol", "idx"), "wanted", step).where("pick").select("symbol", "idx")


def greedy_picks_by_doubling(candidates: DataFrame, step: int) -> DataFrame:
    """The same picks for few very long series: pointers to the next pick are doubled until they leave the series.

    Every round is a pair of joins on (symbol, idx), spread over all rows; the number of rounds is the logarithm of the
    longest chain.  Reached rows are checkpointed per round.
    """
    ahead = Window.partitionBy("symbol").orderBy("idx").rangeBetween(step, Window.unboundedFollowing)
    jump = candidates.select("symbol", "idx", F.min("idx").over(ahead).alias("to"))
    reached = candidates.groupBy("symbol").agg(F.min("idx").alias("idx"))
    while True:
        jump = checkpointed(jump.where("to IS NOT NULL"))
        if jump.isEmpty():
            return reached
        on = jump.join(reached, ["symbol", "idx"], "left_semi").select("symbol", F.col("to").alias("idx"))
        reached = checkpointed(reached.unionByName(on).distinct())
        jump = jump.alias("a").join(jump.alias("b"), (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.to") == F.col("b.idx"))).select("a.symbol", "a.idx", "b.to")


def greedy_picks_by_transitions(candidates: DataFrame, step: int, size: int = 100_000) -> DataFrame:
    """The same picks for few very long series, in one pass: each bucket of ``size`` rows is a function of the first free row.

    Where a bucket is entered with its first ``o`` rows shut out, 0 <= o < step, it is left with as many rows of the next one
    shut out as its last pick says.  Buckets work these functions out apart from each other; one walk over them (a few
    numbers a bucket) tells how each is entered; then all buckets pick at once.  No loop, and no task holds a series.
    """
    size = max(size, step)
    symbol = candidates.schema["symbol"].dataType.simpleString()
    rows = candidates.select("symbol", F.col("idx").cast("long").alias("idx"), F.floor(F.col("idx") / size).cast("long").alias("bucket"))

    def function(part: pa.Table) -> pa.Table:
        at = np.sort(part.column("idx").to_numpy()) - part.column("bucket")[0].as_py() * size
        following = np.searchsorted(at, at + step).tolist()
        leave = [0] * len(at)
        for i in range(len(at) - 1, -1, -1):
            leave[i] = leave[following[i]] if following[i] < len(at) else max(0, int(at[i]) + step - size)
        few = int(np.searchsorted(at, step)) + 1  # who may come first, whatever is shut out
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (at[:few].tolist(), leave[:few])]
        return pa.table([part.column("symbol")[:1], part.column("bucket")[:1], *lists], names=["symbol", "bucket", "first", "leave"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shut, after = None, 0, 0
        for batch in batches:
            out = []
            for s, b, first, leave in zip(*(batch.column(c).to_pylist() for c in ("symbol", "bucket", "first", "leave"))):
                if s != known or b != after:  # a bucket without candidates lets all through
                    shut = 0
                out.append(shut)
                k = bisect_left(first, shut)
                known, after, shut = s, b + 1, leave[k] if k < len(first) else 0
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("bucket"), pa.array(out, pa.int64())], names=["symbol", "bucket", "shut"])

    def pick(part: pa.Table) -> pa.Table:
        at, free, taken = np.sort(part.column("idx").to_numpy()), part.column("bucket")[0].as_py() * size + part.column("shut")[0].as_py(), []
        while (k := int(np.searchsorted(at, free))) < len(at):
            taken.append(int(at[k]))
            free = taken[-1] + step
        own = part.column("symbol")
        return pa.table([own.take(pa.array([0] * len(taken), pa.int64())), pa.array(taken, pa.int64())], names=["symbol", "idx"])

    functions = rows.groupBy("symbol", "bucket").applyInArrow(function, f"symbol {symbol}, bucket long, first array<long>, leave array<long>")
    entered = functions.repartition("symbol").sortWithinPartitions("symbol", "bucket").mapInArrow(walk, f"symbol {symbol}, bucket long, shut long")
    return rows.join(entered, ["symbol", "bucket"]).groupBy("symbol", "bucket").applyInArrow(pick, f"symbol {symbol}, idx long")


def over_frames(frames: dict[str, DataFrame], rule: Rule, how: str = "exact", tolerance: timedelta | None = None, pair: str | None = None) -> tuple[DataFrame, Rule]:
    """One frame and its rule from a rule whose columns lie in several frames, named "frame.column".

    ``how``: "exact" joins equal times, "asof" carries values forward on the finest timeline within ``tolerance``,
    "position" sets row i beside row i.  Frames of one symbol each, of different symbols, are joined under the name ``pair``.
    """
    if pair is not None:
        frames = {name: df.withColumn("symbol", F.lit(pair)) for name, df in frames.items()}
    found = []
    for side, columns in (("E", rule.entry), ("X", rule.exit)):
        for i, name in enumerate(columns):
            frame, _, column = name.partition(".")
            if frame not in frames or column not in frames[frame].columns:
                raise ValueError(f"no such column: {name}")
            found.append((frames[frame], column, f"{side}{i}"))
    if how == "asof":
        if tolerance is None:
            raise ValueError("an as-of join takes a tolerance")
        joined = align_asof(found, tolerance)
    else:
        joined = {"exact": align_exact, "position": align_position}[how](found)
    names = [alias for _, _, alias in found]
    k = len(rule.entry)
    return joined, replace(rule, entry=tuple(names[:k]), exit=tuple(names[k:]))


def find_trades(frame: DataFrame, rule: Rule, drop_overwritten: bool = True, picks: str = "walk", size: int = 100_000) -> DataFrame:
    """``(symbol, id, trade_type, entry_ts, exit_ts, limit_ts, entry_idx, close_idx)``, a row per trade.

    Picks are ``hold`` rows apart at least, so each row can close one trade at most: the last pick before it.  A row is
    handed to the trade it can close and, if it is a pick, to its own; trades are then one aggregate over (symbol, pick).
    The frame is computed once.  Of exits on one row (the last of a series) the later trade's stays.

    ``picks``: "walk" streams each symbol's rows through one task, for many symbols, by the one shuffle that numbers them; "doubling" spreads the choice of entries
    over all tasks, for few symbols with very long series; "transitions" spreads all work so: rows are numbered by ranges,
    entries chosen and trades closed in buckets, and no window is laid over a series.
    """
    opened = F.struct("idx", "ts", (F.col("e0") * (1 - F.lit(rule.stop))).alias("stop"))
    last = F.last(F.when(F.col("pick"), opened), ignorenulls=True)
    if picks == "transitions":
        rows = checkpointed(signals(long_series.with_index(frame), rule, indexed=True))
        taken = greedy_picks_by_transitions(rows.where("entry").select("symbol", "idx"), rule.step, size).withColumn("pick", F.lit(True))
        rows = rows.join(taken, ["symbol", "idx"], "left").withColumn("pick", F.coalesce("pick", F.lit(False)))
        # a pick closes within its hold, so a bucket looks that far back
        held = long_series.bucketed(rows, lambda w: {"last": last.over(w.rowsBetween(Window.unboundedPreceding, -1))}, max(size, rule.hold), rule.hold)
    elif picks == "doubling":
        rows = checkpointed(signals(frame, rule).drop("n"))
        taken = greedy_picks_by_doubling(rows.where("entry").select("symbol", "idx"), rule.step).withColumn("pick", F.lit(True))
        rows = rows.join(taken, ["symbol", "idx"], "left").withColumn("pick", F.coalesce("pick", F.lit(False)))
    elif picks == "walk":
        rows = with_picks(signals(frame, rule).drop("n"), "entry", rule.step, ("idx", "ts", "e0"))
        given = F.struct(F.col("last_idx").alias("idx"), F.col("last_ts").alias("ts"), (F.col("last_e0") * (1 - F.lit(rule.stop))).alias("stop"))
        held = rows.withColumn("last", F.when(F.col("last_idx").isNotNull(), given))
    else:
        raise ValueError(f"no way to pick entries: {picks}")
    if picks == "doubling":
        before = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        held = rows.withColumn("last", last.over(before))
    closing = F.when(F.col("idx") <= F.col("last.idx") + rule.hold, F.struct(F.col("last").alias("own"), F.lit(True).alias("inside")))
    opening = F.when(F.col("pick"), F.struct(opened.alias("own"), F.lit(False).alias("inside")))
    parts = held.withColumn("part", F.explode(F.array_compact(F.array(closing, opening)))).withColumns({"own": F.col("part.own"), "inside": F.col("part.inside")})
    at = F.struct("idx", "ts")
    both = parts.groupBy("symbol", F.col("own.idx").alias("pick")).agg(
        F.max("own.ts").alias("entry_ts"),
        F.min(F.when(F.col("inside") & F.col("exit"), at)).alias("x"),
        F.min(F.when(F.col("inside") & (F.col("x0") < F.col("own.stop")), at)).alias("l"),
        F.max(at).alias("end"),
    )
    stopped = F.col("l").isNotNull() & (F.col("x").isNull() | (F.col("l.idx") < F.col("x.idx")))
    out = both.withColumn("exit_at", F.when(~stopped, F.coalesce("x", "end"))).withColumn("limit_at", F.when(stopped, F.col("l")))
    if drop_overwritten:
        later = Window.partitionBy("symbol", F.coalesce("exit_at.idx", -F.col("pick") - 1)).orderBy(F.desc("pick"))
        out = out.withColumn("_place", F.row_number().over(later)).where(F.col("exit_at").isNull() | (F.col("_place") == 1))
    name = F.sha2(F.concat_ws("#", F.col("symbol").cast("string"), F.unix_micros(F.col("entry_ts").cast("timestamp")).cast("string")), 256)
    return out.select(
        "symbol", name.alias("id"), F.lit(rule.trade_type).alias("trade_type"), "entry_ts", F.col("exit_at.ts").alias("exit_ts"), F.col("limit_at.ts").alias("limit_ts"),
        F.col("pick").alias("entry_idx"), F.coalesce("exit_at.idx", "limit_at.idx").alias("close_idx"),
    )


def trade_table(trades: DataFrame) -> DataFrame:
    return trades.select(*TRADES.split(", "))


def markers(trades: DataFrame) -> DataFrame:
    """``(symbol, ts, entry, exit, limit)``: ids by the time at which a trade opens or closes."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_ts").alias("ts")) for k in ("entry", "exit", "limit")])).alias("m")
    rows = trades.select("symbol", "id", kinds).where(F.col("m.ts").isNotNull())
    return rows.groupBy("symbol", F.col("m.ts").alias("ts")).agg(*[F.max(F.when(F.col("m.kind") == k, F.col("id"))).alias(k) for k in ("entry", "exit", "limit")])


def _priced(trades: DataFrame, base: DataFrame) -> DataFrame:
    """Trades with the open prices of the base frame at entry and close."""
    price = open_prices(base)
    out = trades.withColumn("close_ts", F.coalesce("exit_ts", "limit_ts"))
    for side in ("entry", "close"):
        out = out.join(price.select("symbol", F.col("ts").alias(f"{side}_ts"), F.col("open").alias(f"{side}_open")), ["symbol", f"{side}_ts"], "left")
    return out


def trade_results(trades: DataFrame, base: DataFrame) -> DataFrame:
    """``(symbol, id, trade_no, entry_ts, delta, entry_open, stopped)`` in order of entry, for trades whose close has a price.

    ``delta`` is open at close minus open at entry; an entry without a price counts as 0.
    """
    rows = _priced(trades, base).where("close_open IS NOT NULL").withColumn("entry_open", F.coalesce("entry_open", F.lit(0.0)))
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("entry_ts", "id"))
    return rows.select("symbol", "id", number.alias("trade_no"), "entry_ts", (F.col("close_open") - F.col("entry_open")).alias("delta"), "entry_open", F.col("limit_ts").isNotNull().alias("stopped"))


def trade_summary(results: DataFrame) -> DataFrame:
    """Per symbol the number of trades, win rate in percent (zeros left out), and gains of exits and of stops per 1000, over all trades."""
    gain = F.col("entry_open") / 1000 * F.col("delta")
    by = results.groupBy("symbol").agg(
        F.count("*").alias("total_trades"), F.count_if(F.col("delta") > 0).alias("won"), F.count_if(F.col("delta") < 0).alias("lost"),
        F.sum(F.when(~F.col("stopped"), gain).otherwise(0.0)).alias("win"), F.sum(F.when(F.col("stopped"), gain).otherwise(0.0)).alias("loss"),
    )
    rate = F.coalesce(F.try_divide(F.col("won").cast("double"), F.col("won") + F.col("lost")) * 100, F.lit(0.0))
    return by.select("symbol", "total_trades", rate.alias("win_rate"), (F.col("win") / F.col("total_trades")).alias("avg_win_per_1000"), (F.col("loss") / F.col("total_trades")).alias("avg_loss_per_1000"))


def delta_lists(results: DataFrame, size: int = 100_000) -> DataFrame:
    """``(symbol, chunk, deltas)`` in order of entry: a list for every ``size`` trades of a symbol, so no list outgrows a row."""
    chunk = F.floor((F.col("trade_no") - 1) / size).alias("chunk")
    return results.groupBy("symbol", chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("trade_no", "delta"))), lambda x: x["delta"]).alias("deltas"))


def trade_boxes(trades: DataFrame, base: DataFrame, stop: float) -> DataFrame:
    """``(symbol, id, profit_box, stop_box)``: four corners each, x in milliseconds, y in price.

    A trade without a close ends one millisecond after its entry; prices that are not there are 0; a base without opens
    has no boxes.
    """
    if "open" not in base.columns:
        return trades.select("symbol", "id").limit(0).selectExpr("symbol", "id", "cast(null as array<struct<x:double,y:double>>) as profit_box", "cast(null as array<struct<x:double,y:double>>) as stop_box")
    rows = _priced(trades, base)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("double")
    left = ms("entry_ts")
    right = F.coalesce(ms("close_ts"), left + 1)
    low, high = F.coalesce("entry_open", F.lit(0.0)), F.coalesce("close_open", F.lit(0.0))
    floor = low * (1 - stop)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = lambda top, bottom: F.array(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom))
    return rows.select("symbol", "id", box(high, low).alias("profit_box"), box(low, floor).alias("stop_box"))


def back_test(
    frame: DataFrame | dict[str, DataFrame], rule: Rule, base: DataFrame, picks: str = "walk", how: str = "exact", tolerance: timedelta | None = None, pair: str | None = None
) -> dict[str, DataFrame]:
    """Trades, their boxes, their results and the summary, from trades that are found once and stored; typed and empty where there are none.

    Several frames by name are joined as ``over_frames`` says, for a rule with columns named "frame.column"; ``picks`` is
    the way of ``find_trades``.
    """
    if isinstance(frame, dict):
        frame, rule = over_frames(frame, rule, how, tolerance, pair)
    trades = checkpointed(find_trades(frame, rule, picks=picks))
    results = trade_results(trades, base)
    return {"trades": trade_table(trades), "boxes": trade_boxes(trades, base, rule.stop), "results": results, "summary": trade_summary(results)}
