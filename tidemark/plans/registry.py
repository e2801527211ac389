"""Registered queries of the market toolkit by inventory row, each over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clean, scalar
from tidemark.operators import align, calc, calc_sets, charts, long_series, select, trades, view
from tidemark.plans import live
from tidemark.plans.tables import BARS, EVENT_BARS, FILINGS, FUNDAMENTALS, GAPPED, INDEXED, event_bars, filings, fundamentals, gapped_bars, supplier_bars, table
from tidemark.sources import polled, sinks, text_index
from tidemark.sources.bars import Source, Sources, ohlc_bars, records_from_json, records_without_schema

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *only: str, places: int = 4) -> DataFrame:
    """Doubles (all, or those named) to ``places``: sums, fits and logarithms differ in their last digits between engines.

    Values that no sum went into are compared as they are.  Rounds the scaled double half away from zero, as the SQL side
    does; ``functions.round`` rounds its decimal form, which is another value where a price ends in a 5.
    """

    scale = 10.0**places

    def near(c: str) -> Column:
        x = F.col(c)
        whole = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)
        return F.when(F.abs(x) < 1e12, whole).otherwise(x).alias(c)

    return df.select(*[near(c) if t == "double" and (c in only or not only) else F.col(c) for c, t in df.dtypes])


def _calc(name: str, make: Callable[[], Column | dict[str, Column]], sql: str, source=supplier_bars, with_: str = BARS + ", " + INDEXED, frm: str = "ix", exact: bool = True) -> None:
    """A query that adds calculated columns to the keys; ``exact`` ones are compared unrounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = made if isinstance(made := make(), dict) else {"value": made}
        out = source(spark, sf_dir).withColumns(columns).select("symbol", "ts", *columns)
        return out if exact else rounded(out)

    query(name, f"WITH {with_} SELECT symbol, ts, {sql} FROM {frm}")(run)


W = "OVER (PARTITION BY symbol ORDER BY ts)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SMA = f"CASE WHEN idx >= 13 THEN avg(close) {rows(14)} END"
VOL = f"CASE WHEN idx >= 13 THEN stddev_samp(close) {rows(14)} ELSE 0 END"

# ---- flagship -------------------------------------------------------------------------------------------------------

FLAGSHIP = f"""WITH {EVENT_BARS} SELECT symbol, ts, open, close, open - close AS change,
  round(CASE WHEN row_number() {W} >= 14 THEN avg(close) {rows(14)} END, 4) AS average FROM ebars"""


@query("flagship", FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = select.pull(event_bars(spark, sf_dir), "open", "close")
    return rounded(calc.run_calcs(bars, [calc.Calc("DIFFERENCE", ("open", "close"), "change"), calc.Calc("SMA", ("close", "14"), "average")]), "average")


# ---- sources --------------------------------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> Sources:
    out = Sources(spark)
    out.add("ticks", Source(f"{sf_dir}/events.parquet"))
    out.add("orders", Source(f"{sf_dir}/orders.parquet", options={"mergeSchema": "false"}))
    return out


@query("S1_price_scan", "SELECT event_id, ts, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def price_scan(spark, sf_dir):
    return _sources(spark, sf_dir).scan("ticks", ["click", "view"], symbol="event_type").select("event_id", "ts", "event_type", "value")


@query("S1_polled_replies", "SELECT event_type AS ticker, event_id, value FROM events WHERE event_type IN ('click', 'view')")
def polled_replies(spark, sf_dir):
    """Polled replies as a table: other tickers are not read, fields and types are those of the replies."""
    polled.use_polled(spark)
    replies = spark.read.format(polled.FORMAT).option("path", live.replies_of_events(spark, sf_dir)).load()
    return records_without_schema(replies.where(F.col("ticker").isin("click", "view")).select("ticker", "reply"), "reply").select("ticker", "event_id", "value")


@query("S2_date_range", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def date_range(spark, sf_dir):
    return _sources(spark, sf_dir).scan("ticks", first="20240105", last="20240120").select("event_id", "ts", "value")


@query("S3_json_records", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_records(spark, sf_dir):
    return records_from_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k bigint")


@query("S3_inferred_records", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def inferred_records(spark, sf_dir):
    """The fields of ``props`` and their types as the records have them: no schema is named."""
    return records_without_schema(table(spark, sf_dir, "events").select("event_id", "props"), "props")


@query("S4_several_sources", "SELECT 'ticks' AS source, count(*) AS n_rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def several_sources(spark, sf_dir):
    return _sources(spark, sf_dir).together(["ticks", "orders"]).groupBy("source").agg(F.count("*").alias("n_rows"))


@query("S5_source_alias", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def source_alias(spark, sf_dir):
    return _sources(spark, sf_dir).scan("orders", first="19960101", last="19961231", ts="o_orderdate").select("o_orderkey", "o_totalprice")


@query("S6_fundamentals", f"WITH {FUNDAMENTALS} SELECT symbol, filed_ts, eps, outstanding_shares FROM fundamentals")
def fundamentals_scan(spark, sf_dir):
    return fundamentals(spark, sf_dir)


@query("S7_source_options", "SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM orders")
def source_options(spark, sf_dir):
    read = Source(f"{sf_dir}/orders.parquet", options={"mergeSchema": "true"}).read(spark)
    return read.agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S8_bars", f"WITH {BARS} SELECT symbol, ts, open AS open, high AS high, low AS low, close AS close, volume AS volume FROM bars")
def bars(spark, sf_dir):
    return supplier_bars(spark, sf_dir)


# ---- projections, filters, cleaning ---------------------------------------------------------------------------------


@query("P1_pull", f"WITH {BARS} SELECT symbol, ts, open AS open, volume AS volume FROM bars")
def pull(spark, sf_dir):
    return select.pull(supplier_bars(spark, sf_dir), "open", "volume")


@query("P2_calcs_on_calcs", f"WITH {BARS} SELECT symbol, ts, (high - low) AS spread, ((high - low) * 2) AS twice FROM bars")
def calcs_on_calcs(spark, sf_dir):
    wanted = [calc.Calc("MULTIPLY", ("spread", "2"), "twice"), calc.Calc("DIFFERENCE", ("high", "low"), "spread")]
    return calc.run_calcs(supplier_bars(spark, sf_dir), wanted).select("symbol", "ts", "spread", "twice")


FIN = "CASE WHEN close IS NOT NULL AND isfinite(close) THEN close END"
_gap = dict(source=gapped_bars, with_=BARS + ", " + GAPPED, frm="gapped")
_calc(
    "P3_repair", lambda: clean.repaired(F.col("close")),
    f"coalesce(last_value({FIN} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), "
    f"first_value({FIN} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value", **_gap,
)
CARRIED = (
    "coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), "
    "first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
)
_calc("P4_fill", lambda: clean.filled(F.col("close")), f"CASE WHEN isfinite({CARRIED}) THEN {CARRIED} ELSE 0 END AS value", **_gap)


@query("P5_strict_double", "SELECT l_suppkey AS symbol, l_linenumber::DOUBLE AS l_linenumber, l_quantity AS l_quantity FROM lineitem")
def strict_double(spark, sf_dir):
    return clean.strict_double(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), "l_linenumber", "l_quantity"), ["l_linenumber", "l_quantity"])


@query("P6_to_double", "SELECT event_id::DOUBLE AS event_id, value AS value FROM events")
def to_double(spark, sf_dir):
    return clean.to_double(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"])


_calc("P7_literals", lambda: calc.difference("close", "50"), "(close - 50) AS value")
_calc("P8_proximity", lambda: scalar.near([F.col("open"), F.col("close"), F.col("low")], 100.0), "coalesce(abs(open - close) <= 100 AND abs(close - low) <= 100, false) AS value")
RULE = trades.Rule(("close", "average"), 40.0, ("open", "average"), 30.0, 0.1, 10)


def _rule_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_bars(spark, sf_dir).withColumn("average", calc.moving_average("close", 14))




def trade_sql(frame: str, entry: str, exit: str, e0: str = "close", x0: str = "open", hold: int = 10, keep: float = 0.9) -> str:
    """The trade rule in SQL over ``frame``, CTEs that end in ``f(symbol, ts, idx, n, ...)``: candidates, the greedy chain as
    a recursive walk along "next candidate", then closes."""
    return f"""{frame}, s AS MATERIALIZED (
  SELECT *, coalesce({entry}, false) AS ent, coalesce({exit}, false) AS ext FROM f
), c AS MATERIALIZED (
  SELECT symbol, idx, min(idx) OVER (PARTITION BY symbol ORDER BY idx RANGE BETWEEN {max(hold, 1)} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s WHERE ent
), p AS (
  SELECT symbol, min(idx) AS idx FROM c GROUP BY symbol
  UNION ALL
  SELECT c.symbol, c.nxt FROM p JOIN c ON c.symbol = p.symbol AND c.idx = p.idx WHERE c.nxt IS NOT NULL
), o AS (
  SELECT p.symbol, p.idx AS pick, e.ts AS entry_ts, e.{e0} * {keep} AS stop, e.n FROM p JOIN s e ON e.symbol = p.symbol AND e.idx = p.idx
), k AS (
  SELECT o.symbol, o.pick, o.entry_ts, o.n, min(CASE WHEN s.ext THEN s.idx END) AS x, min(CASE WHEN s.{x0} < o.stop THEN s.idx END) AS l
  FROM o LEFT JOIN s ON s.symbol = o.symbol AND s.idx > o.pick AND s.idx <= o.pick + {hold} GROUP BY ALL
), m AS (
  SELECT *, l IS NOT NULL AND (x IS NULL OR l < x) AS stopped FROM k
), z AS (
  SELECT *, CASE WHEN NOT stopped THEN coalesce(x, least(pick + {hold}, n - 1)) END AS xi, CASE WHEN stopped THEN l END AS li FROM m
), y AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, coalesce(xi, -pick - 1) ORDER BY pick DESC) AS place FROM z
), t AS (
  SELECT y.symbol, y.entry_ts, a.ts AS exit_ts, b.ts AS limit_ts, y.pick AS entry_idx, coalesce(y.xi, y.li) AS close_idx
  FROM y LEFT JOIN s a ON a.symbol = y.symbol AND a.idx = y.xi LEFT JOIN s b ON b.symbol = y.symbol AND b.idx = y.li
  WHERE xi IS NULL OR place = 1
), id AS (
  SELECT *, sha256(symbol || '#' || epoch_us(entry_ts)) AS id FROM t
)"""


_RULE_FRAME = f"{BARS}, {INDEXED}, f AS (SELECT *, {SMA} AS average FROM ix)"
TRADE_SQL = trade_sql(_RULE_FRAME, "abs(close - average) <= 40", "abs(open - average) <= 30")
RESULT_SQL = TRADE_SQL + """, r AS (
  SELECT i.symbol, i.id, i.entry_ts, row_number() OVER (PARTITION BY i.symbol ORDER BY i.entry_ts, i.id) AS trade_no,
         q.open - coalesce(e.open, 0) AS delta, q.open AS close_open, coalesce(e.open, 0) AS entry_open, i.limit_ts IS NOT NULL AS stopped
  FROM id i LEFT JOIN bars e ON e.symbol = i.symbol AND e.ts = i.entry_ts JOIN bars q ON q.symbol = i.symbol AND q.ts = coalesce(i.exit_ts, i.limit_ts)
)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.find_trades(_rule_frame(spark, sf_dir), RULE)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.trade_results(_trades(spark, sf_dir), supplier_bars(spark, sf_dir))


@query("P9_with_markers", f"WITH RECURSIVE {TRADE_SQL}, e AS (SELECT symbol, entry_ts AS ts FROM id UNION SELECT symbol, exit_ts FROM id UNION SELECT symbol, limit_ts FROM id) SELECT symbol, ts FROM e WHERE ts IS NOT NULL")
def with_markers(spark, sf_dir):
    marked = supplier_bars(spark, sf_dir).select("symbol", "ts").join(trades.markers(_trades(spark, sf_dir)), ["symbol", "ts"], "left")
    return select.with_any(marked, "entry", "exit", "limit").select("symbol", "ts")


@query("P10_closed", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, id FROM id WHERE exit_ts IS NOT NULL OR limit_ts IS NOT NULL")
def closed(spark, sf_dir):
    return select.closed(_trades(spark, sf_dir)).select("symbol", "id")


@query("P11_text_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('Plate'))")
def text_filter(spark, sf_dir):
    return select.matching(table(spark, sf_dir, "part"), "p_name", "Plate").select("p_partkey", "p_name")


@query("P11_indexed_search", "SELECT doc_id, source FROM documents WHERE contains(lower(text), lower('Enlichst'))")
def indexed_search(spark, sf_dir):
    """Whole texts, written once with the files of every three letters; files that lack some of the needle's are not opened."""
    path, docs = live.scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    text_index.write_indexed(docs, "text", path, order=("source", "doc_id"))
    return text_index.search(spark, path, "text", "Enlichst", docs.schema).select("doc_id", "source")


@query("P12_rename", f'WITH {BARS} SELECT symbol, ts, close AS "E0" FROM bars')
def rename(spark, sf_dir):
    return select.as_series(supplier_bars(spark, sf_dir), "close", "E0")


@query("P13_drop_nulls", f"WITH {BARS}, {GAPPED} SELECT symbol, ts, open AS open FROM gapped WHERE close IS NOT NULL")
def drop_nulls(spark, sf_dir):
    return select.without_nulls(gapped_bars(spark, sf_dir)).select("symbol", "ts", "open")


@query("P14_any_value", f"WITH {BARS}, {INDEXED}, a AS (SELECT symbol, ts, {SMA} AS x, lag(close, 20) {W} AS y FROM ix) SELECT symbol, ts, round(x, 4) AS x, y AS y FROM a WHERE coalesce(x, y) IS NOT NULL")
def any_value(spark, sf_dir):
    both = supplier_bars(spark, sf_dir).select("symbol", "ts", calc.moving_average("close").alias("x"), F.lag("close", 20).over(clean.series()).alias("y"))
    return rounded(select.with_any(both, "x", "y"), "x")


@query("P15_shorten", "SELECT doc_id, CASE WHEN length(text) > 48 THEN text[1:48] || '…' ELSE text END AS text FROM documents")
def shorten(spark, sf_dir):
    return select.shortened(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


# ---- calculations ---------------------------------------------------------------------------------------------------

_calc("C1_constant", lambda: calc.constant("50"), "50.0::DOUBLE AS value")
_calc("C2_difference", lambda: calc.difference("open", "close"), "(open - close) AS value")
_calc("C3_differences", lambda: calc.differences(["open", "high", "low", "close"], "d"), "(open - high) AS d_0, (high - low) AS d_1, (low - close) AS d_2")
_calc("C4_sum", lambda: calc.total(["open", "close", "high"]), "(open + close + high) AS value")
_calc("C5_product", lambda: calc.product(["close", "volume"]), "(close * volume) AS value")
_calc("C6_quotient", lambda: calc.quotient("close", F.col("open") - F.col("close")), "CASE WHEN open - close <> 0 THEN close / (open - close) END AS value")
_calc("C7_sma", lambda: calc.moving_average("close"), f"round({SMA}, 4) AS value", exact=False)
_D = f"WITH {BARS}, {INDEXED}, a AS (SELECT *, {SMA} AS m FROM ix) SELECT symbol, ts, "
_calc("C8_sma_delayed", lambda: calc.moving_average("close", align="delayed"), "1", exact=False)
ORACLES["C8_sma_delayed"] = _D + f"round(lag(m, 7) {W}, 4) AS value FROM a"
_calc("C9_sma_centered", lambda: calc.moving_average("close", align="centered", fill=0.0), "1", exact=False)
ORACLES["C9_sma_centered"] = _D + f"round(coalesce(lead(m, 7) {W}, 0), 4) AS value FROM a"


_WRAPPED = f"""WITH {BARS}, {INDEXED}, a AS (SELECT *, {SMA} AS m FROM ix), l AS (
  SELECT symbol, list(ts ORDER BY idx) AS t, list(round(m, 4) ORDER BY idx) AS v, count(*) - 7 % count(*) AS k FROM a GROUP BY symbol
) SELECT symbol, unnest(t) AS ts, unnest(list_concat(v[k + 1 :], v[: k])) AS value FROM l"""


@query("C8_sma_wrapped", _WRAPPED)
def sma_wrapped(spark, sf_dir):
    return rounded(calc.wrapped_average(supplier_bars(spark, sf_dir), "close", "value").select("symbol", "ts", "value"))


_calc("C10_volatility", lambda: calc.volatility("close"), f"round({VOL}, 4) AS value", exact=False)
_V = f"WITH {BARS}, {INDEXED}, a AS (SELECT *, {VOL} AS v FROM ix) SELECT symbol, ts, "
for _name, _op, _scale in (("C11_bands", "VOLATILITY", 0.5), ("C12_double_volatility", "DOUBLE_VOLATILITY", 1.0)):

    @query(_name, _V + f"round(v, 4) AS v, round(close * (1 + {_scale} * v), 2) AS v_pos, round(close * (1 - {_scale} * v), 2) AS v_neg FROM a")
    def band_query(spark, sf_dir, _op=_op):
        out = calc.run_calcs(supplier_bars(spark, sf_dir), [calc.Calc(_op, ("close",), "v")]).select("symbol", "ts", "v", "v_pos", "v_neg")
        return rounded(rounded(out, "v"), "v_pos", "v_neg", places=2)  # bands of 1e7 and more have 4 places of noise


LOG = f"CASE WHEN close > 0 AND lag(close) {W} > 0 THEN ln(close / lag(close) {W}) END"
_calc("C13_log_return", lambda: calc.log_return("close"), f"round({LOG}, 4) AS value", exact=False)
_R = f"WITH {BARS}, {INDEXED}, a AS (SELECT *, {LOG} AS r FROM ix), b AS (SELECT *, CASE WHEN count(r) {rows(14)} = 14 THEN stddev_samp(r) {rows(14)} * sqrt(252) END AS v FROM a) SELECT symbol, ts, "


@query("C14_return_volatility", _R + "round(v, 4) AS v FROM b")
def return_volatility(spark, sf_dir):
    return rounded(calc.with_return_volatility(supplier_bars(spark, sf_dir), "close", "v").select("symbol", "ts", "v"))


@query("C15_return_bands", _R + "round(v, 4) AS v, round(close * (1 + 0.5 * v), 4) AS v_pos, round(close * (1 - 0.5 * v), 4) AS v_neg FROM b")
def return_bands(spark, sf_dir):
    return rounded(calc.with_return_volatility(supplier_bars(spark, sf_dir), "close", "v", scale=0.5).select("symbol", "ts", "v", "v_pos", "v_neg"))


_FIT = f"WITH {BARS}, {INDEXED}, c AS (SELECT symbol, coalesce(regr_slope(close, idx), 0) AS b, coalesce(regr_intercept(close, idx), min(close)) AS a, arg_min(close, idx) AS y0, count(close) AS n FROM ix GROUP BY symbol)"


@query("C16_regression", _FIT + " SELECT ix.symbol, ts, round(b * idx + a, 4) AS value FROM ix JOIN c ON c.symbol = ix.symbol")
def regression(spark, sf_dir):
    return rounded(calc.linear_regression(supplier_bars(spark, sf_dir), "close", "value").select("symbol", "ts", "value"))


@query("C17_coefficients", _FIT + " SELECT symbol, round(a, 4) AS intercept, round(b, 4) AS slope, y0 AS first_value, n FROM c")
def coefficients(spark, sf_dir):
    return rounded(calc.line_coefficients(supplier_bars(spark, sf_dir), "close"), "intercept", "slope")


@query("C18_flat_line", f"WITH {EVENT_BARS} SELECT symbol, 7.0::DOUBLE AS intercept, 0.0::DOUBLE AS slope FROM ebars GROUP BY symbol")
def flat_line(spark, sf_dir):
    return rounded(calc.line_coefficients(event_bars(spark, sf_dir).withColumn("flat", F.when(F.dayofmonth("ts") == 7, F.lit(7.0))), "flat").select("symbol", "intercept", "slope"))


@query("C19_relative_line", _FIT + " SELECT ix.symbol, ts, round((b * idx + a) / y0 - 1, 4) AS value FROM ix JOIN c ON c.symbol = ix.symbol")
def relative_line(spark, sf_dir):
    return rounded(calc.linear_regression(supplier_bars(spark, sf_dir), "close", "value", relative=True).select("symbol", "ts", "value"))


_calc("C20_index_weighted", lambda: calc.index_weighted("close"), "(idx * close) AS value")


@query("C21_series_sum", f"WITH {BARS} SELECT symbol, round(sum(close), 4) AS total FROM bars GROUP BY symbol")
def series_sum(spark, sf_dir):
    return rounded(calc.series_sums(supplier_bars(spark, sf_dir), "close"))


_calc("C22_index_line", lambda: calc.index_line(2.0, 0.5), "(2 + 0.5 * idx)::DOUBLE AS value")


@query("C23_calc_waves", f"WITH {BARS}, {INDEXED}, a AS (SELECT *, {SMA} AS m FROM ix), b AS (SELECT *, coalesce(m, first_value(m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS f FROM a) SELECT symbol, ts, round(m, 4) AS m, round(close - f, 4) AS d, round((close - f) + f, 4) AS s FROM b")
def calc_waves(spark, sf_dir):
    wanted = [calc.Calc("SUM", ("d", "m"), "s"), calc.Calc("DIFFERENCE", ("close", "m"), "d"), calc.Calc("SMA", ("close", "14"), "m")]
    return rounded(calc.run_calcs(supplier_bars(spark, sf_dir), wanted).select("symbol", "ts", "m", "d", "s"))


def spread_set(df: DataFrame, fast: int, slow: int) -> DataFrame:
    """A set of calculations to use again: two averages and the distance between them."""
    return calc.run_calcs(df, [calc.Calc("SMA", ("close", fast), "fast"), calc.Calc("SMA", ("close", slow), "slow")]).withColumn("spread", F.col("fast") - F.col("slow"))


@query("C24_calc_set", f"WITH {BARS}, {INDEXED}, a AS (SELECT symbol, ts, CASE WHEN idx >= 4 THEN avg(close) {rows(5)} END AS fast, CASE WHEN idx >= 19 THEN avg(close) {rows(20)} END AS slow FROM ix) SELECT symbol, ts, round(fast - slow, 4) AS spread FROM a")
def calc_set(spark, sf_dir):
    return rounded(supplier_bars(spark, sf_dir).transform(spread_set, 5, 20).select("symbol", "ts", "spread"))


def spread_sets() -> calc_sets.CalcSets:
    """Distance of two averages, and three such distances by periods that grow."""
    average, use = (lambda n, out: calc.Calc("SMA", ("$x", n), out)), calc_sets.Use
    sets = calc_sets.CalcSets().add("spread", ("x", "fast", "slow"), average("$fast", "fast"), average("$slow", "slow"), calc.Calc("DIFFERENCE", ("fast", "slow"), "distance"))
    steps = [use("spread", name, {"x": "$x", "fast": fast, "slow": slow}) for name, fast, slow in (("near", 5, 10), ("middle", 5, 20), ("far", 10, 20))]
    return sets.add("fan", ("x",), *steps, calc.Calc("SUM", ("near_distance", "far_distance"), "path"))


_GRID_AVERAGES = ", ".join(f"CASE WHEN idx >= {n - 1} THEN avg(close) {rows(n)} END AS m{n}" for n in (5, 10, 20))
_GRID_FILLED = ", ".join(f"coalesce(m{n}, first_value(m{n} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS f{n}" for n in (5, 10, 20))


@query("C24_calc_grid", f"WITH {BARS}, {INDEXED}, a AS (SELECT symbol, ts, {_GRID_AVERAGES} FROM ix), b AS (SELECT symbol, ts, {_GRID_FILLED} FROM a) SELECT symbol, ts, round(f5 - f10, 4) AS near, round(f5 - f20, 4) AS middle, round(f10 - f20, 4) AS far, round((f5 - f10) + (f10 - f20), 4) AS path FROM b")
def calc_grid(spark, sf_dir):
    """A set used by a set: six averages are named, three are computed, in one shuffle."""
    out = calc_sets.run_sets(supplier_bars(spark, sf_dir), spread_sets(), calc_sets.Use("fan", "f", {"x": "close"}))
    return rounded(out.select("symbol", "ts", *[F.col(f"f_{n}_distance").alias(n) for n in ("near", "middle", "far")], F.col("f_path").alias("path")))


# ---- joins ----------------------------------------------------------------------------------------------------------


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, "hour")


HBARS = EVENT_BARS.replace("ebars AS", "hbars AS").replace("date_trunc('day'", "date_trunc('hour'")
DAY = timedelta(days=1)


@query("J1_align_exact", f"WITH {EVENT_BARS}, {HBARS} SELECT e.symbol, e.ts, e.close AS day_close, h.close AS hour_close, e.open AS day_open FROM ebars e JOIN hbars h ON e.symbol = h.symbol AND e.ts = h.ts")
def align_exact(spark, sf_dir):
    day = event_bars(spark, sf_dir)
    return align.align_exact([(day, "close", "day_close"), (_hours(spark, sf_dir), "close", "hour_close"), (day, "open", "day_open")])


@query("J2_asof", f"WITH {BARS}, {FUNDAMENTALS} SELECT b.symbol, b.ts, b.close AS close, CASE WHEN b.ts - f.filed_ts <= INTERVAL 30 DAY THEN f.eps END AS eps FROM bars b ASOF LEFT JOIN fundamentals f ON b.symbol = f.symbol AND b.ts >= f.filed_ts")
def asof(spark, sf_dir):
    filed = fundamentals(spark, sf_dir).withColumnRenamed("filed_ts", "ts")
    return align.asof_backward(supplier_bars(spark, sf_dir).select("symbol", "ts", "close"), filed, ["eps"], timedelta(days=30))


_KNOWN = f"""WITH {BARS}, {FILINGS}, seen AS (
  SELECT b.symbol, b.ts, f.period, f.known, f.eps, row_number() OVER (PARTITION BY b.symbol, b.ts ORDER BY f.period DESC, f.known DESC) AS k
  FROM bars b JOIN filings f ON f.symbol = b.symbol AND f.known <= b.ts
) SELECT b.symbol, b.ts, b.close AS close, s.period, s.known, s.eps AS eps FROM bars b LEFT JOIN (SELECT * FROM seen WHERE k = 1) s ON s.symbol = b.symbol AND s.ts = b.ts"""


@query("J2_asof_known", _KNOWN)
def asof_known(spark, sf_dir):
    """The newest month's earnings that were known at each bar, as filed or as restated by then."""
    return align.asof_known(supplier_bars(spark, sf_dir).select("symbol", "ts", "close"), filings(spark, sf_dir), ["period", "known", "eps"])


@query("L11_long_series_asof_known", _KNOWN)
def long_asof_known(spark, sf_dir):
    return align.asof_known(supplier_bars(spark, sf_dir).select("symbol", "ts", "close"), filings(spark, sf_dir), ["period", "known", "eps"], slice=timedelta(days=200))


@query("S6_figures_as_known", f"WITH {FILINGS}, v AS (SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY known DESC) AS k FROM filings WHERE known <= TIMESTAMP '1996-07-01') SELECT symbol, period, known, eps AS eps FROM v WHERE k = 1")
def figures_as_known(spark, sf_dir):
    return align.as_known(filings(spark, sf_dir), "1996-07-01 00:00:00", ["eps"])


STEPS = "s AS (SELECT symbol, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM bars), p AS (SELECT symbol, step, row_number() OVER (PARTITION BY symbol ORDER BY step) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM s WHERE step > 0)"


@query("J3_median_steps", f"WITH {BARS}, {STEPS} SELECT symbol, step FROM p WHERE k = n // 2")
def median_steps(spark, sf_dir):
    return align.median_steps(supplier_bars(spark, sf_dir))


@query("J4_unique_rows", "SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem")
def unique_rows(spark, sf_dir):
    return align.unique_times(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate"))


@query("J5_align_asof", f'WITH {EVENT_BARS}, {HBARS} SELECT h.symbol, h.ts, e.close AS "E0", h.close AS "X0" FROM hbars h ASOF LEFT JOIN ebars e ON e.symbol = h.symbol AND h.ts >= e.ts')
def align_asof(spark, sf_dir):
    return align.align_asof([(event_bars(spark, sf_dir), "close", "E0"), (_hours(spark, sf_dir), "close", "X0")], DAY)


_PAIR = f"WITH {BARS}, {EVENT_BARS}"


def _even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of users with even numbers, clicks from the second day on: another frame, with other lengths."""
    some = table(spark, sf_dir, "events").where("user_id % 2 = 0 AND (event_type <> 'click' OR day(ts) > 1)")
    return ohlc_bars(some, "event_type", "ts", "value", "day", ("event_id",))


_EVEN = EVENT_BARS.replace("ebars AS", "evens AS").replace("FROM events)", "FROM events WHERE user_id % 2 = 0 AND (event_type <> 'click' OR day(ts) > 1))")
_POSITION = f"""WITH {EVENT_BARS}, {_EVEN}, a AS (
  SELECT symbol, list(ts ORDER BY ts) AS t, list(close ORDER BY ts) AS x, count(*) AS n FROM ebars GROUP BY symbol
), b AS (
  SELECT symbol, list(high ORDER BY ts) AS y, list(volume ORDER BY ts) AS v, count(*) AS n FROM evens GROUP BY symbol
)"""


@query("J6_align_position", _POSITION + " SELECT symbol, unnest(t) AS ts, unnest(x) AS x, unnest(y) AS y FROM a JOIN b USING (symbol, n)")
def align_position(spark, sf_dir):
    return align.align_position([(event_bars(spark, sf_dir), "close", "x"), (_even(spark, sf_dir), "high", "y")])


@query("J7_open_lookup", f"WITH RECURSIVE {TRADE_SQL} SELECT i.symbol, i.id, b.open AS entry_open FROM id i LEFT JOIN bars b ON b.symbol = i.symbol AND b.ts = i.entry_ts")
def open_lookup(spark, sf_dir):
    prices = align.open_prices(supplier_bars(spark, sf_dir)).select("symbol", F.col("ts").alias("entry_ts"), F.col("open").alias("entry_open"))
    return _trades(spark, sf_dir).join(prices, ["symbol", "entry_ts"], "left").select("symbol", "id", "entry_open")


@query("J9_append", _POSITION + " SELECT symbol, unnest(t) AS ts, unnest(x) AS close, unnest(list_resize(coalesce(v, []), a.n)) AS volume FROM a LEFT JOIN b USING (symbol)")
def append(spark, sf_dir):
    return align.append_by_position(event_bars(spark, sf_dir).select("symbol", "ts", "close"), _even(spark, sf_dir).select("symbol", "ts", "volume"), "volume")


# ---- trades ---------------------------------------------------------------------------------------------------------

SIGNALS = f"WITH {BARS}, {INDEXED}, f AS (SELECT *, {SMA} AS average FROM ix) SELECT symbol, ts, "


@query("T1_entry_signal", SIGNALS + "coalesce(abs(close - average) <= 40, false) AS entry FROM f")
def entry_signal(spark, sf_dir):
    return trades.signals(_rule_frame(spark, sf_dir), RULE).select("symbol", "ts", "entry")


@query("T2_exit_signal", SIGNALS + "coalesce(abs(open - average) <= 30, false) AS exit FROM f")
def exit_signal(spark, sf_dir):
    return trades.signals(_rule_frame(spark, sf_dir), RULE).select("symbol", "ts", "exit")


@query("T3_stop_level", SIGNALS + "(close * 0.9) AS stop_level FROM f")
def stop_level(spark, sf_dir):
    return trades.signals(_rule_frame(spark, sf_dir), RULE).select("symbol", "ts", (F.col("e0") * (1 - F.lit(RULE.stop))).alias("stop_level"))


@query("T4_greedy_entries", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, idx FROM p")
def greedy_entries(spark, sf_dir):
    return trades.greedy_picks(trades.signals(_rule_frame(spark, sf_dir), RULE).where("entry").select("symbol", "idx"), RULE.step)


@query("T4_entries_by_doubling", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, idx FROM p")
def entries_by_doubling(spark, sf_dir):
    return trades.greedy_picks_by_doubling(trades.signals(_rule_frame(spark, sf_dir), RULE).where("entry").select("symbol", "idx"), RULE.step)


@query("T5_exits", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, id, exit_ts FROM id WHERE exit_ts IS NOT NULL")
def exits(spark, sf_dir):
    return _trades(spark, sf_dir).where("exit_ts IS NOT NULL").select("symbol", "id", "exit_ts")


@query("T6_stops", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, id, limit_ts FROM id WHERE limit_ts IS NOT NULL")
def stops(spark, sf_dir):
    return _trades(spark, sf_dir).where("limit_ts IS NOT NULL").select("symbol", "id", "limit_ts")


@query("T7_close_index", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, entry_idx, close_idx FROM id")
def close_index(spark, sf_dir):
    return _trades(spark, sf_dir).select("symbol", "entry_idx", "close_idx")


#: Enters wherever an average is there and closes by its hold alone, so a last trade on a last row meets the one before.
ALWAYS = trades.Rule(("close", "average"), 1e9, ("open", "average"), -1.0, 1.0, 10)
_ALWAYS_SQL = trade_sql(_RULE_FRAME, "abs(close - average) <= 1e9", "abs(open - average) <= -1", keep=0.0)


@query("T8_overwritten", f"WITH RECURSIVE {_ALWAYS_SQL} SELECT symbol, pick AS entry_idx, coalesce(xi, li) AS close_idx FROM y WHERE xi IS NOT NULL AND place > 1")
def overwritten(spark, sf_dir):
    every = trades.find_trades(_rule_frame(spark, sf_dir), ALWAYS, drop_overwritten=False)
    kept = trades.find_trades(_rule_frame(spark, sf_dir), ALWAYS)
    return every.join(kept, "id", "left_anti").select("symbol", "entry_idx", "close_idx")


@query("T9_markers", f"WITH RECURSIVE {TRADE_SQL}, u AS (SELECT symbol, entry_ts AS ts, id AS entry, NULL::VARCHAR AS exit, NULL::VARCHAR AS limit_ FROM id UNION ALL SELECT symbol, exit_ts, NULL::VARCHAR, id, NULL::VARCHAR FROM id UNION ALL SELECT symbol, limit_ts, NULL::VARCHAR, NULL::VARCHAR, id FROM id) SELECT symbol, ts, max(entry) AS entry, max(exit) AS exit, max(limit_) AS \"limit\" FROM u WHERE ts IS NOT NULL GROUP BY symbol, ts")
def marker_table(spark, sf_dir):
    return trades.markers(_trades(spark, sf_dir))


@query("T10_trades", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, id, entry_ts, exit_ts, limit_ts FROM id")
def trade_rows(spark, sf_dir):
    return trades.trade_table(_trades(spark, sf_dir))


@query("T11_trade_ids", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, count(DISTINCT id) AS n_ids, max(id) AS last_id FROM id GROUP BY symbol")
def trade_ids(spark, sf_dir):
    return _trades(spark, sf_dir).groupBy("symbol").agg(F.count_distinct("id").alias("n_ids"), F.max("id").alias("last_id"))


@query("T12_trade_results", f"WITH RECURSIVE {RESULT_SQL} SELECT symbol, id, trade_no, entry_ts, delta AS delta, entry_open AS entry_open, stopped FROM r")
def trade_results(spark, sf_dir):
    return _results(spark, sf_dir)


SUMMARY = """ SELECT symbol, count(*) AS total_trades,
  round(coalesce(100.0 * count(*) FILTER (delta > 0) / nullif(count(*) FILTER (delta <> 0), 0), 0), 4)::DOUBLE AS win_rate,
  round(sum(CASE WHEN NOT stopped THEN entry_open / 1000 * delta ELSE 0 END) / count(*), 4) AS avg_win_per_1000,
  round(sum(CASE WHEN stopped THEN entry_open / 1000 * delta ELSE 0 END) / count(*), 4) AS avg_loss_per_1000 FROM r GROUP BY symbol"""


@query("T13_summary", f"WITH RECURSIVE {RESULT_SQL}{SUMMARY}")
def summary(spark, sf_dir):
    return rounded(trades.trade_summary(_results(spark, sf_dir)))


@query("T14_win_rate", f"WITH RECURSIVE {RESULT_SQL}, q AS ({SUMMARY}) SELECT symbol, win_rate FROM q")
def win_rate(spark, sf_dir):
    return rounded(trades.trade_summary(_results(spark, sf_dir)).select("symbol", "win_rate"))


@query("T15_deltas", f"WITH RECURSIVE {RESULT_SQL} SELECT symbol, count(*)::INT AS n, round(list_sum(list(delta ORDER BY trade_no)[1:5]), 4) AS first_five FROM r GROUP BY symbol")
def deltas(spark, sf_dir):
    lists = trades.delta_lists(_results(spark, sf_dir))
    five = F.aggregate(F.slice("deltas", 1, 5), F.lit(0.0), lambda a, x: a + x)
    by = lists.groupBy("symbol").agg(F.sum(F.size("deltas")).cast("int").alias("n"), F.max(F.when(F.col("chunk") == 0, five)).alias("first_five"))
    return rounded(by)


@query("T16_boxes", f"WITH RECURSIVE {RESULT_SQL} SELECT symbol, id, epoch_ms(entry_ts)::DOUBLE AS x_left, close_open AS top, entry_open AS middle, (entry_open * 0.9) AS floor FROM r")
def boxes(spark, sf_dir):
    out = trades.trade_boxes(_trades(spark, sf_dir), supplier_bars(spark, sf_dir), RULE.stop)
    return out.select("symbol", "id", F.col("profit_box")[0]["x"].alias("x_left"), F.col("profit_box")[0]["y"].alias("top"), F.col("stop_box")[0]["y"].alias("middle"), F.col("stop_box")[2]["y"].alias("floor"))


@query("T17_trade_type", f"WITH RECURSIVE {TRADE_SQL} SELECT 'option_call' AS trade_type, count(*) AS n FROM id")
def trade_type(spark, sf_dir):
    rule = trades.Rule(RULE.entry, RULE.within_entry, RULE.exit, RULE.within_exit, RULE.stop, RULE.hold, "option_call")
    return trades.find_trades(_rule_frame(spark, sf_dir), rule).groupBy("trade_type").agg(F.count("*").alias("n"))


@query("T18_base_frame", f"WITH RECURSIVE {RESULT_SQL} SELECT symbol, id, delta AS delta FROM r")
def base_frame(spark, sf_dir):
    out = trades.back_test(_rule_frame(spark, sf_dir), RULE, base=supplier_bars(spark, sf_dir))
    return out["results"].select("symbol", "id", "delta")


#: Entry and exit take columns of two frames: hours beside the last day's average.
TWO = trades.Rule(("hour.close", "day.average"), 1.0, ("hour.open", "day.open"), 0.5, 0.5, 20)
_TWO_SQL = trade_sql(
    f"""{EVENT_BARS}, {HBARS}, d AS (
  SELECT symbol, ts, open, CASE WHEN row_number() {W} >= 3 THEN avg(close) {rows(3)} END AS average FROM ebars
), j AS (
  SELECT h.symbol, h.ts, h.close AS e0, h.open AS x0, a.average AS e1, b.open AS x1
  FROM hbars h ASOF LEFT JOIN (SELECT * FROM d WHERE average IS NOT NULL) a ON a.symbol = h.symbol AND h.ts >= a.ts ASOF LEFT JOIN d b ON b.symbol = h.symbol AND h.ts >= b.ts
), f AS MATERIALIZED (
  SELECT j.symbol, j.ts, e0, x0, CASE WHEN h.ts - a.ts <= INTERVAL 1 DAY THEN e1 END AS e1, CASE WHEN h.ts - b.ts <= INTERVAL 1 DAY THEN x1 END AS x1,
         row_number() OVER (PARTITION BY j.symbol ORDER BY j.ts) - 1 AS idx, count(*) OVER (PARTITION BY j.symbol) AS n
  FROM j JOIN hbars h USING (symbol, ts) ASOF LEFT JOIN (SELECT symbol, ts FROM d WHERE average IS NOT NULL) a ON a.symbol = h.symbol AND h.ts >= a.ts ASOF LEFT JOIN d b ON b.symbol = h.symbol AND h.ts >= b.ts
)""",
    "abs(e0 - e1) <= 1", "abs(x0 - x1) <= 0.5", "e0", "x0", 20, 0.5,
)


@query("T19_two_frames", f"WITH RECURSIVE {_TWO_SQL} SELECT symbol, id, entry_ts, exit_ts, limit_ts FROM id")
def two_frames(spark, sf_dir):
    day = event_bars(spark, sf_dir).withColumn("average", calc.moving_average("close", 3))
    frame, rule = trades.over_frames({"hour": _hours(spark, sf_dir), "day": day}, TWO, "asof", DAY)
    return trades.trade_table(trades.find_trades(frame, rule))


#: Two tickers in frames of their own, and a constant level, as one pair.
PAIR = trades.Rule(("a.close", "b.close"), 5.0, ("a.average", "b.level"), 3.0, 0.15, 5)
_PAIR_SQL = trade_sql(
    f"""{EVENT_BARS}, g AS (SELECT *, CASE WHEN row_number() {W} >= 2 THEN avg(close) {rows(2)} END AS average FROM ebars), f AS MATERIALIZED (
  SELECT 'click/view' AS symbol, a.ts, a.close AS e0, b.close AS e1, a.average AS x0, 10.0::DOUBLE AS x1, row_number() OVER (ORDER BY a.ts) - 1 AS idx, count(*) OVER () AS n
  FROM g a JOIN g b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'
)""",
    "abs(e0 - e1) <= 5", "abs(x0 - x1) <= 3", "e0", "x0", 5, 0.85,
)


@query("T20_pair_trades", f"WITH RECURSIVE {_PAIR_SQL} SELECT symbol, id, entry_ts, exit_ts, limit_ts FROM id")
def pair_trades(spark, sf_dir):
    of = lambda symbol: event_bars(spark, sf_dir).where(F.col("symbol") == symbol)
    frames = {"a": of("click").withColumn("average", calc.moving_average("close", 2)), "b": of("view").withColumn("level", calc.constant("10"))}
    frame, rule = trades.over_frames(frames, PAIR, "exact", pair="click/view")
    return trades.trade_table(trades.find_trades(frame, rule))


@query("J8_assembled_trades", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, id, entry_ts, coalesce(exit_ts, limit_ts) AS close_ts FROM id")
def assembled(spark, sf_dir):
    return _trades(spark, sf_dir).select("symbol", "id", "entry_ts", F.coalesce("exit_ts", "limit_ts").alias("close_ts"))


# ---- charts ---------------------------------------------------------------------------------------------------------

LINES = "SELECT 'open' AS series, 'line' AS kind, symbol, ts, open AS y FROM bars UNION ALL SELECT 'close', 'line', symbol, ts, close FROM bars"
CANDLES = "SELECT 'candles' AS series, 'candle' AS kind, symbol, ts, open AS open, high AS high, low AS low, close AS close FROM bars"


@query("G1_lines", f"WITH {BARS} {LINES}")
def lines(spark, sf_dir):
    return charts.line(supplier_bars(spark, sf_dir), "open", "close")


@query("G2_candles", f"WITH {BARS} {CANDLES}")
def candles(spark, sf_dir):
    return charts.candle(supplier_bars(spark, sf_dir))


@query("G3_bars", f"WITH {BARS} SELECT 'volume' AS series, 'bar' AS kind, symbol, ts, volume AS y FROM bars")
def bar_chart(spark, sf_dir):
    return charts.bar(supplier_bars(spark, sf_dir), "volume")


@query("G4_labels", f"WITH {BARS}, {INDEXED} SELECT symbol, idx::INT AS idx, epoch_ms(ts) AS label FROM ix")
def labels(spark, sf_dir):
    return charts.axis_labels(supplier_bars(spark, sf_dir))


def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = supplier_bars(spark, sf_dir)
    return charts.stack(charts.line(b, "open", "close"), charts.candle(b))


@query("G5_bounds", f"WITH {BARS} SELECT least(min(open), min(close), min(low)) - 25 AS y_min, greatest(max(open), max(close), max(high), 0) + 25 AS y_max FROM bars")
def bounds(spark, sf_dir):
    return charts.bounds(_chart(spark, sf_dir))


@query("G6_trade_rects", f"WITH RECURSIVE {TRADE_SQL} SELECT i.symbol, i.id, CASE WHEN i.exit_ts IS NOT NULL THEN 'green_rect' ELSE 'red_rect' END AS kind, i.entry_ts AS x_start, coalesce(i.exit_ts, i.limit_ts) AS x_end, b.close AS strike FROM id i JOIN bars b ON b.symbol = i.symbol AND b.ts = i.entry_ts")
def trade_rects(spark, sf_dir):
    marked = trades.markers(_trades(spark, sf_dir)).join(supplier_bars(spark, sf_dir).select("symbol", "ts", "close"), ["symbol", "ts"])
    return charts.trade_rects(marked)


@query("G7_candle_bodies", f"WITH {BARS} SELECT symbol, ts, least(open, close) AS box_low, greatest(open, close) AS box_high, ((open + close) / 2) AS box_mid, close >= open AS up FROM bars")
def candle_bodies(spark, sf_dir):
    return charts.candle_bodies(supplier_bars(spark, sf_dir))


@query("G8_stacked", f"WITH {BARS} SELECT *, NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, NULL::DOUBLE AS close FROM ({LINES}) UNION ALL SELECT series, kind, symbol, ts, NULL, open, high, low, close FROM ({CANDLES})")
def stacked(spark, sf_dir):
    return _chart(spark, sf_dir)


def _pixels(frm: str, width: int) -> str:
    """CTE ``px``: the rows of ``frm`` with their place, in SQL."""
    return f"""w AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY symbol) AS t0, max(epoch_us(ts)) OVER (PARTITION BY symbol) AS t1 FROM {frm}),
  px AS (SELECT *, (us - t0) // ((t1 - t0) // {width} + 1) AS p FROM w)"""


_PIXEL_LINE = f"""WITH v AS (SELECT event_type AS symbol, ts, value AS y FROM events WHERE value IS NOT NULL AND NOT isnan(value)), {_pixels("v", 200)},
  k AS (SELECT symbol, ts, y, row_number() OVER (q ORDER BY ts, y) AS a, row_number() OVER (q ORDER BY ts DESC, y DESC) AS b, row_number() OVER (q ORDER BY y, ts) AS c, row_number() OVER (q ORDER BY y DESC, ts DESC) AS d
        FROM px WINDOW q AS (PARTITION BY symbol, p))
  SELECT DISTINCT 'value' AS series, 'line' AS kind, symbol, ts, y AS y FROM k WHERE 1 IN (a, b, c, d)"""


@query("G1_pixel_line", _PIXEL_LINE)
def pixel_line(spark, sf_dir):
    """Every event's value as a line of 200 pixels for each kind of event."""
    return charts.pixel_line(table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "value"), "value", 200)


_PIXEL_CANDLES = f"WITH {BARS}, {_pixels('bars', 40)} SELECT 'candles' AS series, 'candle' AS kind, symbol, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM px GROUP BY symbol, p"


@query("G2_pixel_candles", _PIXEL_CANDLES)
def pixel_candles(spark, sf_dir):
    return charts.pixel_candles(supplier_bars(spark, sf_dir), 40)


# ---- aggregates, sorting, paging, scalars ---------------------------------------------------------------------------


@query("A1_sizes", f"WITH {BARS}, {EVENT_BARS} SELECT 'supplier' AS name, count(*) AS n_rows, 7::INT AS n_columns FROM bars UNION ALL SELECT 'events', count(*), 7 FROM ebars")
def frame_sizes(spark, sf_dir):
    return view.sizes({"supplier": supplier_bars(spark, sf_dir), "events": event_bars(spark, sf_dir)})


@query("A2_fit_sums", f"WITH {BARS}, {INDEXED} SELECT symbol, count(close) AS n, round(sum(idx::DOUBLE), 4) AS sum_x, round(sum(close), 4) AS sum_y, round(regr_r2(close, idx), 4) AS r2 FROM ix GROUP BY symbol")
def fit_sums(spark, sf_dir):
    rows = supplier_bars(spark, sf_dir).withColumn("i", calc.row_index().cast("double"))
    return rounded(rows.groupBy("symbol").agg(F.count("close").alias("n"), F.sum("i").alias("sum_x"), F.sum("close").alias("sum_y"), F.regr_r2("close", "i").alias("r2")))


@query("A3_ranges", f"WITH {BARS} SELECT symbol, greatest(max(open), max(high)) AS top, least(min(close), min(low)) AS bottom FROM bars GROUP BY symbol")
def ranges(spark, sf_dir):
    return supplier_bars(spark, sf_dir).groupBy("symbol").agg(F.greatest(F.max("open"), F.max("high")).alias("top"), F.least(F.min("close"), F.min("low")).alias("bottom"))


@query("A6_distinct_rows", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_rows(spark, sf_dir):
    return align.unique_times(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"))


@query("O1_time_order", f"WITH {EVENT_BARS} SELECT symbol, ts, close AS close FROM ebars ORDER BY symbol, ts")
def time_order(spark, sf_dir):
    return view.in_time_order(event_bars(spark, sf_dir).select("symbol", "ts", "close"))


@query("A4_wins", f"WITH RECURSIVE {RESULT_SQL} SELECT symbol, count(*) FILTER (delta > 0) AS won, count(*) FILTER (delta < 0) AS lost FROM r GROUP BY symbol")
def wins(spark, sf_dir):
    return _results(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("delta") > 0).alias("won"), F.count_if(F.col("delta") < 0).alias("lost"))


@query("O2_sorted_page", f"WITH {BARS} SELECT symbol, ts, close AS close FROM bars ORDER BY bars.close DESC NULLS LAST, symbol, ts LIMIT 50 OFFSET 100")
def sorted_page(spark, sf_dir):
    b = supplier_bars(spark, sf_dir).select("symbol", "ts", "close")
    return view.page(view.sort_by(b, "close", True, ("symbol", "ts")), 2, 50)


@query("O3_page_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def page_after(spark, sf_dir):
    return view.page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 100)


@query("O3_page_by_number", f"WITH {BARS} SELECT symbol, ts, close AS close FROM bars ORDER BY bars.close DESC NULLS LAST, symbol, ts LIMIT 100 OFFSET 1700")
def page_by_number(spark, sf_dir):
    """Page 17 of all bars by close: bars are sorted once, then a page opens the ranges that it lies in."""
    b = supplier_bars(spark, sf_dir).select("symbol", "ts", "close")
    return view.Pages.write(b, live.scratch(spark), [F.col("close").desc_nulls_last(), "symbol", "ts"], 100).page(17)


@query("O4_preview", f"WITH {EVENT_BARS} SELECT symbol, ts, close AS close FROM ebars ORDER BY symbol, ts LIMIT 40")
def preview(spark, sf_dir):
    return view.preview(view.in_time_order(event_bars(spark, sf_dir).select("symbol", "ts", "close")))


@query("O5_table_view", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name::VARCHAR), '7') ORDER BY c_custkey DESC NULLS LAST LIMIT 25 OFFSET 25")
def table_view(spark, sf_dir):
    return view.table_view(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "7", "c_name", "c_custkey", True, 1, 25)


@query("D1_parse_day", "SELECT o_orderkey, try_strptime(CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y') || '1341' ELSE strftime(o_orderdate, '%Y%m%d') END, '%Y%m%d') AS day FROM orders")
def parse_day(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("1341"))).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.parse_day(text).alias("day"))


@query("D2_time_forms", "SELECT event_id, date_trunc('millisecond', ts) AS from_ms, date_trunc('second', ts) AS from_s, date_trunc('day', ts)::TIMESTAMP AS from_date FROM events")
def time_forms(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    n = scalar.normalise_time
    return e.select("event_id", n(F.unix_millis("t"), "bigint").alias("from_ms"), n(F.unix_seconds("t").cast("int"), "int").alias("from_s"), n(F.to_date("t"), "date").alias("from_date"))


_calc("D3_finite", lambda: scalar.finite(F.col("close")), f"{FIN} AS value", **_gap)


@query("D5_contains", "SELECT o_orderkey, contains(lower(o_totalprice::VARCHAR), '9') AS has FROM orders")
def contains(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.contains_text(F.col("o_totalprice"), "9").alias("has"))


# ---- sinks ----------------------------------------------------------------------------------------------------------


@query("K1_published_frames", f"WITH {BARS}, {EVENT_BARS} SELECT 'bars' AS frame, symbol::VARCHAR AS symbol, ts, close FROM bars UNION ALL SELECT 'events', symbol, ts, close FROM ebars")
def published_frames(spark, sf_dir):
    paths = sinks.publish({"bars": supplier_bars(spark, sf_dir), "events": event_bars(spark, sf_dir)}, live.scratch(spark))
    read = [spark.read.parquet(paths[name]).select(F.lit(name).alias("frame"), F.col("symbol").cast("string").alias("symbol"), "ts", "close") for name in paths]
    return read[0].unionByName(read[1])


@query("K5_published_bars", f"WITH {BARS} SELECT symbol, ts, open AS open, high AS high, low AS low, close AS close, volume AS volume FROM bars")
def published_bars(spark, sf_dir):
    paths = sinks.publish({"bars": supplier_bars(spark, sf_dir)}, live.scratch(spark))
    return spark.read.parquet(paths["bars"]).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("K2_published_trades", f"WITH RECURSIVE {RESULT_SQL}, q AS ({SUMMARY}) SELECT i.symbol, i.id, i.entry_ts, i.exit_ts, i.limit_ts, r.trade_no, r.delta AS delta, r.entry_open AS middle, q.total_trades FROM id i JOIN r USING (symbol, id) JOIN q ON q.symbol = i.symbol")
def published_trades(spark, sf_dir):
    """Every published trade beside its published result, box and summary."""
    out = trades.back_test(_rule_frame(spark, sf_dir), RULE, supplier_bars(spark, sf_dir))
    paths = sinks.publish(out, live.scratch(spark))
    read = {name: spark.read.schema(sinks.with_bucket(df).schema).parquet(paths[name]) for name, df in out.items()}
    rows = read["trades"].select("symbol", "id", "entry_ts", "exit_ts", "limit_ts").join(read["results"].select("symbol", "id", "trade_no", "delta"), ["symbol", "id"])
    rows = rows.join(read["boxes"].select("symbol", "id", F.col("stop_box")[0]["y"].alias("middle")), ["symbol", "id"])
    return rows.join(read["summary"].select("symbol", "total_trades"), "symbol")


@query("K3_published_chart", f"WITH {BARS} {CANDLES}")
def published_chart(spark, sf_dir):
    paths = sinks.publish({"chart": charts.candle(supplier_bars(spark, sf_dir))}, live.scratch(spark))
    return spark.read.parquet(paths["chart"]).drop("symbol_bucket")


@query("K4_no_trades", f"WITH {BARS} SELECT symbol, '' AS id, ts AS entry_ts, ts AS exit_ts, ts AS limit_ts FROM bars WHERE close < 0")
def no_trades(spark, sf_dir):
    never = trades.Rule(RULE.entry, -1.0, RULE.exit, -1.0, RULE.stop, RULE.hold)
    return trades.trade_table(trades.find_trades(_rule_frame(spark, sf_dir), never))


# ---- long series ----------------------------------------------------------------------------------------------------


def _one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as one series, ordered by ship time, order and line."""
    return long_series.with_index(_lines(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit("all").alias("symbol"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), "l_orderkey", "l_linenumber")


_ONE = "WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice / l_quantity AS close, row_number() OVER o - 1 AS idx, avg(l_extendedprice / l_quantity) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS 13 PRECEDING) AS m FROM lineitem WINDOW o AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity))"


@query("L1_long_series_average", _ONE + " SELECT l_orderkey, l_linenumber, idx, round(CASE WHEN idx >= 13 THEN m END, 4) AS value FROM s")
def long_average(spark, sf_dir):
    out = long_series.bucketed_average(_one_series(spark, sf_dir), "close", "value", 14, 5000)
    return rounded(out.select("l_orderkey", "l_linenumber", "idx", "value"))


_ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_ONE_GAPPED = f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, CASE WHEN l_orderkey % 3 <> 0 AND l_partkey % 7 <> 0 THEN l_extendedprice / l_quantity END AS x FROM lineitem)
  SELECT l_orderkey, l_linenumber, coalesce(last_value(x IGNORE NULLS) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value FROM s"""


@query("L2_long_series_volatility", _ONE.replace("avg(", "stddev_samp(") + " SELECT l_orderkey, l_linenumber, idx, round(CASE WHEN idx >= 13 THEN m ELSE 0 END, 4) AS value FROM s")
def long_volatility(spark, sf_dir):
    out = long_series.bucketed_volatility(_one_series(spark, sf_dir), "close", "value", 14, 5000)
    return rounded(out.select("l_orderkey", "l_linenumber", "idx", "value"))


@query("L3_long_series_repair", _ONE_GAPPED)
def long_repair(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("x", F.when((F.col("l_orderkey") % 3 != 0) & (F.col("ts.l_partkey") % 7 != 0), F.col("close")))
    return long_series.repaired(rows, "x", "value", ["l_orderkey", "l_linenumber"], long_series.ranges(rows))


@query("L4_long_series_asof", f"WITH {BARS}, {FUNDAMENTALS} SELECT b.symbol, b.ts, b.close AS close, CASE WHEN b.ts - f.filed_ts <= INTERVAL 30 DAY THEN f.eps END AS eps FROM bars b ASOF LEFT JOIN fundamentals f ON b.symbol = f.symbol AND b.ts >= f.filed_ts")
def long_asof(spark, sf_dir):
    filed = fundamentals(spark, sf_dir).withColumnRenamed("filed_ts", "ts")
    return long_series.asof_backward(supplier_bars(spark, sf_dir).select("symbol", "ts", "close"), filed, ["eps"], timedelta(days=30), 200)


@query("L5_long_series_trades", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, id, entry_ts, exit_ts, limit_ts FROM id")
def long_trades(spark, sf_dir):
    return trades.trade_table(trades.find_trades(_rule_frame(spark, sf_dir), RULE, picks="doubling"))


@query("T4_entries_by_transitions", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, idx FROM p")
def entries_by_transitions(spark, sf_dir):
    return trades.greedy_picks_by_transitions(trades.signals(_rule_frame(spark, sf_dir), RULE).where("entry").select("symbol", "idx"), RULE.step, 64)


@query("L6_long_series_buckets", f"WITH RECURSIVE {TRADE_SQL} SELECT symbol, id, entry_ts, exit_ts, limit_ts FROM id")
def long_trades_in_buckets(spark, sf_dir):
    return trades.trade_table(trades.find_trades(_rule_frame(spark, sf_dir), RULE, picks="transitions", size=64))


_ONE_FIT = _ONE + ", c AS (SELECT coalesce(regr_slope(close, idx), 0) AS b, coalesce(regr_intercept(close, idx), min(close)) AS a, count(close) AS n FROM s)"


def _one_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_series(spark, sf_dir).drop("idx")


@query("L7_long_series_regression", _ONE_FIT + " SELECT l_orderkey, l_linenumber, round(b * idx + a, 4) AS value FROM s, c")
def long_regression(spark, sf_dir):
    return rounded(long_series.linear_regression(_one_rows(spark, sf_dir), "close", "value").select("l_orderkey", "l_linenumber", "value"))


@query("L8_long_series_coefficients", _FIT + " SELECT symbol, round(a, 4) AS intercept, round(b, 4) AS slope, y0 AS first_value, n FROM c")
def long_coefficients(spark, sf_dir):
    return rounded(long_series.line_coefficients(supplier_bars(spark, sf_dir), "close"), "intercept", "slope")


@query("L9_long_series_median_steps", """WITH t AS (SELECT ts, epoch_us(ts) // 1000 AS ms FROM events), s AS (SELECT ms - lag(ms) OVER (ORDER BY ts) AS step FROM t),
  p AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS k, count(*) OVER () AS n FROM s WHERE step > 0) SELECT 'all' AS symbol, step FROM p WHERE k = n // 2""")
def long_median_steps(spark, sf_dir):
    """All events as one series."""
    return long_series.median_steps(table(spark, sf_dir, "events").select(F.lit("all").alias("symbol"), "ts"))


@query("L10_median_steps", f"WITH {BARS}, {STEPS} SELECT symbol, step FROM p WHERE k = n // 2")
def selected_median_steps(spark, sf_dir):
    return long_series.median_steps(supplier_bars(spark, sf_dir))


# ---- streams --------------------------------------------------------------------------------------------------------

QUERIES |= live.QUERIES
ORACLES |= live.ORACLES
