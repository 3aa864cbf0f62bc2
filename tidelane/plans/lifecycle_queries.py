"""Double-smoothed MACD and the position lifecycle: queries and their SQL, which walks bar by bar."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import lifecycle, performance
from tidelane.plans.kernel_queries import logged, logged_sql
from tidelane.plans.oracle import SO_FAR, W, define, full, prior, rows, sql
from tidelane.plans.trend_queries import _led, ledger_sql, shown, shown_sql
from tidelane.sources import bars
from tidelane.streaming import lifecycle as streamed

QUERIES: dict = {}
SQL: dict[str, str] = {}

define("macd_in", ("adj_1wk",), f"""
  SELECT *, greatest(adj_high - adj_low, abs(adj_high - {prior('px')}), abs(adj_low - {prior('px')})) AS tr,
    adj_high - {prior('adj_high')} AS up, {prior('adj_low')} - adj_low AS down FROM adj_1wk""")
define("macd_x", ("macd_in",), """
  SELECT symbol, bar_ts, i, px, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus FROM macd_in""")


def walk(name: str, m: lifecycle.Macd) -> None:
    """CTEs {name}_walk, _s and _a: the recursive columns with the lengths of m, bar by bar."""
    a = {k: f"(2.0::DOUBLE / {n + 1})" for k, n in (("f", m.fast), ("s", m.slow), ("t", m.trend), ("g", m.signal), ("pf", m.plain_fast), ("ps", m.plain_slow), ("pg", m.plain_signal))}
    rate = f"(1.0::DOUBLE / {m.adx})"
    step = lambda start, old, new, by: f"CASE WHEN i < {start} THEN NULL WHEN i = {start} THEN {new} ELSE {old} + ({new} - {old}) * {by} END"
    line, plain = 2 * m.slow - 2, m.plain_slow - 1
    define(f"{name}_walk", ("macd_x",), f"""
  SELECT symbol, i, px AS ef, px AS es, px AS et, px AS pf, px AS pl, NULL::DOUBLE AS df, NULL::DOUBLE AS ds, NULL::DOUBLE AS dt, NULL::DOUBLE AS s1, NULL::DOUBLE AS s2,
    NULL::DOUBLE AS pg, tr AS atr, plus::DOUBLE AS pdm, minus::DOUBLE AS mdm, {"100 * abs(plus - minus) / nullif(plus + minus, 0)" if m.adx == 1 else "NULL::DOUBLE"} AS adx FROM macd_x WHERE i = 0
  UNION ALL
  SELECT symbol, i, ef, es, et, pf, pl, df, ds, dt, s1, {step(line + m.signal - 1, 'os2', 's1', a['g'])} AS s2, pg, atr, pdm, mdm, adx FROM (
    SELECT *, {step(line, 'os1', 'line', a['g'])} AS s1, {step(plain, 'opg', '(pf - pl)', a['pg'])} AS pg, {step(m.adx - 1, 'oadx', 'dx', rate)} AS adx FROM (
      SELECT *, (2 * ef - df) - (2 * es - ds) AS line, 100 * abs(pdm - mdm) / (pdm + mdm) AS dx FROM (
        SELECT *, {step(m.fast - 1, 'odf', 'ef', a['f'])} AS df, {step(m.slow - 1, 'ods', 'es', a['s'])} AS ds, {step(m.trend - 1, 'odt', 'et', a['t'])} AS dt FROM (
          SELECT x.symbol, x.i, w.ef + (x.px - w.ef) * {a['f']} AS ef, w.es + (x.px - w.es) * {a['s']} AS es, w.et + (x.px - w.et) * {a['t']} AS et,
            w.pf + (x.px - w.pf) * {a['pf']} AS pf, w.pl + (x.px - w.pl) * {a['ps']} AS pl,
            w.atr + (x.tr - w.atr) * {rate} AS atr, w.pdm + (x.plus - w.pdm) * {rate} AS pdm, w.mdm + (x.minus - w.mdm) * {rate} AS mdm,
            w.df AS odf, w.ds AS ods, w.dt AS odt, w.s1 AS os1, w.s2 AS os2, w.pg AS opg, w.adx AS oadx
          FROM {name}_walk w JOIN macd_x x ON x.symbol = w.symbol AND x.i = w.i + 1))))""")
    define(f"{name}_s", (f"{name}_walk",), f"""
  SELECT symbol, i, CASE WHEN i >= {line} THEN (2 * ef - df) - (2 * es - ds) END AS line, CASE WHEN i >= {line + 2 * m.signal - 2} THEN 2 * s1 - s2 END AS signal,
    CASE WHEN i >= {plain} THEN pf - pl END AS plain, CASE WHEN i >= {plain + m.plain_signal - 1} THEN pg END AS plain_signal, CASE WHEN i >= {2 * m.trend - 2} THEN 2 * et - dt END AS base,
    CASE WHEN i >= {m.adx - 1} THEN atr END AS atr, CASE WHEN i >= {m.adx - 1} THEN 100 * pdm / atr END AS plus_di, CASE WHEN i >= {m.adx - 1} THEN 100 * mdm / atr END AS minus_di,
    CASE WHEN i >= {2 * m.adx - 2} THEN adx END AS adx FROM {name}_walk""")
    define(f"{name}_a", (f"{name}_s", "adj_1wk"), f"SELECT a.*, s.* EXCLUDE (symbol, i), line - signal AS hist, plain - plain_signal AS plain_hist FROM adj_1wk a JOIN {name}_s s ON a.symbol = s.symbol AND a.i = s.i")


_HERE = f"{W} ROWS BETWEEN CURRENT ROW AND CURRENT ROW"


def _steady(condition: str, n: int) -> str:
    return f"sum(coalesce({condition}, false)::INT) OVER ({rows(-(n - 1)) if n > 1 else _HERE}) = {n}"




def flags(name: str, m: lifecycle.Macd = lifecycle.Macd()) -> None:
    """CTE {name}: flags and scores of {name}_a."""
    swing = rows(-m.swing, -1)
    define(f"{name}_b", (f"{name}_a",), f"""
  SELECT *, signal - {prior('signal')} AS signal_slope, hist - {prior('hist')} AS hist_slope, base - {prior('base')} AS base_slope,
    coalesce(line > signal AND {prior('line')} <= {prior('signal')}, false) AS bull_cross, coalesce(line < signal AND {prior('line')} >= {prior('signal')}, false) AS bear_cross,
    (px - base) / atr AS extension, {full('min(adj_low)', 'adj_low', m.swing, swing)} AS swing_low, {full('max(adj_high)', 'adj_high', m.swing, swing)} AS swing_high
  FROM {name}_a""")
    recent = rows(-(m.cross_bars - 1)) if m.cross_bars > 1 else _HERE
    define(f"{name}_c", (f"{name}_b",), f"""
  SELECT *, max(bull_cross::INT) OVER ({recent}) = 1 AS recent_bull, max(bear_cross::INT) OVER ({recent}) = 1 AS recent_bear,
    {_steady('signal_slope > 0', m.slope_bars)} AS signal_rising, {_steady('signal_slope < 0', m.slope_bars)} AS signal_falling,
    {_steady('hist_slope > 0', m.histogram_bars)} AS hist_rising, {_steady('hist_slope < 0', m.histogram_bars)} AS hist_falling, coalesce(px < swing_low, false) AS swing_break FROM {name}_b""")
    buy = [("recent_bull", 16), ("line > signal", 10), ("signal_rising", 10), ("hist > 0", 8), ("hist_rising", 8), ("px > base", 10), ("base_slope > 0", 8)]
    buy += [("plain > plain_signal AND plain_hist >= 0", 10)] * m.use_plain + [(f"adx >= {m.adx_least} AND plus_di > minus_di", 8)] * m.use_adx + [(f"extension <= {m.most_extension}", 4)] * m.no_chase
    sell = [("recent_bear", 16), ("line < signal", 10), ("signal_falling", 10), ("hist < 0", 8), ("hist_falling", 10), ("px < base", 10), ("base_slope < 0", 8)]
    sell += [("plain < plain_signal AND plain_hist <= 0", 8)] * m.use_plain + [(f"adx >= {m.adx_least} AND minus_di > plus_di", 6)] * m.use_adx + [("swing_break", 6)]
    total = lambda parts: f"100.0::DOUBLE * ({' + '.join(f'CASE WHEN {c} THEN {w} ELSE 0 END' for c, w in parts)}) / {sum(w for _, w in parts)}"
    define(name, (f"{name}_c",), f"SELECT *, {total(buy)} AS buy_score, {total(sell)} AS sell_score FROM {name}_c")


walk("macd", lifecycle.Macd())
flags("macd")


def cycle(name: str, c: lifecycle.Cycle = lifecycle.Cycle(), source: str = "macd", levels: tuple[str, ...] | None = None) -> None:
    """CTE {name}: the lifecycle with the settings of c, bar by bar.

    levels: buy, watch, reduce and sell, as SQL over source, in place of those of c.
    """
    buy_at, watch_at, reduce_at, sell_at = levels or (c.buy, c.watch, c.reduce, c.sell)
    hope = f"greatest(45, {buy_at} - 15)"
    weak = f"sell_score >= {sell_at}" + " AND recent_bear" * c.need_bear_cross
    define(f"{name}_a", (source,), f"SELECT *, buy_score >= {buy_at} AND recent_bull AS candidate FROM {source}")
    define(f"{name}_x", (f"{name}_a",), f"SELECT *, {_steady('candidate', c.buy_bars)} AS buy_ok, {_steady(weak, c.sell_bars)} AS sell_ok FROM {name}_a")
    state = f"""CASE WHEN shares > 0 THEN CASE WHEN swing_break OR px <= entry * (1 - {c.hard_stop}::DOUBLE) OR coalesce(px <= peak - {c.atr_times} * atr, false) THEN 'RISK EXIT' WHEN sell_ok THEN 'SELL'
      WHEN sell_score >= {reduce_at} THEN 'REDUCE' WHEN sell_score >= {watch_at} THEN 'SELL WATCH' ELSE 'HOLD' END
    ELSE CASE WHEN buy_ok AND rested THEN 'BUY' WHEN (candidate AND NOT rested) OR buy_score >= {hope} THEN 'BUY WATCH' ELSE 'WAIT / CASH' END END"""
    cut = f"w.state = 'REDUCE' AND NOT w.cut_once AND {str(c.execute_reduce).lower()}"
    define(f"{name}_walk", (f"{name}_x",), f"""
  SELECT symbol, i, 0.0::DOUBLE AS shares, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS peak, -1000 AS quit, true AS rested, false AS cut_once,
    CASE WHEN buy_ok THEN 'BUY' WHEN buy_score >= {hope} THEN 'BUY WATCH' ELSE 'WAIT / CASH' END AS state, '' AS executed FROM {name}_x WHERE i = 0
  UNION ALL
  SELECT symbol, i, shares, cash, entry, peak, CASE WHEN state IN ('SELL', 'RISK EXIT') THEN i ELSE quit END::INT, rested, cut_once, state, executed FROM (
    SELECT *, {state} AS state FROM (
      SELECT x.*, CASE WHEN w.state IN ('SELL', 'RISK EXIT') THEN 0 WHEN w.state = 'BUY' THEN w.cash / x.adj_open WHEN {cut} THEN w.shares * 0.5 ELSE w.shares END AS shares,
        CASE WHEN w.state IN ('SELL', 'RISK EXIT') THEN w.cash + w.shares * x.adj_open WHEN w.state = 'BUY' THEN 0
             WHEN {cut} THEN w.cash + w.shares * 0.5 * x.adj_open ELSE w.cash END AS cash,
        CASE WHEN w.state = 'BUY' THEN x.adj_open ELSE w.entry END AS entry,
        CASE WHEN w.state = 'BUY' THEN greatest(x.adj_open, x.px) WHEN w.shares > 0 THEN greatest(w.peak, x.px) ELSE w.peak END AS peak,
        CASE WHEN w.state = 'BUY' THEN false ELSE w.cut_once OR ({cut}) END AS cut_once,
        w.quit, x.i - w.quit >= {c.cooldown} AS rested, CASE WHEN w.state IN ('SELL', 'RISK EXIT', 'BUY') OR ({cut}) THEN w.state ELSE '' END AS executed
      FROM {name}_walk w JOIN {name}_x x ON x.symbol = w.symbol AND x.i = w.i + 1))""")
    define(f"{name}_y", (f"{name}_walk",), f"""
  SELECT x.*, w.shares, w.cash, w.state, w.executed, w.rested, w.shares * x.px + w.cash AS portfolio, (w.executed = 'BUY')::INT AS first_buy,
    (w.executed IN ('SELL', 'RISK EXIT'))::INT AS first_sell, (w.executed = 'REDUCE')::INT AS reduced, CASE WHEN w.shares > 0 THEN w.entry END AS entry,
    CASE WHEN w.shares > 0 THEN w.peak END AS peak, CASE WHEN w.shares > 0 THEN w.entry * (1 - {c.hard_stop}::DOUBLE) END AS hard_stop,
    CASE WHEN w.shares > 0 THEN w.peak - {c.atr_times} * x.atr END AS atr_stop FROM {name}_x x JOIN {name}_walk w ON x.symbol = w.symbol AND x.i = w.i""")
    hit = "concat_ws(', ', CASE WHEN px <= hard_stop THEN 'hard stop' END, CASE WHEN px <= atr_stop THEN 'trailing stop' END, CASE WHEN shares > 0 AND swing_break THEN 'swing low' END)"
    define(name, (f"{name}_y",), f"""
  SELECT *, {hit} AS breaches, CASE state WHEN 'RISK EXIT' THEN 'capital protection: ' || {hit} WHEN 'SELL' THEN printf('sell score %.1f confirmed for {c.sell_bars} bars', sell_score)
    WHEN 'REDUCE' THEN printf('sell score %.1f in the reduce tier', sell_score) WHEN 'SELL WATCH' THEN printf('sell score %.1f in the watch tier', sell_score)
    WHEN 'HOLD' THEN printf('held, sell score %.1f', sell_score) WHEN 'BUY' THEN printf('buy score %.1f confirmed', buy_score)
    WHEN 'BUY WATCH' THEN CASE WHEN candidate AND NOT rested THEN printf('candidate at %.1f waits for the cooldown', buy_score) ELSE printf('buy score %.1f improves', buy_score) END
    ELSE printf('no entry, buy score %.1f', buy_score) END AS reason FROM {name}_y""")


cycle("cycle")
cycle("cycle_cut", lifecycle.Cycle(need_bear_cross=True, execute_reduce=True))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.indicator(bars.load(spark, sf_dir, "1wk"))


def cycled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.lifecycle(measured(spark, sf_dir))


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle that sells half at REDUCE, and all only after a recent cross downwards."""
    return lifecycle.lifecycle(measured(spark, sf_dir), lifecycle.Cycle(need_bear_cross=True, execute_reduce=True))


_sm = (["symbol", "bar_ts"], ["line", "signal", "plain", "plain_signal", "base", "atr"], ["plus_di", "minus_di", "adx"])
QUERIES["w39_smoothed"] = lambda s, d: shown(lifecycle.smoothed(bars.load(s, d, "1wk")), *_sm)
SQL["w39_smoothed"] = sql(shown_sql("macd", *_sm), "macd", recursive=True)
QUERIES["w39_scan"] = lambda s, d: shown(lifecycle.smoothed_by_scan(bars.load(s, d, "1wk")), *_sm)
SQL["w39_scan"] = SQL["w39_smoothed"]
_in = (["symbol", "bar_ts", "bull_cross", "bear_cross", "recent_bull", "recent_bear", "signal_rising", "hist_falling", "swing_break"], ["hist", "plain_hist", "hist_slope", "swing_low", "swing_high"], ["extension"])
QUERIES["w43_macd"] = lambda s, d: shown(measured(s, d), *_in)
SQL["w43_macd"] = sql(shown_sql("macd", *_in), "macd", recursive=True)
_scr = (["symbol", "bar_ts"], [], ["buy_score", "sell_score"])
QUERIES["w48_scores"] = lambda s, d: shown(measured(s, d), *_scr)
SQL["w48_scores"] = sql(shown_sql("macd", *_scr), "macd", recursive=True)
_cy = (["symbol", "bar_ts", "state", "executed", "first_buy", "first_sell"], [], ["log_cash", "log_portfolio", "log_shares"])
QUERIES["t14_lifecycle"] = lambda s, d: shown(logged(cycled(s, d)), *_cy)
SQL["t14_lifecycle"] = sql(shown_sql(logged_sql("cycle", "cash", "portfolio", "shares"), *_cy), "cycle", recursive=True)
QUERIES["stream_lifecycle"] = lambda s, d: shown(logged(streamed.replay(s, bars.load(s, d, "1wk"))), *_cy)
SQL["stream_lifecycle"] = SQL["t14_lifecycle"]
QUERIES["l02_lifecycle_trades"] = lambda s, d: shown(performance.trades(cycled(s, d)).withColumn("days", F.col("days").cast("long")), *_led)
SQL["l02_lifecycle_trades"] = ledger_sql("cycle", shown_sql("l", *_led)).replace("WITH ", "WITH RECURSIVE ", 1)
_ev = (["symbol", "bar_ts", "state", "executed"], ["px"], ["buy_score", "sell_score"])
QUERIES["l03_events"] = lambda s, d: shown(lifecycle.events(cycled(s, d)), *_ev)
SQL["l03_events"] = sql(f"""
, e AS (SELECT *, coalesce(state <> {prior('state')}, true) AS changed FROM cycle)
{shown_sql("e WHERE (state NOT IN ('HOLD', 'WAIT / CASH') AND changed) OR executed <> ''", *_ev)}""", "cycle", recursive=True)
_eq = (["symbol", "bar_ts", "bars", "false_exit"], ["exit_price"], ["worst", "best", "utility"])
QUERIES["a21_exit_quality"] = lambda s, d: shown(lifecycle.exit_quality(cycled(s, d)), *_eq)
SQL["a21_exit_quality"] = sql(f"""
, e AS (SELECT *, min(px) OVER k AS lowest, max(px) OVER k AS highest, count(px) OVER k AS bars FROM cycle WINDOW k AS ({W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
f AS (SELECT symbol, bar_ts, bars, adj_open AS exit_price, lowest / adj_open - 1 AS worst, highest / adj_open - 1 AS best FROM e WHERE first_sell = 1 AND bars > 0),
g AS (SELECT *, greatest(0, -worst) - greatest(0, best) AS utility, greatest(0, best) > greatest(0, -worst) + 0.03 AS false_exit FROM f)
{shown_sql('g', *_eq)}""", "cycle", recursive=True)
_cut = (["symbol", "bar_ts", "state", "executed", "reason", "first_buy", "first_sell", "reduced"], ["hard_stop", "atr_stop", "peak"], ["log_cash", "log_portfolio", "log_shares"])
QUERIES["t13_lifecycle_reduce"] = lambda s, d: shown(logged(cut(s, d)), *_cut)
SQL["t13_lifecycle_reduce"] = sql(shown_sql(logged_sql("cycle_cut", "cash", "portfolio", "shares"), *_cut), "cycle_cut", recursive=True)
_why = (["symbol", "bar_ts", "state", "reason", "rested"], ["hard_stop", "atr_stop", "entry", "peak"])
QUERIES["t13_lifecycle_reasons"] = lambda s, d: shown(cycled(s, d), *_why)
SQL["t13_lifecycle_reasons"] = sql(shown_sql("cycle", *_why), "cycle", recursive=True)
_led2 = (["symbol", "trade", "entry_ts", "exit_ts", "bars", "days", "exit_type", "status"], ["entry_price", "exit_price"], ["trade_return", "giveback"])
QUERIES["l02_lifecycle_ledger"] = lambda s, d: shown(lifecycle.trades(cut(s, d)), *_led2)
SQL["l02_lifecycle_ledger"] = sql(f"""
, t AS (SELECT *, sum(first_buy) OVER ({SO_FAR}) AS trade FROM cycle_cut),
u AS (SELECT symbol, trade::BIGINT AS trade, min(bar_ts) AS entry_ts, arg_min(adj_open, bar_ts) AS entry_price, max(CASE WHEN first_sell = 1 THEN bar_ts END) AS exit_ts,
  max(CASE WHEN first_sell = 1 THEN adj_open END) AS exit_price, coalesce(max(CASE WHEN first_sell = 1 THEN executed END), 'OPEN') AS exit_type, count(*) - 1 AS bars,
  max(px) AS peak, date_diff('day', min(bar_ts), max(bar_ts)) AS days, arg_max(px, bar_ts) AS last_price FROM t WHERE trade > 0 AND (shares > 0 OR first_sell = 1) GROUP BY symbol, trade),
v AS (SELECT *, coalesce(exit_price, last_price) / entry_price - 1 AS trade_return, coalesce(exit_price, last_price) / peak - 1 AS giveback,
  CASE WHEN exit_ts IS NULL THEN 'OPEN / MARK-TO-MARKET' ELSE 'CLOSED' END AS status FROM u)
{shown_sql('v', *_led2)}""", "cycle_cut", recursive=True)
_ev2 = (["symbol", "bar_ts", "state", "executed", "reason"], ["px", "line", "signal", "hist"], ["buy_score", "sell_score", "adx"])
QUERIES["l03_event_reasons"] = lambda s, d: shown(lifecycle.events(cut(s, d)), *_ev2)
SQL["l03_event_reasons"] = sql(f"""
, e AS (SELECT *, coalesce(state <> {prior('state')}, true) AS changed FROM cycle_cut)
{shown_sql("e WHERE (state NOT IN ('HOLD', 'WAIT / CASH') AND changed) OR executed <> ''", *_ev2)}""", "cycle_cut", recursive=True)
_sum = (["symbol", "exits"], [], ["avoided", "foregone", "utility", "false_exits"])
QUERIES["a21_exit_summary"] = lambda s, d: shown(lifecycle.exit_summary(lifecycle.exit_quality(cycled(s, d))), *_sum)
SQL["a21_exit_summary"] = sql(f"""
, e AS (SELECT *, min(px) OVER k AS lowest, max(px) OVER k AS highest, count(px) OVER k AS bars FROM cycle WINDOW k AS ({W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
f AS (SELECT symbol, greatest(0, 1 - lowest / adj_open) AS a, greatest(0, highest / adj_open - 1) AS b FROM e WHERE first_sell = 1 AND bars > 0),
g AS (SELECT symbol, count(*) AS exits, avg(a) AS avoided, avg(b) AS foregone, avg(a - b) AS utility, avg((b > a + 0.03)::INT) AS false_exits FROM f GROUP BY symbol)
{shown_sql('g', *_sum)}""", "cycle", recursive=True)
_ot = (["symbol", "last_exit_asked"], ["entry_price", "peak"])
QUERIES["t15_open_trades"] = lambda s, d: shown(lifecycle.open_trades(cut(s, d)), *_ot)
SQL["t15_open_trades"] = sql(f"""
, z AS (SELECT *, {prior('bar_ts')} AS asked FROM cycle_cut),
y AS (SELECT symbol, max(CASE WHEN first_sell = 1 THEN asked END) AS last_exit_asked, last(entry ORDER BY bar_ts) AS entry_price, last(peak ORDER BY bar_ts) AS peak FROM z GROUP BY symbol)
{shown_sql('y', *_ot)}""", "cycle_cut", recursive=True)
_sn = (["symbol", "bar_ts", "decision", "position", "reason"], ["hard_stop", "atr_stop", "swing_stop"], ["buy_score", "sell_score", "spread"])
_LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1"
QUERIES["l10_lifecycle_snapshot"] = lambda s, d: shown(lifecycle.snapshot(cut(s, d)), *_sn)
SQL["l10_lifecycle_snapshot"] = sql(f"""
, z AS (SELECT *, state AS decision, CASE WHEN shares > 0 THEN 'LONG' ELSE 'CASH' END AS position, swing_low AS swing_stop, buy_score - sell_score AS spread FROM cycle_cut {_LAST})
{shown_sql('z', *_sn)}""", "cycle_cut", recursive=True)
QUERIES["l10_lifecycle_gates"] = lambda s, d: lifecycle.snapshot(cut(s, d)).select("symbol", "bar_ts", F.inline("gates"))
_turn = lambda up, down, other: f"CASE WHEN {up} THEN 'BULLISH' WHEN {down} THEN 'BEARISH' ELSE '{other}' END"
_obs = lambda form, k: f"coalesce(printf('{form}', {k}), 'warming up')"
_gates = [
    ("trigger", "CASE WHEN recent_bull THEN 'BULL CROSS' WHEN recent_bear THEN 'BEAR CROSS' ELSE 'NO RECENT CROSS' END", _obs("%.4f", "line")),
    ("momentum", _turn("signal_rising AND hist > 0", "signal_falling AND hist < 0", "MIXED"), _obs("%.4f", "hist")),
    ("trend", _turn("px > base AND base_slope > 0", "px < base AND base_slope < 0", "MIXED"), _obs("%.2f", "extension")),
    ("strength", _turn("plus_di > minus_di", "minus_di > plus_di", "NEUTRAL"), _obs("%.1f", "adx")),
    ("path", "'NOT ACTIVE'", "'not supplied'"),
    ("protection", "CASE WHEN breaches <> '' THEN 'RISK EXIT' ELSE 'CLEAR' END", "CASE WHEN breaches <> '' THEN breaches ELSE 'no breach' END"),
    ("state", "state", "CASE WHEN shares > 0 THEN 'LONG' ELSE 'CASH' END"),
]
SQL["l10_lifecycle_gates"] = sql(
    f", z AS (SELECT * FROM cycle_cut {_LAST})\n"
    + "\nUNION ALL ".join(f"SELECT symbol, bar_ts, {i + 1}::INT AS place, '{g}' AS gate, {a} AS status, {b} AS observed FROM z" for i, (g, a, b) in enumerate(_gates)),
    "cycle_cut",
    recursive=True,
)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states, and how many bars and orders of each symbol's lifecycle have each."""
    x = cut(spark, sf_dir)
    used = x.groupBy("symbol", "state").agg(F.count("*").alias("bars"))
    done = x.where("executed <> ''").groupBy("symbol", F.col("executed").alias("state")).agg(F.count("*").alias("fills"))
    every = used.select("symbol").distinct().crossJoin(F.broadcast(lifecycle.states(spark)))
    out = every.join(used, ["symbol", "state"], "left").join(done, ["symbol", "state"], "left")
    return out.select("symbol", "place", "state", "meaning", "execution", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("bars", "fills")])


QUERIES["l14_states"] = states
SQL["l14_states"] = sql(
    ", v AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(lifecycle.STATES)) + """) v(place, state, meaning, execution))
SELECT symbol, place, v.state, meaning, execution, count(*) FILTER (c.state = v.state) AS bars, count(*) FILTER (c.executed = v.state) AS fills
FROM cycle_cut c, v GROUP BY ALL""",
    "cycle_cut",
    recursive=True,
)


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets' settings, and how often each preset trades and where it stands, for each symbol."""
    b = bars.load(spark, sf_dir, "1wk")
    runs = None
    for name, (m, c) in lifecycle.PRESETS.items():
        x = lifecycle.lifecycle(lifecycle.indicator(b, m), c)
        x = x.groupBy("symbol").agg(F.sum("first_buy").alias("buys"), F.sum("first_sell").alias("sales"), F.max_by("state", "bar_ts").alias("state")).withColumn("preset", F.lit(name))
        runs = x if runs is None else runs.unionByName(x)
    return runs.join(F.broadcast(lifecycle.preset_table(spark)), "preset").select("symbol", "preset", "setting", "value", "buys", "sales", "state")


QUERIES["t16_presets"] = presets
_settings = ", ".join(f"('{name}', '{k}', '{v}')" for name, both in lifecycle.PRESETS.items() for part in both for k, v in asdict(part).items())
for _name, (_m, _c) in lifecycle.PRESETS.items():
    walk(f"pre_{_name}_m", _m)
    flags(f"pre_{_name}_m", _m)
    cycle(f"pre_{_name}", _c, source=f"pre_{_name}_m")
_runs = " UNION ALL ".join(f"SELECT '{name}' AS preset, symbol, sum(first_buy)::BIGINT AS buys, sum(first_sell)::BIGINT AS sales, arg_max(state, bar_ts) AS state FROM pre_{name} GROUP BY symbol" for name in lifecycle.PRESETS)
SQL["t16_presets"] = sql(
    f", p AS (SELECT * FROM (VALUES {_settings}) v(preset, setting, value)) SELECT symbol, preset, setting, value, buys, sales, state FROM ({_runs}) r JOIN p USING (preset)",
    *[f"pre_{name}" for name in lifecycle.PRESETS],
    recursive=True,
)
