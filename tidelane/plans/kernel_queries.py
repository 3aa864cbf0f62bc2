"""Kernel regression, benchmark-relative statistics and staged exposure: queries and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.windows import rounded
from tidelane.operators import kernel, performance, relative, tactical
from tidelane.plans import oracle
from tidelane.plans.oracle import W, define, full, prior, r, rows, sql
from tidelane.plans.trend_queries import ledger_sql, shown, shown_sql, summary_query, summary_sql, _led
from tidelane.sources import bars
from tidelane.sources.bars import adjusted

QUERIES: dict = {}
SQL: dict[str, str] = {}
KERNEL = kernel.Kernel(lookback=40)
COMPACT = kernel.Kernel(lookback=30, bandwidth=20, kernel="quartic", source="ohlc4")
REL = relative.Relative()
TAC = tactical.Tactical()

oracle.kernel("1wk", "nw_1wk", KERNEL.weights(), KERNEL.band)
oracle.kernel("1d", "nw_1d", COMPACT.weights(), COMPACT.band, "(adj_open + adj_high + adj_low + px) / 4")
oracle.kernel_strategy("nw_1wk", "nws_1wk")
oracle.kernel_strategy("nw_1d", "nws_1d", reversal=True)
oracle.relative("1wk", "rel_1wk")


def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.indicator(bars.load(spark, sf_dir, "1wk"), KERNEL)


def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.strategy(indicator(spark, sf_dir))


def reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = kernel.indicator(bars.load(spark, sf_dir, "1d"), COMPACT)
    return kernel.strategy(x, kernel.Rules(mode="reversal"))


def against(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.load(spark, sf_dir, "1wk")
    return relative.analytics(b, relative.next_symbol(b), REL)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tactical.features(indicator(spark, sf_dir), against(spark, sf_dir), TAC)
    return tactical.decisions(x, TAC)


# Kernel weights of all six shapes.
_SHAPES = ["gaussian", "rational_quadratic", "epanechnikov", "triangular", "quartic", "cosine"]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each symbol's last mean is made of: weight, share and price by lag, for every shape."""
    out = None
    for shape in _SHAPES:
        p = kernel.profile(spark, kernel.Kernel(lookback=12, kernel=shape)).withColumn("kernel", F.lit(shape))
        out = p if out is None else out.unionByName(p)
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_ts"))) - 1
    last = adjusted(bars.load(spark, sf_dir, "1wk")).withColumn("lag", back).where("lag <= 12")
    return shown(last.select("symbol", "lag", "px").join(F.broadcast(out), "lag"), ["symbol", "kernel", "lag"], ["px"], ["weight", "share"])


QUERIES["w11_kernel_profiles"] = profiles
SQL["w11_kernel_profiles"] = sql(f"""
, l AS (SELECT range::INT AS lag, range / 8.0::DOUBLE AS u FROM range(13)),
w AS (SELECT 'gaussian' AS kernel, lag, exp(-u * u / 2) AS weight FROM l
  UNION ALL SELECT 'rational_quadratic', lag, pow(1 + u * u / 2, -1) FROM l
  UNION ALL SELECT 'epanechnikov', lag, CASE WHEN u <= 1 THEN 0.75 * (1 - u * u) ELSE 0 END FROM l
  UNION ALL SELECT 'triangular', lag, CASE WHEN u <= 1 THEN 1 - u ELSE 0 END FROM l
  UNION ALL SELECT 'quartic', lag, CASE WHEN u <= 1 THEN 15.0 / 16 * pow(1 - u * u, 2) ELSE 0 END FROM l
  UNION ALL SELECT 'cosine', lag, CASE WHEN u <= 1 THEN pi() / 4 * cos(pi() * u / 2) ELSE 0 END FROM l),
x AS (SELECT kernel, lag, weight, weight / sum(weight) OVER (PARTITION BY kernel) AS share FROM w),
z AS (SELECT symbol, px, (row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) - 1) AS lag FROM adj_1wk)
SELECT symbol, kernel, x.lag, {r('px', 4)} AS px, {r('weight')} AS weight, {r('share')} AS share FROM x JOIN z ON z.lag = x.lag""", "adj_1wk")

_flags = ["bull_reversal", "bear_reversal", "cross_above_upper", "cross_below_lower", "momentum_up", "momentum_down", "above_path", "below_path"]
_nw = (["symbol", "bar_ts", "direction", *_flags], ["src", "trend", "residual", "upper", "lower", "slope", "bull_marker", "down_marker"], ["norm_slope", "accel", "price_gap", "band_width"])
QUERIES["w13_kernel_indicator"] = lambda s, d: shown(indicator(s, d), *_nw)
SQL["w13_kernel_indicator"] = sql(shown_sql("nw_1wk", *_nw), "nw_1wk")
QUERIES["w13_kernel_indicator_ohlc4"] = lambda s, d: shown(kernel.indicator(bars.load(s, d, "1d"), COMPACT), *_nw)
SQL["w13_kernel_indicator_ohlc4"] = sql(shown_sql("nw_1d", *_nw), "nw_1d")

# Wealth grows beyond what a double shows to a fixed digit on these prices: its logarithm is compared.
LOGS = {"cash": "log_cash", "portfolio": "log_portfolio", "shares": "log_shares", "traded": "log_traded"}


def logged(df: DataFrame) -> DataFrame:
    return df.withColumns({new: F.log1p(old) for old, new in LOGS.items() if old in df.columns})


def logged_sql(source: str, *columns: str) -> str:
    return f"(SELECT *, {', '.join(f'ln(1 + {c}) AS {LOGS[c]}' for c in columns)} FROM {source})"


_pos = (["symbol", "bar_ts", "signal", "first_buy", "first_sell", "enter", "leave"], ["buy_hold"], ["log_cash", "log_portfolio", "log_shares"])
for _n, _f in (("nws_1wk", strategy), ("nws_1d", reversals)):
    QUERIES[f"t04_kernel_strategy_{_n}"] = lambda s, d, f=_f: shown(logged(f(s, d)), *_pos)
    SQL[f"t04_kernel_strategy_{_n}"] = sql(shown_sql(logged_sql(_n, "cash", "portfolio", "shares"), *_pos), _n)
    QUERIES[f"l01_trades_{_n}"] = lambda s, d, f=_f: shown(performance.trades(f(s, d)).withColumn("days", F.col("days").cast("long")), *_led)
    SQL[f"l01_trades_{_n}"] = ledger_sql(_n, shown_sql("l", *_led))
QUERIES["a01_performance_nws_1wk"] = lambda s, d: summary_query(strategy(s, d))
SQL["a01_performance_nws_1wk"] = summary_sql("nws_1wk")

_al = (["symbol", "bar_ts", "alert"], ["price", "trend"])
QUERIES["l04_alerts"] = lambda s, d: shown(kernel.alerts(indicator(s, d)), *_al)
_alerts_sql = ", a AS (" + " UNION ALL ".join(
    f"SELECT symbol, bar_ts, '{v}' AS alert, src AS price, trend FROM nw_1wk WHERE {k}" for k, v in kernel.ALERTS.items()
) + ") "
SQL["l04_alerts"] = sql(_alerts_sql + shown_sql("a", *_al), "nw_1wk")
_tape = (["symbol", "bar_ts", "place", "alert", "origin", "state"], ["price", "trend", "upper", "lower"], ["norm_slope", "accel"])
QUERIES["l04_alert_tape"] = lambda s, d: shown(kernel.alert_tape(indicator(s, d)), *_tape)
SQL["l04_alert_tape"] = sql(
    ", a AS (" + " UNION ALL ".join(
        f"SELECT symbol, bar_ts, '{v}' AS alert, '{kernel.ALERT_STATES[v][0]}' AS origin, '{kernel.ALERT_STATES[v][1]}' AS state, src AS price, trend, upper, lower, norm_slope, accel FROM nw_1wk WHERE {k}"
        for k, v in kernel.ALERTS.items()
    ) + "), z AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY bar_ts, origin, alert))::INT AS place FROM a) " + shown_sql("z", *_tape),
    "nw_1wk",
)
QUERIES["o04_newest_alerts"] = lambda s, d: shown(
    kernel.alerts(indicator(s, d)).orderBy(F.desc("bar_ts"), "symbol", "alert").limit(40), *_al
)
SQL["o04_newest_alerts"] = sql(
    _alerts_sql + shown_sql("(SELECT * FROM a ORDER BY bar_ts DESC, symbol, alert LIMIT 40)", *_al), "nw_1wk"
)
_last = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS back FROM "
QUERIES["l07_kernel_gates"] = lambda s, d: kernel.gate_matrix(kernel.snapshot(strategy(s, d)))
SQL["l07_kernel_gates"] = sql(f"""
, z AS (SELECT *, CASE WHEN trend IS NULL THEN 'DATA STOP' WHEN held = 1 AND leave THEN 'SELL' WHEN held = 1 THEN 'HOLD' WHEN enter THEN 'BUY' ELSE 'WAIT' END AS action
        FROM ({_last} nws_1wk) WHERE back = 1)
SELECT symbol, bar_ts, action, 'path available' AS gate, trend IS NOT NULL AS passed FROM z
UNION ALL SELECT symbol, bar_ts, action, 'direction up', direction > 0 FROM z
UNION ALL SELECT symbol, bar_ts, action, 'above path', above_path FROM z
UNION ALL SELECT symbol, bar_ts, action, 'below upper band', coalesce(src <= upper, false) FROM z""", "nws_1wk")

_rel = (["symbol", "bar_ts"], ["bench"], ["aligned", "beta", "alpha", "resid", "resid_z", "drift", "drift_z", "ratio_z", "asset_h", "bench_h", "relative_h"])
QUERIES["w29_relative"] = lambda s, d: shown(against(s, d), *_rel)
SQL["w29_relative"] = sql(shown_sql("rel_1wk", *_rel), "rel_1wk")
QUERIES["j01_aligned"] = lambda s, d: (lambda b: shown(relative.aligned(b, relative.next_symbol(b)), ["symbol", "bar_ts", "matched"], ["px", "bench"], ["aligned"]))(bars.load(s, d, "1d"))
oracle.relative("1d", "rel_1d")
SQL["j01_aligned"] = sql(shown_sql("rel_1d_a", ["symbol", "bar_ts", "matched"], ["px", "bench"], ["aligned"]), "rel_1d_a")
_rs = (["symbol", "status", "bar_ts"], [], ["drift_z", "resid_z", "beta", "ratio_z", "relative_h"])
QUERIES["a13_relative_snapshot"] = lambda s, d: shown(relative.snapshot(against(s, d)), *_rs)
SQL["a13_relative_snapshot"] = sql(f"""
, z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY drift_z IS NULL, bar_ts DESC) AS back FROM rel_1wk),
y AS (SELECT symbol, CASE WHEN drift_z IS NULL THEN 'UNAVAILABLE' WHEN drift_z <= -3 THEN 'EXTREME RELATIVE BREAKDOWN' WHEN drift_z <= -2 THEN 'STRONG RELATIVE WEAKNESS'
      WHEN drift_z <= -1.5 THEN 'RELATIVE WEAKNESS' WHEN drift_z >= 3 THEN 'EXTREME RELATIVE OVEREXTENSION' WHEN drift_z >= 2 THEN 'STRONG RELATIVE OUTPERFORMANCE'
      WHEN drift_z >= 1.5 THEN 'RELATIVE OUTPERFORMANCE' ELSE 'NORMAL RELATIVE RANGE' END AS status,
      CASE WHEN drift_z IS NOT NULL THEN bar_ts END AS bar_ts, drift_z, CASE WHEN drift_z IS NOT NULL THEN resid_z END AS resid_z,
      CASE WHEN drift_z IS NOT NULL THEN beta END AS beta, CASE WHEN drift_z IS NOT NULL THEN ratio_z END AS ratio_z,
      CASE WHEN drift_z IS NOT NULL THEN relative_h END AS relative_h FROM z WHERE back = 1)
{shown_sql('y', *_rs)}""", "rel_1wk")

# Staged exposure. The SQL walks bar by bar, so it checks the window form by another way.
define("tac_a", ("nw_1wk", "rel_1wk"), f"""
  SELECT n.*, q.drift_z,
    coalesce(src <= upper AND lag(src) OVER (PARTITION BY n.symbol ORDER BY n.bar_ts) > lag(upper) OVER (PARTITION BY n.symbol ORDER BY n.bar_ts), false) AS reenter_below_upper,
    coalesce(src >= lower AND lag(src) OVER (PARTITION BY n.symbol ORDER BY n.bar_ts) < lag(lower) OVER (PARTITION BY n.symbol ORDER BY n.bar_ts), false) AS reenter_above_lower
  FROM nw_1wk n JOIN rel_1wk q ON n.symbol = q.symbol AND n.bar_ts = q.bar_ts""")
define("tac_b", ("tac_a",), f"""
  SELECT *, (src - trend) / (upper - trend) AS envelope_z, volume / {full('median(volume)', 'volume', 20, rows(-20, -1))} AS relative_volume,
    coalesce(src < trend AND {prior('src')} >= {prior('trend')}, false) AS cross_below_path,
    coalesce(src > trend AND {prior('src')} <= {prior('trend')}, false) AS cross_above_path FROM tac_a""")
define("tac_c", ("tac_b",), """
  SELECT *, CASE WHEN trend IS NULL OR drift_z IS NULL THEN 1 WHEN cross_below_lower AND direction < 0 THEN 2 WHEN drift_z <= -3 THEN 3
    WHEN below_path AND bear_reversal AND drift_z <= -2 THEN 4
    WHEN reenter_below_upper AND (direction < 0 OR bear_reversal) AND drift_z >= 1.5 THEN 5 WHEN reenter_below_upper THEN 6
    WHEN cross_above_upper AND (drift_z >= 2 OR coalesce(relative_volume >= 1.5, false)) THEN 7 WHEN cross_above_upper THEN 8
    WHEN drift_z >= 3 AND coalesce(accel < 0, false) THEN 9 WHEN drift_z <= -2 THEN 10
    WHEN drift_z <= -1.5 AND (below_path OR direction < 0) THEN 11 WHEN bear_reversal THEN 12
    WHEN reenter_above_lower AND bull_reversal AND drift_z <= -1.5 THEN 13 WHEN bull_reversal AND above_path AND drift_z > -1.5 THEN 14
    WHEN above_path AND direction > 0 AND drift_z >= 0 THEN 15 ELSE 16 END AS place FROM tac_b""")
_NAMES = "[" + ", ".join(f"'{n}'" for n, *_ in tactical.RULES) + "]"
_WALK = """
  SELECT symbol, i, 1.0::DOUBLE AS target, 0.0::DOUBLE AS change, 'INITIALIZE 100% EXPOSURE' AS action, 100000.0 / px AS shares, 0.0::DOUBLE AS cash,
         0.0::DOUBLE AS traded, 0.0::DOUBLE AS turnover FROM tac_c WHERE i = 0
  UNION ALL
  SELECT symbol, i, target, change, action,
    CASE WHEN change <> 0 THEN target * equity / adj_open ELSE old_shares END,
    CASE WHEN change <> 0 THEN equity - target * equity ELSE old_cash END,
    CASE WHEN change <> 0 THEN abs(target * equity / adj_open - old_shares) * adj_open ELSE 0 END,
    CASE WHEN change <> 0 THEN abs(target * equity / adj_open - old_shares) * adj_open / equity ELSE 0 END
  FROM (
    SELECT *, target - before AS change,
      CASE WHEN p BETWEEN 2 AND 12 AND before <= 0 THEN 'WAIT / CASH'
           WHEN target < before AND target <= 0 THEN 'SELL / EXIT TO CASH — 0%'
           WHEN target < before THEN 'REDUCE TO ' || round(100 * target)::INT || '%'
           WHEN target > before THEN 'BUY / RESTORE TO ' || round(100 * target)::INT || '%'
           WHEN p BETWEEN 2 AND 15 THEN 'HOLD ' || round(100 * before)::INT || '%' ELSE 'HOLD' END AS action
    FROM (
      SELECT c.symbol, c.i, c.adj_open, y.place AS p, w.target AS before, w.shares AS old_shares, w.cash AS old_cash, w.cash + w.shares * c.adj_open AS equity,
        CASE WHEN y.place BETWEEN 2 AND 4 THEN least(w.target, 0.0) WHEN y.place IN (5, 10) THEN least(w.target, 0.25)
             WHEN y.place IN (6, 7, 11) THEN least(w.target, 0.5) WHEN y.place IN (8, 9, 12) THEN least(w.target, 0.75)
             WHEN y.place = 13 THEN greatest(w.target, 0.5) WHEN y.place = 14 THEN greatest(w.target, 0.75)
             WHEN y.place = 15 THEN greatest(w.target, 1.0) ELSE w.target END::DOUBLE AS target
      FROM walk w JOIN tac_c c ON c.symbol = w.symbol AND c.i = w.i + 1 JOIN tac_c y ON y.symbol = w.symbol AND y.i = w.i))"""
define("walk", ("tac_c",), _WALK)
define("tac", ("walk",), f"""
  SELECT c.symbol, c.bar_ts, c.px, c.adj_open, c.i, {_NAMES}[c.place] AS rule, w.target, w.change, w.action, w.shares, w.cash, w.traded, w.turnover,
    w.shares * c.px + w.cash AS portfolio, w.shares * c.px / (w.shares * c.px + w.cash) AS exposure,
    100000.0 * c.px / first_value(c.px) OVER (PARTITION BY c.symbol ORDER BY c.bar_ts) AS buy_hold
  FROM tac_c c JOIN walk w ON c.symbol = w.symbol AND c.i = w.i""")

# From cash, and back to the target at every open.
EVERY = tactical.Tactical(start=0.0, every_bar=True)
_walk_0 = _WALK.replace("FROM walk w", "FROM walk_0 w").replace("change <> 0", "true").replace("1.0::DOUBLE AS target", "0.0::DOUBLE AS target", 1)
_walk_0 = _walk_0.replace("INITIALIZE 100%", "INITIALIZE 0%").replace("100000.0 / px AS shares, 0.0::DOUBLE AS cash", "0.0::DOUBLE AS shares, 100000.0::DOUBLE AS cash")
define("walk_0", ("tac_c",), _walk_0)
define("tac_0", ("walk_0",), """
  SELECT c.symbol, c.bar_ts, w.target, w.change, w.action, w.shares, w.cash, w.turnover, w.shares * c.px + w.cash AS portfolio
  FROM tac_c c JOIN walk_0 w ON c.symbol = w.symbol AND c.i = w.i""")


def every_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tactical.features(indicator(spark, sf_dir), against(spark, sf_dir), EVERY)
    return tactical.execution(tactical.decisions(x, EVERY), EVERY)


_ev = (["symbol", "bar_ts", "action"], ["target", "change"], ["log_cash", "log_portfolio", "log_shares", "turnover"])
QUERIES["t17_every_bar"] = lambda s, d: shown(logged(every_bar(s, d)), *_ev)
SQL["t17_every_bar"] = sql(shown_sql(logged_sql("tac_0", "cash", "portfolio", "shares"), *_ev), "tac_0", recursive=True)

_feat = (["symbol", "bar_ts", "reenter_below_upper", "reenter_above_lower", "cross_below_path", "cross_above_path"], [], ["drift_z", "envelope_z", "relative_volume"])
QUERIES["w24_tactical_features"] = lambda s, d: shown(tactical.features(indicator(s, d), against(s, d), TAC), *_feat)
SQL["w24_tactical_features"] = sql(shown_sql("tac_b", *_feat), "tac_b")
_dec = (["symbol", "bar_ts", "rule", "action"], ["target", "change"])
QUERIES["t06_tactical_target"] = lambda s, d: shown(decided(s, d), *_dec)
SQL["t06_tactical_target"] = sql(shown_sql("tac", *_dec), "tac", recursive=True)
_exe = (["symbol", "bar_ts"], ["target", "buy_hold"], ["log_cash", "log_portfolio", "log_shares", "log_traded", "exposure", "turnover"])
QUERIES["t08_tactical_execution"] = lambda s, d: shown(logged(tactical.execution(decided(s, d), TAC)), *_exe)
SQL["t08_tactical_execution"] = sql(shown_sql(logged_sql("tac", "cash", "portfolio", "shares", "traded"), *_exe), "tac", recursive=True)
_act = (["symbol", "bar_ts", "action"], ["target", "change", "adj_open"])
QUERIES["l13_action_ledger"] = lambda s, d: shown(tactical.action_ledger(decided(s, d)), *_act)
SQL["l13_action_ledger"] = sql(shown_sql("tac WHERE i > 0 AND change <> 0", *_act), "tac", recursive=True)
QUERIES["t09_rule_table"] = lambda s, d: tactical.rule_table(decided(s, d), TAC).select("symbol", "bar_ts", "rule_id", "selected", "target")
SQL["t09_rule_table"] = sql(f"""
, z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS back FROM tac)
SELECT symbol, bar_ts, u.rule_id, u.rule_id = rule AS selected, target FROM z, (SELECT unnest({_NAMES}) AS rule_id) u WHERE back = 1""", "tac", recursive=True)
_stats = (["symbol", "rebalances"], [], ["mean_target", "full_share", "flat_share", "last_exposure"])
QUERIES["a18_exposure_statistics"] = lambda s, d: shown(
    tactical.execution(decided(s, d), TAC).groupBy("symbol").agg(
        F.count_if(F.col("change") != 0).alias("rebalances"),
        F.avg("target").alias("mean_target"),
        F.avg((F.col("target") >= 0.999).cast("int")).alias("full_share"),
        F.avg((F.col("target") <= 0.001).cast("int")).alias("flat_share"),
        F.max_by("exposure", "bar_ts").alias("last_exposure"),
    ),
    *_stats,
)
SQL["a18_exposure_statistics"] = sql(f"""
, z AS (SELECT symbol, count(*) FILTER (change <> 0) AS rebalances, avg(target) AS mean_target, avg((target >= 0.999)::INT) AS full_share,
        avg((target <= 0.001)::INT) AS flat_share, arg_max(exposure, bar_ts) AS last_exposure FROM tac GROUP BY symbol)
{shown_sql('z', *_stats)}""", "tac", recursive=True)
