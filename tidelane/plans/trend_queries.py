"""Bars, trend-following and performance: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.windows import rounded
from tidelane.operators import performance, trend
from tidelane.plans.oracle import SO_FAR, W, prior, r, sql
from tidelane.sources import bars

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAILY = trend.Trend(stop="atr", atr_times=1.5, entry_bars=20)
RUNS = {
    "trail_1wk": ("1wk", trend.Trend()),
    "band_1wk": ("1wk", trend.Trend(stop="band")),
    "atr_1d": ("1d", DAILY),
}


def shown(df: DataFrame, plain: list[str], money: list[str] = (), ratios: list[str] = ()) -> DataFrame:
    """Selected columns, doubles rounded: money to 4 digits, ratios to 6."""
    return df.select(
        *plain, *[rounded(F.col(c), 4).alias(c) for c in money], *[rounded(F.col(c), 6).alias(c) for c in ratios]
    )


def shown_sql(source: str, plain: list[str], money: list[str] = (), ratios: list[str] = ()) -> str:
    parts = [*plain, *[f"{r(c, 4)} AS {c}" for c in money], *[f"{r(c, 6)} AS {c}" for c in ratios]]
    return f"SELECT {', '.join(parts)} FROM {source}"


def path(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    grain, config = RUNS[name]
    return trend.run(bars.load(spark, sf_dir, grain), config)


for _g in ("1wk", "1d", "1h", "15m"):
    _m = ["open", "high", "low", "close", "adj_close", "volume"]
    QUERIES[f"bars_{_g}"] = lambda s, d, g=_g, m=_m: shown(bars.load(s, d, g), ["symbol", "bar_ts"], m)
    SQL[f"bars_{_g}"] = sql(shown_sql(f"bars_{_g}", ["symbol", "bar_ts"], _m), f"bars_{_g}")

_adj = (["symbol", "bar_ts"], ["adj_open", "adj_high", "adj_low", "px", "volume_k"], ["scale"])
QUERIES["p09_adjusted"] = lambda s, d: shown(bars.adjusted(bars.load(s, d, "1d")), *_adj)
SQL["p09_adjusted"] = sql(shown_sql("adj_1d", *_adj), "adj_1d")

_sig = (["symbol", "bar_ts", "signal"], ["true_range", "atr_stop", "max_price", "band_sd", "lower_band", "trail"], ["ret"])
_pos = (["symbol", "bar_ts", "signal", "held", "first_buy", "first_sell"], ["cash", "portfolio", "buy_hold"], ["shares"])
for _n in RUNS:
    QUERIES[f"w01_signals_{_n}"] = lambda s, d, n=_n: shown(trend.signals(bars.load(s, d, RUNS[n][0]), RUNS[n][1]), *_sig)
    SQL[f"w01_signals_{_n}"] = sql(shown_sql(f"{_n}_sig", *_sig), f"{_n}_sig")
    QUERIES[f"t01_portfolio_{_n}"] = lambda s, d, n=_n: shown(path(s, d, n), *_pos)
    SQL[f"t01_portfolio_{_n}"] = sql(shown_sql(_n, *_pos), _n)


def summary_query(df: DataFrame) -> DataFrame:
    return shown(
        performance.summary(df),
        ["symbol", "n", "first", "last", "buys", "sells", "last_signal"],
        ["final", "hold"],
        ["growth", "hold_growth", "volatility", "max_drawdown", "hold_drawdown"],
    )


def summary_sql(name: str) -> str:
    return sql(f"""
    , x AS (SELECT *, portfolio / {prior('portfolio')} - 1 AS r, portfolio / max(portfolio) OVER ({SO_FAR}) - 1 AS dd,
              buy_hold / max(buy_hold) OVER ({SO_FAR}) - 1 AS ddh, date_diff('day', {prior('bar_ts')}, bar_ts) AS gap FROM {name}),
    y AS (SELECT symbol, count(*) AS n, min(bar_ts) AS first, max(bar_ts) AS last, arg_max(portfolio, bar_ts) AS final,
            arg_max(buy_hold, bar_ts) AS hold, stddev_samp(r) AS sd, min(dd) AS dd, min(ddh) AS ddh,
            sum(first_buy)::BIGINT AS buys, sum(first_sell)::BIGINT AS sells, arg_max(signal, bar_ts) AS sig, median(gap) AS gap
          FROM x GROUP BY symbol),
    z AS (SELECT *, date_diff('day', first, last) / 365.25::DOUBLE AS years FROM y)
    SELECT symbol, n, first, last, buys, sells, CASE WHEN sig = '' THEN 'HOLD' ELSE sig END AS last_signal,
      {r('final', 4)} AS final, {r('hold', 4)} AS hold, {r('CASE WHEN years > 0 THEN pow(final / 100000.0::DOUBLE, 1 / years) - 1 END')} AS growth,
      {r('CASE WHEN years > 0 THEN pow(hold / 100000.0::DOUBLE, 1 / years) - 1 END')} AS hold_growth,
      {r('sd * sqrt(CASE WHEN gap <= 3 THEN 252.0 WHEN gap <= 10 THEN 52.0 ELSE 12.0 END)')} AS volatility,
      {r('dd')} AS max_drawdown, {r('ddh')} AS hold_drawdown FROM z""", name)


QUERIES["a01_performance"] = lambda s, d: summary_query(path(s, d, "trail_1wk"))
SQL["a01_performance"] = summary_sql("trail_1wk")


def ledger_sql(name: str, query: str) -> str:
    return sql(f"""
    , x AS (SELECT * FROM (SELECT *, sum(first_buy) OVER ({SO_FAR})::BIGINT AS trade FROM {name}) WHERE trade > 0),
    y AS (SELECT symbol, trade, min(bar_ts) AS entry_ts, arg_min(adj_open, bar_ts) AS entry_price,
            max(CASE WHEN first_sell = 1 THEN bar_ts END) AS exit_ts, max(CASE WHEN first_sell = 1 THEN adj_open END) AS exit_price,
            max(bar_ts) AS last_ts, arg_max(px, bar_ts) AS last_price FROM x GROUP BY symbol, trade),
    l AS (SELECT symbol, trade, entry_ts, entry_price, exit_ts, exit_price, coalesce(exit_price, last_price) / entry_price - 1 AS trade_return,
            date_diff('day', entry_ts, coalesce(exit_ts, last_ts)) AS days,
            CASE WHEN exit_ts IS NULL THEN 'OPEN / MARK-TO-MARKET' ELSE 'CLOSED' END AS status FROM y)
    {query}""", name)


_led = (["symbol", "trade", "entry_ts", "exit_ts", "days", "status"], ["entry_price", "exit_price"], ["trade_return"])
_st = (["symbol", "closed"], [], ["win_rate", "mean_return", "best", "worst", "mean_days"])
_st_sql = f"""
    , s AS (SELECT symbol, count(*) FILTER (status = 'CLOSED') AS closed, avg((trade_return > 0)::INT) FILTER (status = 'CLOSED') AS win_rate,
            avg(trade_return) FILTER (status = 'CLOSED') AS mean_return, max(trade_return) FILTER (status = 'CLOSED') AS best,
            min(trade_return) FILTER (status = 'CLOSED') AS worst, avg(days) FILTER (status = 'CLOSED') AS mean_days FROM l GROUP BY symbol)
    {shown_sql('s', *_st)}"""
for _n in ("trail_1wk", "atr_1d"):
    QUERIES[f"l01_trades_{_n}"] = lambda s, d, n=_n: shown(performance.trades(path(s, d, n)).withColumn("days", F.col("days").cast("long")), *_led)
    SQL[f"l01_trades_{_n}"] = ledger_sql(_n, shown_sql("l", *_led))
    QUERIES[f"a02_trade_statistics_{_n}"] = lambda s, d, n=_n: shown(performance.trade_statistics(performance.trades(path(s, d, n))), *_st)
    SQL[f"a02_trade_statistics_{_n}"] = ledger_sql(_n, _st_sql)

_cash = (["symbol", "start_ts", "end_ts", "days", "bars", "longest"], ["from_wealth", "to_wealth"], ["price_return"])
QUERIES["w37_cash_regimes"] = lambda s, d: shown(performance.cash_regimes(path(s, d, "atr_1d")).withColumn("days", F.col("days").cast("long")), *_cash)
SQL["w37_cash_regimes"] = sql(f"""
    , x AS (SELECT *, shares <= 0 AS c FROM atr_1d),
    y AS (SELECT *, coalesce(c <> {prior('c')}, true)::INT AS st FROM x),
    z AS (SELECT * FROM (SELECT *, sum(st) OVER ({SO_FAR}) AS run FROM y) WHERE c),
    g AS (SELECT symbol, run, min(bar_ts) AS start_ts, max(bar_ts) AS end_ts, count(*) AS bars, arg_min(px, bar_ts) AS p0, arg_max(px, bar_ts) AS p1,
            arg_min(portfolio, bar_ts) AS from_wealth, arg_max(portfolio, bar_ts) AS to_wealth FROM z GROUP BY symbol, run)
    SELECT symbol, start_ts, end_ts, date_diff('day', start_ts, end_ts) AS days, bars,
      row_number() OVER (PARTITION BY symbol ORDER BY bars DESC, start_ts) = 1 AS longest,
      {r('from_wealth', 4)} AS from_wealth, {r('to_wealth', 4)} AS to_wealth, {r('p1 / p0 - 1')} AS price_return FROM g""", "atr_1d")

_per = ["symbol", "gap_s", "seven_days", "bars_day", "per_year", "label"]
for _g in ("1wk", "1d", "1h", "15m"):
    QUERIES[f"a03_periodicity_{_g}"] = lambda s, d, g=_g: performance.periodicity(bars.load(s, d, g)).select(*_per)
    SQL[f"a03_periodicity_{_g}"] = sql(f"""
    , x AS (SELECT *, epoch_us(bar_ts) / 1e6 - {prior('epoch_us(bar_ts) / 1e6')} AS gap FROM bars_{_g}),
    dd AS (SELECT symbol, bar_ts::DATE AS day, count(*) AS n FROM bars_{_g} GROUP BY ALL),
    e AS (SELECT symbol, median(n) FILTER (n > 1) AS typical, count(*) AS days, avg((dayofweek(day) IN (0, 6))::INT) AS weekend FROM dd GROUP BY symbol),
    f AS (SELECT symbol, median(gap) AS gap_s, count(*) AS bars FROM x GROUP BY symbol),
    h AS (SELECT *, bars >= 14 AND days >= 10 AND weekend >= 0.10 AS seven_days, greatest(1, round_even(gap_s / 60, 0)::INT) AS minutes FROM f JOIN e USING (symbol)),
    k AS (SELECT *, greatest(1, coalesce(round_even(typical, 0), round_even(CASE WHEN seven_days THEN 1440.0 ELSE 390.0 END / minutes, 0))::INT) AS bars_day FROM h)
    SELECT symbol, gap_s, seven_days, bars_day,
      CASE WHEN gap_s < 64800 THEN (CASE WHEN seven_days THEN 365 ELSE 252 END) * bars_day WHEN gap_s < 259201 THEN CASE WHEN seven_days THEN 365 ELSE 252 END
           WHEN gap_s < 864001 THEN 52 ELSE 12 END::INT AS per_year,
      CASE WHEN gap_s < 64800 THEN 'Intraday' || CASE WHEN seven_days THEN ' 7D' ELSE '' END || ' (' || minutes || 'm)'
           WHEN gap_s < 259201 THEN CASE WHEN seven_days THEN 'Daily 7D' ELSE 'Daily' END WHEN gap_s < 864001 THEN 'Weekly' ELSE 'Monthly' END AS label
    FROM k""", f"bars_{_g}")
