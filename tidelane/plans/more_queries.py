"""Snapshots, comparisons, payloads and streaming: queries and their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import checks, kernel, performance, tactical, trend
from tidelane.plans import kernel_queries as K
from tidelane.plans.oracle import SO_FAR, W, prior, r, sql
from tidelane.plans.trend_queries import DAILY, path, shown, shown_sql
from tidelane.sources import bars, cache, payloads
from tidelane.streaming import bars as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

_snap = (["symbol", "bar_ts", "action", "last_buy", "last_sell", "full_entry_window"], [], ["entry_gap", "stop_gap"])
QUERIES["l05_trend_snapshot"] = lambda s, d: shown(trend.snapshot(path(s, d, "atr_1d"), DAILY), *_snap)
SQL["l05_trend_snapshot"] = sql(f"""
, z AS (SELECT *, max(CASE WHEN first_buy = 1 THEN bar_ts END) OVER k AS last_buy, max(CASE WHEN first_sell = 1 THEN bar_ts END) OVER k AS last_sell,
  count(*) OVER k > 20 AS full_entry_window, px / max_price - 1 AS entry_gap, px / atr_stop - 1 AS stop_gap,
  CASE WHEN px >= max_price AND held = 0 THEN 'BUY' WHEN px <= atr_stop AND px < max_price AND held = 1 THEN 'SELL' WHEN held = 1 THEN 'HOLD' ELSE 'WAIT' END AS action
  FROM atr_1d WINDOW k AS (PARTITION BY symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1)
{shown_sql('z', *_snap)}""", "atr_1d")

_paths = (["symbol", "bar_ts"], ["rising", "falling", "flat"])
QUERIES["w60_regime_paths"] = lambda s, d: shown(kernel.paths(K.indicator(s, d)), *_paths)
SQL["w60_regime_paths"] = sql(f"""
, z AS (SELECT *, lead(direction) OVER ({W}) AS nxt FROM nw_1wk),
y AS (SELECT symbol, bar_ts, CASE WHEN direction > 0 OR coalesce(nxt > 0, false) THEN trend END AS rising,
  CASE WHEN direction < 0 OR coalesce(nxt < 0, false) THEN trend END AS falling, CASE WHEN direction = 0 OR coalesce(nxt = 0, false) THEN trend END AS flat FROM z)
{shown_sql('y', *_paths)}""", "nw_1wk")



def rulebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with their settings, and on how many bars of each symbol each one decided."""
    used = K.decided(spark, sf_dir).groupBy("symbol", F.col("rule").alias("rule_id")).agg(F.count("*").alias("bars"))
    symbols = used.select("symbol").distinct().crossJoin(F.broadcast(tactical.rulebook(spark, K.TAC)))
    return symbols.join(used, ["symbol", "rule_id"], "left").select("symbol", "place", "rule_id", "does", "level", F.coalesce("bars", F.lit(0)).alias("bars"))


QUERIES["t11_rulebook"] = rulebook
_levels = [(i + 1, x[0], x[1], tactical.level(x, K.TAC)) for i, x in enumerate(tactical.RULES)]
SQL["t11_rulebook"] = sql(f"""
, b AS (SELECT place::INT AS place, rule_id, does, level::DOUBLE AS level FROM (VALUES {', '.join(f"({i}, '{a}', '{b}', {'NULL' if v is None else v})" for i, a, b, v in _levels)}) v(place, rule_id, does, level))
SELECT s.symbol, b.*, (SELECT count(*) FROM tac t WHERE t.symbol = s.symbol AND t.rule = b.rule_id) AS bars FROM (SELECT DISTINCT symbol FROM tac) s, b""", "tac", recursive=True)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy's end and depth beside buying and holding."""
    runs = {
        "trend": path(spark, sf_dir, "trail_1wk"),
        "kernel": K.strategy(spark, sf_dir),
        "tactical": tactical.execution(K.decided(spark, sf_dir), K.TAC),
    }
    out = None
    for name, x in runs.items():
        x = x.select("symbol", "bar_ts", "portfolio").withColumn("strategy", F.lit(name)).withColumn("dd", performance.drawdown("portfolio"))
        one = x.groupBy("symbol", "strategy").agg(F.ln(F.max_by("portfolio", "bar_ts") / 100_000.0).alias("log_growth"), F.min("dd").alias("max_drawdown"))
        out = one if out is None else out.unionByName(one)
    return shown(out, ["symbol", "strategy"], [], ["log_growth", "max_drawdown"])


_one = lambda name, table: f"SELECT symbol, '{name}' AS strategy, bar_ts, portfolio, portfolio / max(portfolio) OVER ({SO_FAR}) - 1 AS dd FROM {table}"
QUERIES["a19_comparison"] = compared
SQL["a19_comparison"] = sql(f"""
, z AS ({_one('trend', 'trail_1wk')} UNION ALL {_one('kernel', 'nws_1wk')} UNION ALL {_one('tactical', 'tac')})
SELECT symbol, strategy, {r('ln(arg_max(portfolio, bar_ts) / 100000.0)')} AS log_growth, {r('min(dd)')} AS max_drawdown FROM z GROUP BY symbol, strategy""", "trail_1wk", "nws_1wk", "tac", recursive=True)


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth, depth, end and trades of each strategy and of buying and holding."""
    sold = F.col("first_sell") == 1
    out = performance.comparison(
        {
            "trend": (path(spark, sf_dir, "trail_1wk"), sold),
            "kernel": (K.strategy(spark, sf_dir), sold),
            "tactical": (tactical.execution(K.decided(spark, sf_dir), K.TAC), F.col("traded") > 0),
        }
    )
    return shown(out.withColumn("log_final", F.ln("final")), ["symbol", "strategy", "trades"], [], ["log_final", "growth", "max_drawdown"])


_row = lambda name, table, value, trade: f"SELECT symbol, '{name}' AS strategy, bar_ts, {value} AS value, {trade} AS trade, {value} / max({value}) OVER ({SO_FAR}) - 1 AS fall FROM {table}"
QUERIES["a19_strategies"] = strategies
SQL["a19_strategies"] = sql(f"""
, z AS ({_row('trend', 'trail_1wk', 'portfolio', 'first_sell = 1')} UNION ALL {_row('kernel', 'nws_1wk', 'portfolio', 'first_sell = 1')}
  UNION ALL {_row('tactical', 'tac', 'portfolio', 'traded > 0')} UNION ALL {_row('buy and hold', 'trail_1wk', 'buy_hold', 'false')}),
y AS (SELECT symbol, strategy, count(*) FILTER (trade) AS trades, arg_max(value, bar_ts) AS final, date_diff('day', min(bar_ts), max(bar_ts)) / 365.25::DOUBLE AS years, min(fall) AS max_drawdown
  FROM z GROUP BY symbol, strategy)
SELECT symbol, strategy, trades, {r('ln(final)')} AS log_final, {r('pow(final / 100000, 1 / years) - 1')} AS growth, {r('max_drawdown')} AS max_drawdown FROM y""", "trail_1wk", "nws_1wk", "tac", recursive=True)
QUERIES["a15_execution_events"] = lambda s, d: performance.execution_events(path(s, d, "trail_1wk"))
SQL["a15_execution_events"] = sql("""
SELECT symbol, max(CASE WHEN first_buy = 1 THEN bar_ts END) AS last_buy, max(CASE WHEN first_sell = 1 THEN bar_ts END) AS last_sell,
  count(*) FILTER (first_buy = 1) AS buys, count(*) FILTER (first_sell = 1) AS sales FROM trail_1wk GROUP BY symbol""", "trail_1wk")


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by way of the request cache: made at the first call of a bucket, read at the second."""
    kept = cache.RequestCache(spark, f"{stream.scratch_folder(spark)}/requests-{uuid.uuid4().hex}", timedelta(minutes=15))
    request, now = {"source": sf_dir, "grain": "1d"}, datetime(2024, 1, 1)
    kept.get(request, now, lambda: bars.load(spark, sf_dir, "1d"))

    def never() -> DataFrame:
        raise AssertionError("the bucket's result is there")

    return shown(kept.get(request, now + timedelta(minutes=14), never), ["symbol", "bar_ts"], checks.FIELDS)


QUERIES["s11_cached_bars"] = cached
SQL["s11_cached_bars"] = sql(shown_sql("bars_1d", ["symbol", "bar_ts"], checks.FIELDS), "bars_1d")


def from_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars packed into payloads of parallel arrays, and read from them."""
    b = bars.load(spark, sf_dir, "1wk")
    rows = F.array_sort(F.collect_list(F.struct("bar_ts", *checks.FIELDS)))
    packed = b.groupBy("symbol").agg(rows.alias("x"))
    seconds = F.transform("x", lambda v: F.unix_seconds(v["bar_ts"].cast("timestamp")))
    quote = F.array(F.struct(*[F.col(f"x.{k}").alias(k) for k in ("open", "high", "low", "close", "volume")]))
    body = F.to_json(F.struct(F.lit("UTC").alias("zone"), seconds.alias("timestamp"), quote.alias("quote"), F.array(F.struct(F.col("x.adj_close").alias("adjclose"))).alias("adjclose")))
    return shown(payloads.bars(packed.select("symbol", body.alias("body"))), ["symbol", "bar_ts"], checks.FIELDS)


QUERIES["s07_payload_bars"] = from_payloads
SQL["s07_payload_bars"] = sql(shown_sql("bars_1wk", ["symbol", "bar_ts"], checks.FIELDS), "bars_1wk")

_st = (["symbol", "bar_ts"], ["open", "high", "low", "close", "volume"])
QUERIES["stream_bars_15m"] = lambda s, d: shown(stream.replay(s, f"{d}/events.parquet"), *_st)
SQL["stream_bars_15m"] = sql(shown_sql("bars_15m WHERE bar_ts + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 20 MINUTE", *_st), "bars_15m")
