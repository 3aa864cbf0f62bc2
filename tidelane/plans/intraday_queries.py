"""Sessions of quarter-hour bars: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import intraday, kernel, relative
from tidelane.plans import oracle
from tidelane.plans.oracle import W, define, full, prior, r, rows, sql
from tidelane.plans.trend_queries import shown, shown_sql
from tidelane.sources import bars
from tidelane.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}
LAB = intraday.Lab()
DAY = intraday.Session("UTC", 480, 1080, 252, 40)
NIGHT = intraday.Session("UTC", 1080, 1020, 252, 92)
KERNEL = kernel.Kernel(lookback=24, bandwidth=6)

oracle.kernel("15m", "nw_15m", KERNEL.weights(), KERNEL.band)
oracle.relative("15m", "rel_15m")
_S = "PARTITION BY symbol, session_date ORDER BY bar_ts"
_SF = f"{_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def lab(name: str, s: intraday.Session) -> None:
    minute = "(hour(bar_ts) * 60 + minute(bar_ts))"
    inside = f"({minute} >= {s.opens} {'OR' if s.rolls else 'AND'} {minute} < {s.closes})"
    date = f"bar_ts::DATE + CASE WHEN {minute} >= {s.opens} THEN 1 ELSE 0 END" if s.rolls else "bar_ts::DATE"
    define(f"{name}_a", ("adj_15m",), f"""
      SELECT *, {minute}::INT AS local_minute, {inside} AS in_session, CASE WHEN {inside} THEN ({date})::DATE END AS session_date,
        greatest(adj_high - adj_low, abs(adj_high - {prior('px')}), abs(adj_low - {prior('px')})) AS true_range,
        ln(px / {prior('px')}) AS log_ret, px / {prior('px')} - 1 AS bar_ret FROM adj_15m""")
    define(f"{name}_b", (f"{name}_a",), f"""
      SELECT *, coalesce(session_date = {prior('session_date')}, false) AS same_session,
        {full('avg(true_range)', 'true_range', 14, rows(-13))} AS atr,
        {full('stddev_samp(log_ret)', 'log_ret', 32, rows(-31))} * sqrt({s.days * s.bars}.0::DOUBLE) AS real_vol FROM {name}_a""")
    define(f"{name}_s", (f"{name}_b",), f"""
      SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY session_date) AS prior_close
      FROM (SELECT symbol, session_date, arg_min(adj_open, bar_ts) AS session_open, arg_max(px, bar_ts) AS c FROM {name}_b WHERE in_session GROUP BY ALL)""")
    define(f"{name}_c", (f"{name}_b", f"{name}_s"), f"""
      SELECT b.*, session_open, prior_close, CASE WHEN in_session THEN row_number() OVER (PARTITION BY b.symbol, b.session_date ORDER BY bar_ts) END AS session_bar
      FROM {name}_b b LEFT JOIN {name}_s s ON b.symbol = s.symbol AND b.session_date = s.session_date""")
    define(f"{name}_d", (f"{name}_c",), f"""
      SELECT *, CASE WHEN in_session THEN sum((adj_high + adj_low + px) / 3 * volume) OVER ({_SF}) / sum(volume) OVER ({_SF}) END AS vwap,
        CASE WHEN in_session THEN max(adj_high) OVER ({_SF}) END AS session_high, CASE WHEN in_session THEN min(adj_low) OVER ({_SF}) END AS session_low,
        CASE WHEN in_session THEN px / max(px) OVER ({_SF}) - 1 END AS session_drawdown,
        CASE WHEN in_session THEN max(CASE WHEN session_bar <= 4 THEN adj_high END) OVER ({_SF}) END AS or_high,
        CASE WHEN in_session THEN min(CASE WHEN session_bar <= 4 THEN adj_low END) OVER ({_SF}) END AS or_low,
        coalesce(session_bar >= 4, false) AS or_final, session_open / prior_close - 1 AS session_gap, px / session_open - 1 AS session_ret,
        CASE WHEN in_session AND count(volume) OVER k >= 3 THEN median(volume) OVER k END AS slot_volume
      FROM {name}_c WINDOW k AS (PARTITION BY symbol, session_bar ORDER BY session_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
    define(name, (f"{name}_d",), f"""
      SELECT *, volume / slot_volume AS slot_ratio, or_high / or_low - 1 AS or_width, coalesce(volume / slot_volume >= 1.5, false) AS climax,
        px / vwap - 1 AS vwap_gap, (px - vwap) / atr AS vwap_gap_atr,
        coalesce(same_session AND or_final AND px > or_high AND {prior('px')} <= {prior('or_high')}, false) AS or_up,
        coalesce(same_session AND or_final AND px < or_low AND {prior('px')} >= {prior('or_low')}, false) AS or_down,
        coalesce(same_session AND px > vwap AND {prior('px')} <= {prior('vwap')}, false) AS vwap_up,
        coalesce(same_session AND px < vwap AND {prior('px')} >= {prior('vwap')}, false) AS vwap_down,
        CASE WHEN or_final AND px > or_high THEN 1 WHEN or_final AND px < or_low THEN -1 ELSE 0 END AS or_position
      FROM {name}_d""")


lab("lab_day", DAY)
lab("lab_night", NIGHT)


def measured(spark: SparkSession, sf_dir: str, s: intraday.Session) -> DataFrame:
    return intraday.analytics(bars.load(spark, sf_dir, "15m"), s, LAB)


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.load(spark, sf_dir, "15m")
    against = relative.analytics(b, relative.next_symbol(b)).select("symbol", "bar_ts", "drift_z")
    return kernel.indicator(b, KERNEL).join(against, ["symbol", "bar_ts"], "left")


_ses = (["symbol", "bar_ts", "in_session", "session_day", "local_minute", "place"], ["vwap", "session_open", "prior_close", "session_high", "session_low"], ["session_gap", "session_ret", "session_drawdown"])
_or = (["symbol", "bar_ts", "or_final", "or_position", "or_up", "or_down", "vwap_up", "vwap_down"], ["or_high", "or_low"], ["or_width"])
_vol = (["symbol", "bar_ts", "climax"], ["slot_volume", "atr"], ["slot_ratio", "real_vol", "vwap_gap", "vwap_gap_atr"])
for _n, _s in (("day", DAY), ("night", NIGHT)):
    for _q, _c in (("w50_sessions", _ses), ("w53_opening_range", _or), ("w54_slot_volume", _vol)):
        QUERIES[f"{_q}_{_n}"] = lambda s, d, k=_s, c=_c: shown(
            measured(s, d, k).withColumns({"session_day": F.col("session_date").cast("string"), "place": F.coalesce("session_bar", F.lit(0))}), *c
        )
        SQL[f"{_q}_{_n}"] = sql(
            shown_sql(f"(SELECT *, session_date::VARCHAR AS session_day, coalesce(session_bar, 0)::INT AS place FROM lab_{_n})", *_c), f"lab_{_n}"
        )

_Z = "greatest(-3.0, least(3.0, coalesce(drift_z, 0)))::DOUBLE"
define("lab_score", ("lab_day", "nw_15m", "rel_15m"), f"""
  SELECT x.*, CASE WHEN in_session THEN greatest(-100.0, least(100.0, 15.0 * coalesce(sign(x.px - vwap), 0) + 15.0 * or_position
      + CASE WHEN climax THEN 10.0 * coalesce(sign(bar_ret), 0) ELSE 0 END + 25.0 * direction + 10.0 * (momentum_up::INT - momentum_down::INT)
      + CASE WHEN drift_z IS NULL THEN 0 ELSE {_Z} / 3 * 20 END))::DOUBLE END AS score,
    CASE WHEN in_session THEN (vwap IS NOT NULL)::INT + or_final::INT + (slot_ratio IS NOT NULL)::INT + 2 + (drift_z IS NOT NULL)::INT ELSE 0 END AS parts
  FROM lab_day x JOIN nw_15m n ON x.symbol = n.symbol AND x.bar_ts = n.bar_ts JOIN rel_15m q ON x.symbol = q.symbol AND x.bar_ts = q.bar_ts""")
define("lab_state", ("lab_score",), """
  SELECT *, CASE WHEN NOT in_session THEN 'OUTSIDE PRIMARY SESSION' WHEN score <= -50 THEN 'STRONG DOWN CONFIRMATION' WHEN score <= -20 THEN 'DOWN CONFIRMATION'
    WHEN score >= 50 THEN 'STRONG UP CONFIRMATION' WHEN score >= 20 THEN 'UP CONFIRMATION' ELSE 'NEUTRAL' END AS state FROM lab_score""")


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intraday.scored(measured(spark, sf_dir, DAY), context(spark, sf_dir), LAB)


_sc = (["symbol", "bar_ts", "state", "parts"], [], ["score"])
QUERIES["w59_confirmation"] = lambda s, d: shown(confirmed(s, d), *_sc)
SQL["w59_confirmation"] = sql(shown_sql("lab_state", *_sc), "lab_state")
_sn = (["symbol", "bar_ts", "session_bar", "state", "or_position", "climax"], ["px", "vwap"], ["score"])
QUERIES["l09_intraday_snapshot"] = lambda s, d: shown(intraday.snapshot(confirmed(s, d)), *_sn)
SQL["l09_intraday_snapshot"] = sql(
    shown_sql("(SELECT * FROM lab_state WHERE in_session QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1)", *_sn), "lab_state"
)
QUERIES["a29_intraday_audit"] = lambda s, d: intraday.audit(measured(s, d, DAY))
SQL["a29_intraday_audit"] = sql("""SELECT symbol, count(*) AS bars, count(*) FILTER (in_session) AS inside, count(*) FILTER (NOT in_session) AS outside,
  count(DISTINCT session_date) AS sessions FROM lab_day GROUP BY symbol""", "lab_day")

_NOW = "2024-01-20 10:07:00"
QUERIES["p08_completed_bars"] = lambda s, d: shown(
    intraday.completed(bars.load(s, d, "15m").where(F.col("bar_ts") <= F.lit(_NOW).cast("timestamp_ntz")), F.lit(_NOW).cast("timestamp_ntz")),
    ["symbol", "bar_ts"],
    ["close"],
)
SQL["p08_completed_bars"] = sql(f"""
, x AS (SELECT *, max(bar_ts) OVER (PARTITION BY symbol) AS last FROM bars_15m WHERE bar_ts <= TIMESTAMP '{_NOW}')
SELECT symbol, bar_ts, {r('close', 4)} AS close FROM x WHERE NOT (bar_ts = last AND bar_ts + INTERVAL 15 MINUTE > TIMESTAMP '{_NOW}')""", "bars_15m")

QUERIES["p20_session_model"] = lambda s, d: (
    s.read.parquet(f"{d}/part.parquet")
    .select("p_partkey", F.concat(F.col("p_brand"), F.element_at(F.array(*map(F.lit, [".is", "-USD", "=F", " "])), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("ticker"))
    .select("p_partkey", "ticker", intraday.session_of(F.col("ticker")).alias("session"))
)
SQL["p20_session_model"] = """
SELECT p_partkey, ticker, CASE WHEN upper(trim(ticker)) LIKE '%.IS' THEN '.IS' WHEN upper(trim(ticker)) LIKE '%-USD' THEN '-USD'
  WHEN upper(trim(ticker)) LIKE '%=F' THEN '=F' ELSE '' END AS session
FROM (SELECT p_partkey, p_brand || ['.is', '-USD', '=F', ' '][(p_partkey % 4 + 1)::INT] AS ticker FROM part)"""

_done = (["symbol", "session_day", "bars", "or_final"], ["session_open", "session_high", "session_low", "session_close", "volume", "vwap", "or_high", "or_low"])
_finals = lambda x: shown(x.withColumn("session_day", F.col("session_date").cast("string")), *_done)
for _key, _cte, _session in (("day", "lab_day", DAY), ("night", "lab_night", NIGHT)):
    QUERIES[f"w50_final_sessions_{_key}"] = lambda s, d, session=_session: _finals(sessions.of_history(bars.load(s, d, "15m"), session, LAB))
    SQL[f"w50_final_sessions_{_key}"] = sql(f"""
, z AS (SELECT *, px AS session_close, count(*) OVER k AS bars, sum(volume) OVER k AS total FROM {_cte} WHERE in_session WINDOW k AS (PARTITION BY symbol, session_date)
  QUALIFY row_number() OVER (PARTITION BY symbol, session_date ORDER BY bar_ts DESC) = 1),
y AS (SELECT * EXCLUDE (volume), total AS volume, session_date::VARCHAR AS session_day FROM z)
{shown_sql('y', *_done)}""", _cte)
QUERIES["stream_sessions"] = lambda s, d: _finals(sessions.replay(s, bars.load(s, d, "15m"), DAY, LAB))
SQL["stream_sessions"] = SQL["w50_final_sessions_day"]
