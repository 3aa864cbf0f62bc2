"""Checks on inputs, sessions, recovery, golden tables, dimension tables, CSV ledgers: queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time
from tidelane.operators import checks, guards, relative, tactical
from tidelane.plans import kernel_queries as K
from tidelane.plans.oracle import define, r, sql
from tidelane.plans.risk_queries import faulty
from tidelane.plans.trend_queries import path, shown, shown_sql
from tidelane.sources import bars, ledgers, universe
from tidelane.streaming.bars import scratch_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}
_BAR = ["open", "high", "low", "close", "adj_close", "volume"]

_MESSAGES = ["HTTP 429", "Too Many Requests", "timed out", "RateLimitError: wait", "no data"]
QUERIES["s03_rate_limited"] = lambda s, d: (
    s.read.parquet(f"{d}/part.parquet")
    .select("p_partkey", F.element_at(F.array(*map(F.lit, [*_MESSAGES, None])), (F.col("p_partkey") % 6 + 1).cast("int")).alias("message"))
    .select("p_partkey", guards.rate_limited(F.col("message")).alias("turned_away"))
)
SQL["s03_rate_limited"] = f"""
SELECT p_partkey, coalesce(regexp_matches(lower(m), 'ratelimit|rate limit|too many requests|429'), false) AS turned_away
FROM (SELECT p_partkey, [{', '.join(repr(m) for m in _MESSAGES)}, NULL][(p_partkey % 6 + 1)::INT] AS m FROM part)"""


def as_provided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars under a provider's names, some numbers as text that is none."""
    names = {"bar_ts": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "Adj Close", "volume": "Volume"}
    return bars.load(spark, sf_dir, "1d").withColumnsRenamed(names)


QUERIES["p02_canonical_names"] = lambda s, d: shown(guards.require(guards.canonical(as_provided(s, d)), bars.COLUMNS), ["symbol", "bar_ts"], _BAR)
SQL["p02_canonical_names"] = sql(shown_sql("bars_1d", ["symbol", "bar_ts"], _BAR), "bars_1d")


def as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    price = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, "NaN").when(k % 13 == 0, "Infinity").otherwise(F.col("p_retailprice").cast("string"))
    return p.select("p_partkey", price.alias("price"), F.lit("none").alias("discount"))


QUERIES["p14_numbers"] = lambda s, d: guards.numeric(as_text(s, d), ["price"]).select("p_partkey", F.round(F.col("price") + 1e-9, 4).alias("price"))
SQL["p14_numbers"] = f"""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN NULL ELSE {r('p_retailprice', 4)} END AS price FROM part"""
QUERIES["p14_numbers_found"] = lambda s, d: guards.numbers_found(as_text(s, d), ["price", "discount"])
SQL["p14_numbers_found"] = """
SELECT 'price' AS "column", count(*) AS rows, count(*) FILTER (p_partkey % 7 > 0 AND p_partkey % 11 > 0 AND p_partkey % 13 > 0) AS valid, 'OK' AS status FROM part
UNION ALL SELECT 'discount', count(*), 0, 'NO VALID NUMBER' FROM part"""
QUERIES["p18_order_status"] = lambda s, d: guards.order_status(faulty(s, d))
SQL["p18_order_status"] = sql("""
SELECT symbol, sum(n)::BIGINT AS bars, sum(n - 1)::BIGINT AS repeated, 0::BIGINT AS untimed, max(n) = 1 AS "unique"
FROM (SELECT symbol, bar_ts, count(*) AS n FROM faulty GROUP BY ALL) GROUP BY symbol""", "faulty")

# Daily sessions that close at 21:00; the moment of asking is ten minutes after the last one closed.
_ASKED = "(SELECT max(bar_ts) + INTERVAL 21 HOUR + INTERVAL 10 MINUTE FROM {0})"


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars.load(spark, sf_dir, "1d").select("symbol", "bar_ts", (F.col("bar_ts") + F.expr("interval 21 hours")).alias("close_utc"))
    now = x.groupBy().agg((F.max("close_utc") + F.expr("interval 10 minutes")).alias("now"))
    # One row: the moment of asking.
    return guards.completed_sessions(x.crossJoin(F.broadcast(now)), F.col("now")).drop("now")


QUERIES["p07_completed_sessions"] = lambda s, d: calendar(s, d).select("symbol", "bar_ts", "completed")
SQL["p07_completed_sessions"] = sql(f"SELECT symbol, bar_ts, bar_ts + INTERVAL 21 HOUR + INTERVAL 20 MINUTE <= {_ASKED.format('bars_1d')} AS completed FROM bars_1d", "bars_1d")
QUERIES["p07_cutoffs"] = lambda s, d: guards.cutoffs(calendar(s, d))
SQL["p07_cutoffs"] = sql(f"SELECT symbol, max(bar_ts) AS cutoff, count(*) AS sessions FROM bars_1d WHERE bar_ts + INTERVAL 21 HOUR + INTERVAL 20 MINUTE <= {_ASKED.format('bars_1d')} GROUP BY symbol", "bars_1d")
QUERIES["p06_running_withheld"] = lambda s, d: shown(guards.running_withheld(bars.load(s, d, "1d"), calendar(s, d)), ["symbol", "bar_ts"], _BAR)
SQL["p06_running_withheld"] = sql(shown_sql(f"bars_1d WHERE bar_ts + INTERVAL 21 HOUR + INTERVAL 20 MINUTE <= {_ASKED.format('bars_1d')}", ["symbol", "bar_ts"], _BAR), "bars_1d")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars some of which are empty, missing a field, or outside the calendar, against it."""
    b = bars.load(spark, sf_dir, "1d").withColumn("i", F.row_number().over(by_time()) - 1)
    hole = lambda c, n: F.when(n, None).otherwise(F.col(c)).alias(c)
    i = F.col("i")
    empty = i % 40 == 3
    rows = b.select("symbol", "bar_ts", *[hole(c, empty) for c in _BAR[:4]], hole("adj_close", empty | (i % 40 == 9)), hole("volume", empty))
    days = calendar(spark, sf_dir).where("symbol like '1%'").select("bar_ts", "completed").where(F.dayofmonth("bar_ts") != 1)
    return checks.classified(rows, days)


QUERIES["p05_classified"] = lambda s, d: placed(s, d).select("symbol", "bar_ts", "kind")
SQL["p05_classified"] = sql(f"""
, c AS (SELECT bar_ts, bar_ts + INTERVAL 21 HOUR + INTERVAL 20 MINUTE <= {_ASKED.format('bars_1d')} AS completed FROM bars_1d WHERE symbol LIKE '1%' AND day(bar_ts) <> 1)
SELECT a.symbol, a.bar_ts, CASE WHEN completed IS NULL AND i % 40 = 3 THEN 'QUARANTINE' WHEN NOT coalesce(completed, true) THEN 'WITHHOLD'
  WHEN i % 40 IN (3, 9) THEN 'MISSING' ELSE 'COMPLETE' END AS kind FROM adj_1d a LEFT JOIN c ON a.bar_ts = c.bar_ts""", "bars_1d", "adj_1d")


def broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily bars with gaps, the gaps, and the full bars as another route."""
    x = bars.load(spark, sf_dir, "1d").withColumn("i", F.row_number().over(by_time()) - 1)
    lost = F.col("i") % 61 < F.col("i") % 4
    return x.where(~lost).drop("i"), x.where(lost).select("symbol", "bar_ts"), x.drop("i")


QUERIES["s08_recovered"] = lambda s, d: shown(guards.recovered(*broken(s, d)), ["symbol", "bar_ts", "origin"], _BAR)
SQL["s08_recovered"] = sql(shown_sql("(SELECT *, CASE WHEN i % 61 < i % 4 THEN 'RECOVERED' ELSE 'FIRST' END AS origin FROM adj_1d)", ["symbol", "bar_ts", "origin"], _BAR), "adj_1d")
QUERIES["s08_windows"] = lambda s, d: guards.windows_around(broken(s, d)[1])
SQL["s08_windows"] = sql("""
, g AS (SELECT symbol, bar_ts::DATE - 2 AS a, bar_ts::DATE + 2 AS b, bar_ts FROM adj_1d WHERE i % 61 < i % 4),
n AS (SELECT *, coalesce((a > lag(b) OVER w + 1)::INT, 1) AS new FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
m AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY bar_ts) AS run FROM n)
SELECT symbol, min(a) AS first, max(b) AS last, count(*) AS gaps FROM m GROUP BY symbol, run""", "adj_1d")
QUERIES["u03_recovered_sessions"] = lambda s, d: (lambda x: x[2].select("symbol", "bar_ts").exceptAll(x[0].select("symbol", "bar_ts")))(broken(s, d))
SQL["u03_recovered_sessions"] = sql("SELECT symbol, bar_ts FROM adj_1d WHERE i % 61 < i % 4", "adj_1d")


def against_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = path(spark, sf_dir, "trail_1wk").withColumn("i", F.row_number().over(by_time()) - 1)
    i = F.col("i")
    off = x.withColumns(
        {
            "px": F.col("px") + F.when(i % 90 == 5, 0.5).otherwise(0.0),
            "adj_open": F.when(i % 70 == 2, None).otherwise(F.col("adj_open")),
            "signal": F.when(i % 50 == 1, "OTHER").otherwise(F.col("signal")),
        }
    )
    return guards.golden(x, off, ["px", "adj_open", "trail"], ["signal"])


QUERIES["p19_golden"] = lambda s, d: shown(against_golden(s, d), ["field", "compared", "mismatches", "passed"], [], ["max_off"])
SQL["p19_golden"] = sql("""
SELECT 'px' AS field, count(*) AS compared, count(*) FILTER (i % 90 = 5) AS mismatches, count(*) FILTER (i % 90 = 5) = 0 AS passed, 0.5::DOUBLE AS max_off FROM trail_1wk
UNION ALL SELECT 'adj_open', count(*), count(*) FILTER (i % 70 = 2), false, 0 FROM trail_1wk
UNION ALL SELECT 'trail', count(trail), 0, true, 0 FROM trail_1wk
UNION ALL SELECT 'signal', count(*), count(*) FILTER (i % 50 = 1), false, 0 FROM trail_1wk""", "trail_1wk")

_values = lambda rows: ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as instruments: market is the region, group the nation."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    x = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select(F.col("r_name").alias("market"), F.col("n_name").alias("group"), F.col("s_name").alias("instrument"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"))


define("universe", (), """
  SELECT r_name AS market, n_name AS "group", s_name AS instrument, 'S' || s_suppkey AS ticker
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
QUERIES["s12_instruments"] = instruments
SQL["s12_instruments"] = sql("SELECT * FROM universe", "universe")
_MARKETS, _GROUPS = ["ASIA", "EUROPE"], ["NATION_2", "NATION_3", "NATION_4"]


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments of two markets and three groups; one group is of neither market."""
    return universe.chosen(instruments(spark, sf_dir), _MARKETS, _GROUPS)


QUERIES["p17_chosen"] = chosen
SQL["p17_chosen"] = sql("""SELECT * FROM universe WHERE market IN ('ASIA', 'EUROPE') AND "group" IN ('NATION_2', 'NATION_3', 'NATION_4')""", "universe")


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = instruments(spark, sf_dir)
    return universe.markets(t).join(t.groupBy("market", "group").agg(F.count("*").alias("instruments")), "market")


QUERIES["s13_navigation"] = navigation
SQL["s13_navigation"] = sql('SELECT market, "group", count(*) AS instruments FROM universe GROUP BY ALL', "universe")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers of all sales, and as many that no instrument has."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("S"), "l_suppkey").alias("ticker")).distinct()
    symbols = sold.select(F.explode(F.array("ticker", F.concat("ticker", F.lit("?")))).alias("symbol"))
    return universe.named(symbols, instruments(spark, sf_dir))


QUERIES["j10_named"] = named
SQL["j10_named"] = sql("""
, s AS (SELECT DISTINCT 'S' || l_suppkey AS ticker FROM lineitem)
SELECT symbol, coalesce(instrument, symbol) AS name FROM (SELECT ticker AS symbol FROM s UNION ALL SELECT ticker || '?' FROM s) x
LEFT JOIN universe u ON u.ticker = x.symbol""", "universe")


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which horizons each symbol's history covers, by bar length."""
    sizes = None
    for grain in ("15m", "1d", "1wk"):
        n = bars.load(spark, sf_dir, grain).groupBy("symbol").agg(F.count("*").alias("n")).withColumn("grain", F.lit(grain))
        sizes = n if sizes is None else sizes.unionByName(n)
    return sizes.join(F.broadcast(universe.horizons(spark)), "grain").select("symbol", "grain", "horizon", "bars", "n", (F.col("n") > F.col("bars")).alias("covered"))


_horizons = ", ".join(f"('{g}', '{h}', {n})" for g, by in universe.HORIZONS.items() for h, n in by.items())
QUERIES["p12_horizons"] = horizons
SQL["p12_horizons"] = sql(f"""
, n AS ({' UNION ALL '.join(f"SELECT symbol, '{g}' AS grain, count(*) AS n FROM bars_{g} GROUP BY symbol" for g in ("15m", "1d", "1wk"))})
SELECT symbol, grain, horizon, bars, n, n > bars AS covered FROM n JOIN (VALUES {_horizons}) v(grain, horizon, bars) USING (grain)""", "bars_15m", "bars_1d", "bars_1wk")


def route_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each symbol a row for its own bars and one for its benchmark's: how many, from when to when, sound or not."""
    b = faulty(spark, sf_dir)
    span = b.groupBy("symbol").agg(F.min("bar_ts").alias("first"), F.max("bar_ts").alias("last"))
    known = checks.status(b).join(span, "symbol").withColumnRenamed("symbol", "source")
    own = known.select(F.col("source").alias("symbol"), F.lit("ASSET").alias("role"), "*")
    pairs = relative.next_symbol(b).withColumnRenamed("benchmark", "source")
    return own.unionByName(pairs.join(known, "source").withColumn("role", F.lit("BENCHMARK")))


QUERIES["l11_route_audit"] = route_audit
SQL["l11_route_audit"] = sql("""
, t AS (SELECT symbol, bar_ts, count(*) AS n FROM faulty GROUP BY ALL), u AS (SELECT symbol, max(n) AS most, sum(n)::BIGINT AS n FROM t GROUP BY symbol),
f AS (SELECT symbol, count(*) FILTER (open IS NULL OR adj_close IS NULL) AS nulls, count(*) FILTER (least(open, high, low, close, adj_close) <= 0) AS low,
      count(*) FILTER (volume < 0) AS neg, min(bar_ts) AS first, max(bar_ts) AS last FROM faulty GROUP BY symbol),
k AS (SELECT symbol AS source, n, CASE WHEN most > 1 THEN 'DUPLICATE TIMESTAMP' WHEN nulls > 0 THEN 'MISSING VALUE' WHEN low > 0 THEN 'NON-POSITIVE PRICE'
  WHEN neg > 0 THEN 'NEGATIVE VOLUME' WHEN n < 30 THEN 'TOO FEW OBSERVATIONS' ELSE 'OK' END AS status, first, last FROM u JOIN f USING (symbol)),
m AS (SELECT source AS symbol, coalesce(lead(source) OVER (ORDER BY source), first_value(source) OVER (ORDER BY source)) AS source FROM k)
SELECT source AS symbol, 'ASSET' AS role, * FROM k UNION ALL SELECT m.symbol, 'BENCHMARK', k.* FROM m JOIN k ON m.source = k.source""", "faulty")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tactical.execution(K.decided(spark, sf_dir), K.TAC)


_L = (["symbol", "bar_ts", "rule", "action"], ["adj_open", "px", "target", "change"], ["exposure"])


def _ddl(x: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in x.dtypes)


def through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged-exposure ledger, written as CSV and read again."""
    x = ledgers.rows(ledger(spark, sf_dir), ledgers.TACTICAL)
    place = f"{scratch_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledgers.write(x, place, ledgers.TACTICAL)
    return shown(ledgers.read(spark, place, _ddl(x)), *_L)


QUERIES["s14_tactical_csv"] = through_csv
SQL["s14_tactical_csv"] = sql(shown_sql("(SELECT t.*, c.symbol AS s FROM tac t JOIN tac_c c ON c.symbol = t.symbol AND c.i = t.i)", *_L), "tac", "tac_c", recursive=True)


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend run's columns beside the guarded bars, row by row."""
    b = guards.priced(guards.ordered(bars.load(spark, sf_dir, "1wk")))
    run = path(spark, sf_dir, "trail_1wk").select("symbol", "bar_ts", "px", "signal", "max_price")
    return guards.one_to_one(b.select("symbol", "bar_ts", "close", "adj_close", "volume"), run, ["symbol", "bar_ts"])


_g = (["symbol", "bar_ts", "signal", "volume"], ["close", "adj_close", "px", "max_price"])
QUERIES["j07_guarded_join"] = lambda s, d: shown(guarded(s, d), *_g)
SQL["j07_guarded_join"] = sql(shown_sql("trail_1wk", *_g), "trail_1wk")
