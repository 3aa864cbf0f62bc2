"""Risk, validation and reconciliation: queries and their SQL."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time, prior as lagged
from tidelane.operators import checks, performance, risk
from tidelane.plans import kernel_queries as K
from tidelane.plans.oracle import W, define, full, prior, r, rows, sql
from tidelane.plans.trend_queries import path, shown, shown_sql
from tidelane.sources import bars

QUERIES: dict = {}
SQL: dict[str, str] = {}
RISK = risk.Risk()


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rolling(path(spark, sf_dir, "trail_1wk"), RISK)


define("risk_a", ("trail_1wk",), f"""
  SELECT *, px / {prior('px')} - 1 AS asset_r, portfolio / {prior('portfolio')} - 1 AS strategy_r, (shares > 0)::INT AS invested FROM trail_1wk""")
_o = rows(-12)
define("risk_b", ("risk_a",), f"""
  SELECT *, px / {prior('px', 13)} - 1 AS asset_return, {full('stddev_samp(asset_r)', 'asset_r', 13, _o)} * sqrt(52.0::DOUBLE) AS asset_vol,
    portfolio / {prior('portfolio', 13)} - 1 AS strategy_return, {full('stddev_samp(strategy_r)', 'strategy_r', 13, _o)} * sqrt(52.0::DOUBLE) AS strategy_vol,
    {full('avg(invested)', 'invested', 13, _o)} AS exposure FROM risk_a""")
define("risk", ("risk_b",), """
  SELECT *, coalesce(exposure = 0, false) AS pure_cash, CASE WHEN coalesce(exposure = 0, false) THEN NULL ELSE strategy_return END AS shown_return,
    CASE WHEN coalesce(exposure = 0, false) THEN NULL ELSE strategy_vol END AS shown_vol FROM risk_b""")
_ro = (["symbol", "bar_ts", "invested", "pure_cash"], [], ["asset_return", "asset_vol", "strategy_return", "strategy_vol", "exposure", "shown_return", "shown_vol"])
QUERIES["w35_rolling_risk"] = lambda s, d: shown(rolling(s, d), *_ro)
SQL["w35_rolling_risk"] = sql(shown_sql("risk", *_ro), "risk")
_dy = (["symbol", "prices", "impossible"], ["price_range"], ["return_range", "vol_range"])
QUERIES["a11_risk_dynamics"] = lambda s, d: shown(risk.dynamics(rolling(s, d)), *_dy)
SQL["a11_risk_dynamics"] = sql(f"""
, z AS (SELECT symbol, count(DISTINCT px) AS prices, max(px) - min(px) AS price_range, max(asset_return) - min(asset_return) AS return_range,
  max(asset_vol) - min(asset_vol) AS vol_range, count(asset_return) AS nr, count(asset_vol) AS nv FROM risk GROUP BY symbol),
y AS (SELECT *, prices > 3 AND price_range > 1e-12 AND nr >= 10 AND return_range <= 1e-12 AND nv >= 10 AND vol_range <= 1e-12 AS impossible FROM z)
{shown_sql('y', *_dy)}""", "risk")
_stt = (["symbol", "bar_ts", "position"], [], ["asset_return", "asset_vol", "strategy_return", "strategy_vol", "exposure", "cash_share"])
QUERIES["a12_risk_state"] = lambda s, d: shown(risk.state(rolling(s, d)), *_stt)
SQL["a12_risk_state"] = sql(f"""
, z AS (SELECT *, avg((shares <= 0)::INT) OVER (PARTITION BY symbol) AS cash_share, CASE WHEN shares > 0 THEN 'INVESTED' ELSE 'CASH' END AS position FROM risk
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1)
{shown_sql('z', *_stt)}""", "risk")


def return_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = path(spark, sf_dir, "trail_1wk")
    x = x.select("symbol", "bar_ts", (F.col("px") / lagged("px") - 1).alias("asset"), (F.col("portfolio") / lagged("portfolio") - 1).alias("strategy"))
    return x.unpivot(["symbol", "bar_ts"], ["asset", "strategy"], "series", "r")


_z = {q: NormalDist().inv_cdf(1 - q) for q in (0.95, 0.99)}
_var_sql = f"""
, s AS (SELECT symbol, bar_ts, 'asset' AS series, px / {prior('px')} - 1 AS r FROM trail_1wk
        UNION ALL SELECT symbol, bar_ts, 'strategy', portfolio / {prior('portfolio')} - 1 FROM trail_1wk),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, series ORDER BY bar_ts DESC) AS back FROM s WHERE r IS NOT NULL AND r > -0.999999999) WHERE back <= 252),
h AS (SELECT *, ln(1 + r) AS l, CASE WHEN count(r) OVER k = 5 THEN exp(sum(ln(1 + r)) OVER k) - 1 END AS h FROM g
      WINDOW k AS (PARTITION BY symbol, series ORDER BY bar_ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
a AS (SELECT symbol, series, count(*) AS n, avg(l) AS mu, stddev_samp(l) AS sd, quantile_cont(h, 0.05) AS h95, quantile_cont(h, 0.01) AS h99 FROM h GROUP BY symbol, series),
v AS (SELECT symbol, series, n, 'Historical' AS method, 0.95 AS confidence, -h95 AS v FROM a UNION ALL SELECT symbol, series, n, 'Historical', 0.99, -h99 FROM a
      UNION ALL SELECT symbol, series, n, 'Parametric Normal', 0.95, -(exp(mu * 5 + {_z[0.95]!r} * sd * sqrt(5.0::DOUBLE)) - 1) FROM a
      UNION ALL SELECT symbol, series, n, 'Parametric Normal', 0.99, -(exp(mu * 5 + {_z[0.99]!r} * sd * sqrt(5.0::DOUBLE)) - 1) FROM a)
SELECT symbol, series, n, method, 'OK' AS status, {r('confidence::DOUBLE')} AS confidence, {r('greatest(0, v)')} AS var FROM v"""
QUERIES["a10_value_at_risk"] = lambda s, d: shown(risk.value_at_risk(return_series(s, d), RISK), ["symbol", "series", "n", "method", "status"], [], ["confidence", "var"])
SQL["a10_value_at_risk"] = sql(_var_sql, "trail_1wk")


def _draws(name: str, seed: int, total: int) -> str:
    """CTEs of the seeded generator in SQL: {name} has the first numbers of its 32-bit stream as (spot, u).

    PCG64 is a linear generator of 128 bits: state -> state * a + c. States are made by doubling: those at i + 2**k follow
    from those at i by a and c to the power 2**k. An output is the high half xor the low, rotated by the top six bits.
    """
    start = np.random.PCG64(seed).state["state"]
    a, c = 0x2360ED051FC65DA44385DF649FCCF645, start["inc"]
    half, whole = 1 << 64, 1 << 128
    wide = lambda v: f"{v}::UHUGEINT"

    def step(a: int, c: int) -> str:
        p = f"(lo * {wide(a % half)} + {wide(c % half)})"
        high = f"({p} // {wide(half)} + hi * {wide(a % half)} % {wide(half)} + lo * {wide(a // half)} % {wide(half)} + {wide(c // half)}) % {wide(half)}"
        return f"{high} AS hi, {p} % {wide(half)} AS lo"

    first = (start["state"] * a + c) % whole
    out = [f"{name}_0 AS (SELECT 0::BIGINT AS i, {wide(first // half)} AS hi, {wide(first % half)} AS lo)"]
    k = 0
    while 2 << k < total:
        out.append(f"{name}_{k + 1} AS (SELECT * FROM {name}_{k} UNION ALL SELECT i + {1 << k} AS i, {step(a, c)} FROM {name}_{k})")
        a, c, k = a * a % whole, c * (a + 1) % whole, k + 1
    powers = "[" + ", ".join(wide(1 << j) for j in range(65)) + "]"
    x, rot = "xor(hi::UBIGINT, lo::UBIGINT)::UHUGEINT", f"(hi // {wide(1 << 58)})::INT"
    out.append(f"{name}_x AS (SELECT i, {x} AS x, {powers}[{rot} + 1] AS p, {powers}[65 - {rot}] AS q FROM {name}_{k})")
    out.append(f"{name}_y AS (SELECT i, x // p + (x % p) * q AS o FROM {name}_x)")
    low, high = (f"({v})::BIGINT" for v in (f"o % {wide(1 << 32)}", f"o // {wide(1 << 32)}"))
    out.append(f"{name} AS (SELECT 2 * i AS spot, {low} AS u FROM {name}_y UNION ALL SELECT 2 * i + 1, {high} FROM {name}_y)")
    return ", ".join(out)


def bootstrap_sql(confidence: float) -> str:
    """CTEs after those of _var_sql: boot_{c} (symbol, series, v), the quantile of all scenarios."""
    c = int(confidence * 1000)
    total = RISK.scenarios * RISK.horizon
    return f"""
{_draws(f"pcg_{c}", RISK.seed + c, total + risk.SPARE)},
pick_{c} AS (SELECT n, (row_number() OVER (PARTITION BY n ORDER BY spot) - 1) AS k, (u * n) // 4294967296 AS place
  FROM pcg_{c}, (SELECT DISTINCT n FROM a) WHERE (u * n) % 4294967296 >= 4294967296 % n),
drawn_{c} AS (SELECT w.symbol, w.series, k // {RISK.horizon} AS scenario, exp(sum(w.l[place + 1])) - 1 AS e
  FROM (SELECT symbol, series, count(*) AS n, list(l ORDER BY bar_ts) AS l FROM h GROUP BY symbol, series) w JOIN pick_{c} p ON p.n = w.n
  WHERE k < {total} GROUP BY ALL),
boot_{c} AS (SELECT symbol, series, -quantile_cont(e, {round(1 - confidence, 6)}) AS v FROM drawn_{c} GROUP BY symbol, series)"""


_boot = ", ".join(bootstrap_sql(q) for q in (0.95, 0.99))
_boot_rows = " UNION ALL ".join(f"SELECT symbol, series, 'Monte Carlo Bootstrap' AS method, {q} AS confidence, v FROM boot_{int(q * 1000)}" for q in (0.95, 0.99))
QUERIES["a09_bootstrap_var"] = lambda s, d: shown(risk.bootstrap(return_series(s, d), RISK), ["symbol", "series", "method"], [], ["confidence", "var"])
SQL["a09_bootstrap_var"] = sql(
    _var_sql[: _var_sql.index("SELECT symbol, series, n, method, 'OK'")] + f", {_boot}\nSELECT symbol, series, method, {r('confidence::DOUBLE')} AS confidence, {r('greatest(0, v)')} AS var FROM ({_boot_rows})",
    "trail_1wk",
)


def four_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of asset, benchmark, the residual to it, and strategy."""
    rel = K.against(spark, sf_dir).select("symbol", "bar_ts", (F.col("bench") / lagged("bench") - 1).alias("benchmark"), F.expm1("resid").alias("residual"))
    rel = rel.unpivot(["symbol", "bar_ts"], ["benchmark", "residual"], "series", "r")
    return return_series(spark, sf_dir).unionByName(rel)


_4 = _var_sql.replace("FROM trail_1wk),", f"""FROM trail_1wk
        UNION ALL SELECT symbol, bar_ts, 'benchmark', bench / {prior('bench')} - 1 FROM rel_1wk UNION ALL SELECT symbol, bar_ts, 'residual', exp(resid) - 1 FROM rel_1wk),""", 1)
QUERIES["a10_four_series"] = lambda s, d: shown(risk.value_at_risk(four_series(s, d), RISK), ["symbol", "series", "n", "method", "status"], [], ["confidence", "var"])
SQL["a10_four_series"] = sql(_4, "trail_1wk", "rel_1wk")


_methods = (["symbol", "series", "n", "method", "status"], [], ["confidence", "var"])
QUERIES["a09_all_methods"] = lambda s, d: shown(risk.all_methods(four_series(s, d), RISK), *_methods)
SQL["a09_all_methods"] = sql(
    _4[: _4.index("SELECT symbol, series, n, method, 'OK'")]
    + f", {_boot}\nSELECT symbol, series, n, method, 'OK' AS status, {r('confidence::DOUBLE')} AS confidence, {r('greatest(0, v)')} AS var"
    + f" FROM (SELECT symbol, series, n, method, confidence, v FROM v UNION ALL SELECT b.symbol, b.series, a.n, method, confidence, v FROM ({_boot_rows}) b JOIN a USING (symbol, series))",
    "trail_1wk",
    "rel_1wk",
)


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.load(spark, sf_dir, "1d")
    sizes = b.groupBy("symbol").agg(F.count("*").alias("n"))
    return risk.window_options(performance.periodicity(b), sizes)


QUERIES["a06_window_options"] = options
SQL["a06_window_options"] = sql("""
, n AS (SELECT symbol, count(*) AS n FROM bars_1d GROUP BY symbol)
SELECT symbol, o.w AS window, o.s AS size FROM n, (VALUES ('1M', 30), ('3M', 91), ('6M', 182), ('1Y', 365)) o(w, s) WHERE o.s < n""", "bars_1d")

# Faults put into daily bars: duplicates, nulls, a zero price, a negative volume, by symbol.
_FAULT = """
  SELECT symbol, bar_ts, CASE WHEN symbol LIKE '3%' AND i % 97 = 5 THEN 0 ELSE open END AS open, high, low, close,
         CASE WHEN symbol LIKE '2%' AND i % 97 = 0 THEN NULL ELSE adj_close END AS adj_close,
         CASE WHEN symbol LIKE '4%' AND i % 50 = 1 THEN -volume ELSE volume END AS volume, i AS arrival FROM {0}
  UNION ALL SELECT symbol, bar_ts, open, high, low, close, adj_close, volume + 7, i + 100000 FROM {0} WHERE symbol LIKE '1%' AND i % 10 = 3"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = bars.load(spark, sf_dir, "1d").withColumn("i", F.row_number().over(by_time()) - 1)
    return spark.sql(_FAULT.format("{b}"), b=numbered)


define("faulty", ("adj_1d",), _FAULT.format("adj_1d"))
QUERIES["p01_validation"] = lambda s, d: checks.status(faulty(s, d))
SQL["p01_validation"] = sql("""
, t AS (SELECT symbol, bar_ts, count(*) AS n FROM faulty GROUP BY ALL), u AS (SELECT symbol, max(n) AS most, sum(n)::BIGINT AS n FROM t GROUP BY symbol),
f AS (SELECT symbol, count(*) FILTER (open IS NULL OR adj_close IS NULL) AS nulls, count(*) FILTER (least(open, high, low, close, adj_close) <= 0) AS low,
      count(*) FILTER (volume < 0) AS neg FROM faulty GROUP BY symbol)
SELECT symbol, n, CASE WHEN most > 1 THEN 'DUPLICATE TIMESTAMP' WHEN nulls > 0 THEN 'MISSING VALUE' WHEN low > 0 THEN 'NON-POSITIVE PRICE'
  WHEN neg > 0 THEN 'NEGATIVE VOLUME' WHEN n < 30 THEN 'TOO FEW OBSERVATIONS' ELSE 'OK' END AS status FROM u JOIN f USING (symbol)""", "faulty")
for _k in (5, 8, 12):
    QUERIES[f"o08_first_faults_{_k}"] = lambda s, d, k=_k: checks.first_faults(faulty(s, d), k).select("symbol", "fault", "n", F.concat_ws(",", F.transform("first", lambda t: F.date_format(t, "yyyy-MM-dd"))).alias("first"))
    SQL[f"o08_first_faults_{_k}"] = sql(f"""
, t AS (SELECT symbol, bar_ts, count(*) AS n, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR adj_close IS NULL OR volume IS NULL) AS nulls,
  count(*) FILTER (least(open, high, low, close, adj_close) <= 0) AS lows, count(*) FILTER (volume < 0) AS neg FROM faulty GROUP BY symbol, bar_ts),
f AS (SELECT symbol, bar_ts, 'DUPLICATE TIMESTAMP' AS fault FROM t WHERE n > 1 UNION ALL SELECT symbol, bar_ts, 'MISSING VALUE' FROM t WHERE nulls > 0
  UNION ALL SELECT symbol, bar_ts, 'NON-POSITIVE PRICE' FROM t WHERE lows > 0 UNION ALL SELECT symbol, bar_ts, 'NEGATIVE VOLUME' FROM t WHERE neg > 0)
SELECT symbol, fault, count(*) AS n, array_to_string(list(strftime(bar_ts, '%Y-%m-%d') ORDER BY bar_ts)[1:{_k}], ',') AS first FROM f GROUP BY symbol, fault""", "faulty")
_bar = (["symbol", "bar_ts"], ["open", "high", "low", "close", "adj_close", "volume"])
QUERIES["p01_valid_only"] = lambda s, d: shown(checks.valid_only(faulty(s, d)), *_bar)
SQL["p01_valid_only"] = sql(shown_sql("faulty WHERE symbol LIKE '5%'", *_bar), "faulty")
QUERIES["p03_latest_arrival"] = lambda s, d: shown(checks.latest(faulty(s, d), "arrival"), *_bar)
SQL["p03_latest_arrival"] = sql(shown_sql("(SELECT * FROM faulty QUALIFY row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY arrival DESC) = 1)", *_bar), "faulty")
QUERIES["p04_missing_fields"] = lambda s, d: checks.missing(faulty(s, d)).withColumn("fields", F.concat_ws(",", "fields"))
SQL["p04_missing_fields"] = sql("SELECT symbol, bar_ts, 'adj_close' AS fields FROM faulty WHERE adj_close IS NULL", "faulty")

# Four routes: as it is; with holes; off by a hair; off by a hundredth now and then.
_ROUTES = """
  SELECT symbol, bar_ts, open, high, low, close, CASE WHEN i % 97 = 0 THEN NULL ELSE adj_close END AS adj_close, volume, 'A' AS route, 1 AS priority FROM {0}
  UNION ALL SELECT symbol, bar_ts, open, high, low, close, adj_close, CASE WHEN i % 89 = 0 THEN NULL ELSE volume END, 'B', 2 FROM {0}
  UNION ALL SELECT symbol, bar_ts, open, high, low, close * 1.00000001D, adj_close, volume, 'C', 3 FROM {0}
  UNION ALL SELECT symbol, bar_ts, open, high, low, CASE WHEN i % 211 = 0 THEN close * 1.01D ELSE close END, adj_close, volume + 0.25D, 'D', 4 FROM {0} WHERE i % 5 <> 2"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = bars.load(spark, sf_dir, "1wk").withColumn("i", F.row_number().over(by_time()) - 1)
    return spark.sql(_ROUTES.format("{b}"), b=numbered)


define("routes", ("adj_1wk",), _ROUTES.format("adj_1wk").replace("1D ", "1::DOUBLE ").replace("1D,", "1::DOUBLE,").replace("0.25D", "0.25::DOUBLE"))
_F = checks.FIELDS
_off = lambda f: f"greatest(abs(max_{f} - {f}), abs(min_{f} - {f}))"
_tol = lambda f: "0.5" if f == "volume" else f"greatest(2e-6, 16 * 1.1920929e-07::DOUBLE * greatest(abs({f}), 1.0))"
_con = (["symbol", "bar_ts", "routes", "conflict"], _F, ["spread_bps"])
QUERIES["j04_consensus"] = lambda s, d: shown(checks.consensus(routes(s, d)).withColumn("routes", F.concat_ws(",", "routes")), *_con)
SQL["j04_consensus"] = sql(f"""
, g AS (SELECT symbol, bar_ts, {', '.join(f'arg_min({f}, priority) FILTER ({f} IS NOT NULL) AS {f}, max({f}) AS max_{f}, min({f}) AS min_{f}' for f in _F)},
  string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM routes GROUP BY symbol, bar_ts),
h AS (SELECT *, {' OR '.join(f'coalesce({_off(f)} > {_tol(f)}, false)' for f in _F)} AS conflict,
  greatest({', '.join(f'coalesce({_off(f)} / abs({f}) * 1e4, 0)' for f in _F[:5])}) AS spread_bps FROM g)
{shown_sql('h', *_con)}""", "routes")
_cc = (["symbol", "field", "compared", "different"], ["max_off"])


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = routes(spark, sf_dir)
    one, two = (x.where(F.col("route") == n).drop("route", "priority") for n in ("A", "D"))
    return checks.cross_check(one, two)


QUERIES["j05_cross_check"] = lambda s, d: shown(crossed(s, d), *_cc)
SQL["j05_cross_check"] = sql("""
, p AS (SELECT a.symbol, a.bar_ts, """ + ", ".join(f"a.{f} AS {f}, b.{f} AS {f}_b" for f in _F) + """ FROM routes a JOIN routes b
        ON a.symbol = b.symbol AND a.bar_ts = b.bar_ts AND a.route = 'A' AND b.route = 'D'),
u AS (""" + " UNION ALL ".join(f"SELECT symbol, '{f}' AS field, abs({f} - {f}_b) AS off, {'0.5' if f == 'volume' else f'1e-8 + 1e-7::DOUBLE * abs({f}_b)'} AS most FROM p WHERE {f} IS NOT NULL AND {f}_b IS NOT NULL" for f in _F) + """),
v AS (SELECT symbol, field, count(*) AS compared, max(off) AS max_off, count(*) FILTER (off > most) AS different FROM u GROUP BY symbol, field)
""" + shown_sql("v", *_cc), "routes")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.load(spark, sf_dir, "1d")
    days, names = b.select("bar_ts").distinct(), b.select("symbol").distinct()
    # Every session for every symbol: the calendar against the list of instruments, a dimension table.
    return checks.gaps(b, days.crossJoin(names))


QUERIES["j09_session_gaps"] = holes
SQL["j09_session_gaps"] = sql("""
SELECT s.symbol, d.bar_ts FROM (SELECT DISTINCT symbol FROM bars_1d) s CROSS JOIN (SELECT DISTINCT bar_ts FROM bars_1d) d
WHERE NOT EXISTS (SELECT 1 FROM bars_1d b WHERE b.symbol = s.symbol AND b.bar_ts = d.bar_ts)""", "bars_1d")
