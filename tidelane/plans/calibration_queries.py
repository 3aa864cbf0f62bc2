"""Parameter search of the lifecycle: queries and their SQL, which walks bar by bar and measures each part on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import calibration
from tidelane.plans.lifecycle_queries import cycle, flags
from tidelane.plans.oracle import define, r, sql
from tidelane.plans.trend_queries import shown, shown_sql
from tidelane.sources import bars

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The default grid, 192 candidates.
DEPTH = "balanced"


# The rank score on measures made from the orders: each priority's clerks' customers as candidates.
_MEASURES = """
SELECT o_orderpriority AS symbol, (o_custkey % 40)::INT AS candidate, 'train' AS part, avg(o_totalprice) AS growth,
  CASE WHEN count(*) % 7 = 0 THEN NULL ELSE max(o_totalprice) END AS calmar, min(o_totalprice) AS sortino, sum(o_totalprice) AS sharpe,
  -max(o_totalprice) AS max_drawdown, (count(*) % 5) / 5.0{d} AS wins, (count(*) % 3) / 3.0{d} AS whipsaws, (count(*) % 2) / 2.0{d} AS exposure,
  count(*) % 4 AS trades
FROM {orders} GROUP BY o_orderpriority, o_custkey % 40"""


def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return shown(calibration.scored(spark.sql(_MEASURES.format(orders="{orders}", d="D"), orders=orders)), ["symbol", "candidate"], [], ["score"])


QUERIES["a23_rank_score"] = rank_scores
_rank = lambda m, w, way: (
    f"{w} * CASE WHEN {m} IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY symbol ORDER BY {m} {way} NULLS LAST) "
    f"+ (count(*) OVER (PARTITION BY symbol, {m}) - 1) / 2.0::DOUBLE) / count({m}) OVER (PARTITION BY symbol) END"
)
SQL["a23_rank_score"] = f"""
WITH m AS ({_MEASURES.format(orders='orders', d='::DOUBLE')}),
s AS (SELECT *, {' + '.join(_rank(m, w, 'ASC' if up else 'DESC') for m, w, up in calibration.WEIGHTS)} AS total FROM m)
SELECT symbol, candidate, {r('CASE WHEN trades < 2 THEN total * 0.55 ELSE total END')} AS score FROM s"""


def _values(numbers: list[int]) -> str:
    return "(VALUES " + ", ".join(f"({n})" for n in numbers) + ")"


_fast, _slow, _signal, _buys, _sells = (_values(v) for v in calibration.GRIDS[DEPTH])
define("cal_grid", (), f"""
  SELECT (row_number() OVER (ORDER BY fast, slow, signal_n, buy, sell) - 1)::INT AS candidate, *
  FROM {_fast} a(fast), {_slow} b(slow), {_signal} c(signal_n), {_buys} d(buy), {_sells} e(sell) WHERE fast < slow""")
# From here on a symbol's bars with one set of lengths, then with one candidate, are a symbol of their own.
define("cal_in", ("macd_x", "cal_grid"), """
  SELECT x.symbol || '|' || fast || '|' || slow || '|' || signal_n AS symbol, x.symbol AS name, i, px, fast, slow, signal_n
  FROM macd_x x, (SELECT DISTINCT fast, slow, signal_n FROM cal_grid)""")
_mean = lambda old, new, n: f"{old} + ({new} - {old}) * (2.0::DOUBLE / ({n} + 1))"
_from = lambda start, old, new, n: f"CASE WHEN i < {start} THEN NULL WHEN i = {start} THEN {new} ELSE {_mean(old, new, n)} END"
define("cal_walk", ("cal_in",), f"""
  SELECT symbol, name, fast, slow, signal_n, i, px AS ef, px AS es, NULL::DOUBLE AS df, NULL::DOUBLE AS ds, NULL::DOUBLE AS s1, NULL::DOUBLE AS s2 FROM cal_in WHERE i = 0
  UNION ALL
  SELECT symbol, name, fast, slow, signal_n, i, ef, es, df, ds, s1, {_from('2 * slow + signal_n - 3', 'os2', 's1', 'signal_n')} AS s2 FROM (
    SELECT *, {_from('2 * slow - 2', 'os1', '((2 * ef - df) - (2 * es - ds))', 'signal_n')} AS s1 FROM (
      SELECT *, {_from('fast - 1', 'odf', 'ef', 'fast')} AS df, {_from('slow - 1', 'ods', 'es', 'slow')} AS ds FROM (
        SELECT x.*, {_mean('w.ef', 'x.px', 'x.fast')} AS ef, {_mean('w.es', 'x.px', 'x.slow')} AS es, w.df AS odf, w.ds AS ods, w.s1 AS os1, w.s2 AS os2
        FROM cal_walk w JOIN cal_in x ON x.symbol = w.symbol AND x.i = w.i + 1)))""")
define("cal_s", ("cal_walk",), """
  SELECT symbol, name, fast, slow, signal_n, i, CASE WHEN i >= 2 * slow - 2 THEN (2 * ef - df) - (2 * es - ds) END AS line,
    CASE WHEN i >= 2 * slow + 2 * signal_n - 4 THEN 2 * s1 - s2 END AS signal FROM cal_walk""")
define("cal_f_a", ("cal_s", "macd_s", "adj_1wk"), """
  SELECT a.* EXCLUDE (symbol), s.symbol, s.name, s.fast, s.slow, s.signal_n, s.line, s.signal, m.plain, m.plain_signal, m.base, m.atr, m.plus_di, m.minus_di, m.adx,
    s.line - s.signal AS hist, m.plain - m.plain_signal AS plain_hist
  FROM cal_s s JOIN adj_1wk a ON a.symbol = s.name AND a.i = s.i JOIN macd_s m ON m.symbol = s.name AND m.i = s.i""")
flags("cal_f")
define("cal_c", ("cal_f", "cal_grid"), """
  SELECT c.* EXCLUDE (symbol), c.symbol || '|' || buy || '|' || sell AS symbol, g.candidate AS number, buy AS at_buy, least(35, sell - 20) AS at_watch,
    least(greatest(50, least(35, sell - 20)), sell - 10) AS at_reduce, sell AS at_sell FROM cal_f c JOIN cal_grid g USING (fast, slow, signal_n)""")
cycle("cal_cycle", source="cal_c", levels=("at_buy", "at_watch", "at_reduce", "at_sell"))
define("cal_n", ("bars_1wk",), "SELECT symbol, count(*) AS n FROM bars_1wk GROUP BY symbol HAVING count(*) >= 180")
define("cal_split", ("cal_n",), """
  SELECT symbol, unnest([{'part': 'train', 'a': 0, 'b': t}, {'part': 'validation', 'a': t, 'b': v}, {'part': 'held_out', 'a': v, 'b': n}], recursive := true)
  FROM (SELECT *, least(greatest(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)), t + 20), n - 20)::BIGINT AS v
        FROM (SELECT *, greatest(floor(n * 0.6::DOUBLE), 100)::BIGINT AS t FROM cal_n))""")
define("cal_folds", ("cal_n",), """
  SELECT symbol, unnest([{'part': 'past_' || k, 'a': 0, 'b': a}, {'part': 'test_' || k, 'a': a, 'b': b}], recursive := true)
  FROM (SELECT symbol, n, k, first + k * size AS a, CASE WHEN k = 2 THEN n ELSE least(n, first + (k + 1) * size) END AS b
        FROM (SELECT *, greatest(10, (n - first) // 3) AS size FROM (SELECT *, greatest(floor(n * 0.45::DOUBLE), 100)::BIGINT AS first FROM cal_n)), (VALUES (0), (1), (2)) f(k))
  WHERE a < n - 2 AND b - a >= 3""")


def measures(name: str, parts: str) -> None:
    """CTE {name}: the measures of each part of parts and their scores, and {name}_m without scores."""
    own = "PARTITION BY symbol, candidate, part ORDER BY bar_ts"
    define(f"{name}_p", ("cal_cycle", parts), f"""
  SELECT s.symbol, part, number AS candidate, bar_ts, i, portfolio, shares, adj_open, first_buy, first_sell FROM cal_cycle c JOIN {parts} s ON s.symbol = c.name AND i >= a AND i < b""")
    define(f"{name}_q", (f"{name}_p",), f"""
  SELECT *, portfolio / lag(portfolio) OVER ({own}) - 1 AS r, portfolio / max(portfolio) OVER ({own} ROWS UNBOUNDED PRECEDING) - 1 AS dd,
    last_value(CASE WHEN first_buy = 1 THEN i END IGNORE NULLS) OVER ({own} ROWS UNBOUNDED PRECEDING) AS bought_at,
    last_value(CASE WHEN first_buy = 1 THEN adj_open END IGNORE NULLS) OVER ({own} ROWS UNBOUNDED PRECEDING) AS paid FROM {name}_p""")
    define(f"{name}_a", (f"{name}_q",), f"""
  SELECT symbol, candidate, part, count(*) AS bars, min(bar_ts) AS from_ts, max(bar_ts) AS to_ts, arg_min(portfolio, i) AS p0, arg_max(portfolio, i) AS p1, min(dd) AS fall,
    avg(r) AS mean, CASE WHEN count(r) > 1 THEN stddev_samp(r) END AS sd, stddev_samp(r) FILTER (r < 0) AS down, avg((shares > 0)::INT) AS held,
    count(*) FILTER (first_sell = 1 AND bought_at IS NOT NULL) AS closed, count(*) FILTER (first_sell = 1 AND adj_open > paid) AS won,
    count(*) FILTER (first_sell = 1 AND i - bought_at <= 10) AS brief, date_diff('day', min(bar_ts), max(bar_ts)) AS days
  FROM {name}_q GROUP BY symbol, candidate, part""")
    define(f"{name}_b", (f"{name}_a",), f"""
  SELECT *, pow(p1 / p0, 1 / greatest(days / 365.25::DOUBLE, 1.0::DOUBLE / py)) - 1 AS g, CASE WHEN sd * sqrt(py) > 1e-12 THEN mean * py / (sd * sqrt(py)) END AS sh,
    CASE WHEN down * sqrt(py) > 1e-12 THEN mean * py / (down * sqrt(py)) END AS so
  FROM (SELECT *, CASE WHEN days / (bars - 1.0::DOUBLE) <= 2 THEN 252 WHEN days / (bars - 1.0::DOUBLE) <= 10 THEN 52 ELSE 12 END AS py FROM {name}_a)""")
    one = lambda c, k: f"CASE WHEN bars >= 3 THEN round({c}, 9) END AS {k}"
    columns = [one("g", "growth"), one("fall", "max_drawdown"), one("sd * sqrt(py)", "volatility"), one("sh", "sharpe"), one("so", "sortino"), one("CASE WHEN fall < 0 THEN g / abs(fall) END", "calmar")]
    columns += [one("CASE WHEN closed > 0 THEN won::DOUBLE / closed END", "wins"), one("CASE WHEN closed > 0 THEN brief::DOUBLE / closed END", "whipsaws"), one("held", "exposure")]
    define(f"{name}_m", (f"{name}_b",), f"""
  SELECT symbol, candidate, part, bars, from_ts, to_ts, {', '.join(columns)}, CASE WHEN bars >= 3 THEN closed ELSE 0 END AS trades FROM {name}_b""")
    rank = lambda m, w, up: (
        f"{w} * CASE WHEN {m} IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY symbol, part ORDER BY {m} {'ASC' if up else 'DESC'} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY symbol, part, {m}) - 1) / 2.0::DOUBLE) / count({m}) OVER (PARTITION BY symbol, part) END"
    )
    define(name, (f"{name}_m",), f"""
  SELECT * EXCLUDE (total), round(CASE WHEN trades < 2 THEN total * 0.55 ELSE total END, 9) AS score
  FROM (SELECT *, {' + '.join(rank(*x) for x in calibration.WEIGHTS)} AS total FROM {name}_m)""")


measures("cal_x", "cal_split")
measures("cal_y", "cal_folds")
define("cal_wide", ("cal_x", "cal_grid"), """
  SELECT * FROM (SELECT symbol, candidate, max(CASE WHEN part = 'train' THEN score END) AS train, max(CASE WHEN part = 'validation' THEN score END) AS validation
                 FROM cal_x GROUP BY symbol, candidate) JOIN cal_grid USING (candidate)""")
define("cal_robust", ("cal_wide",), """
  SELECT *, CASE WHEN train >= round(quantile_cont(train, 0.75) OVER (PARTITION BY symbol), 9) THEN round(0.7 * train + 0.3 * validation, 9) ELSE 0 END AS robust FROM cal_wide""")
define("cal_near", ("cal_robust",), f"""
  SELECT x.symbol, x.candidate, avg((y.robust >= round(0.95 * x.robust, 9))::INT) AS near FROM cal_robust x JOIN cal_robust y ON x.symbol = y.symbol
    AND {' AND '.join(f'abs(x.{k} - y.{k}) <= {m}' for k, m in zip(('fast', 'slow', 'signal_n', 'buy', 'sell'), calibration.NEAR))} GROUP BY ALL""")
define("cal_rank", ("cal_robust", "cal_near"), """
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY final DESC, validation DESC, train DESC, plateau DESC, candidate)::INT AS place
  FROM (SELECT *, round(robust * (0.85 + 0.15 * plateau), 9) AS final FROM (SELECT *, CASE WHEN robust > 0 THEN near ELSE 0.0 END AS plateau FROM cal_robust JOIN cal_near USING (symbol, candidate)))""")
define("cal_forward", ("cal_y",), """
  SELECT c.symbol, c.fold, c.candidate, past_score, past_end, t.* EXCLUDE (symbol, candidate, part, score)
  FROM (SELECT symbol, candidate, regexp_extract(part, '[0-9]+')::INT AS fold, score AS past_score, to_ts AS past_end FROM cal_y WHERE part LIKE 'past%'
        QUALIFY row_number() OVER (PARTITION BY symbol, part ORDER BY score DESC, candidate) = 1) c
  JOIN cal_y t ON t.symbol = c.symbol AND t.candidate = c.candidate AND t.part = 'test_' || c.fold""")


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's candidates, with the bars that are left once their lines are known."""
    sizes = bars.load(spark, sf_dir, "1wk").groupBy("symbol").agg(F.count("*").alias("n"))
    found = sizes.crossJoin(F.broadcast(calibration.grid(spark, DEPTH)))
    left = F.greatest(F.lit(0), F.col("n") - 2 * F.col("slow") - 2 * F.col("signal_n") + 4)
    return found.select("symbol", "candidate", "fast", "slow", "signal_n", "buy", "sell", left.alias("usable"))


QUERIES["a26_parameter_grid"] = usable
SQL["a26_parameter_grid"] = sql("""
SELECT symbol, g.*, u.usable FROM cal_grid g
JOIN (SELECT symbol, slow, signal_n, count(line) FILTER (signal IS NOT NULL) AS usable FROM (SELECT name AS symbol, slow, signal_n, line, signal FROM cal_s WHERE fast = 8) GROUP BY ALL) u USING (slow, signal_n)""", "cal_grid", "cal_s", recursive=True)


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the grid of each symbol's candidates, with the difference of the bars they can use."""
    u = usable(spark, sf_dir)
    x = calibration.neighbours(calibration.grid(spark, DEPTH)).join(u.select("symbol", "candidate", "usable"), "candidate")
    other = u.select("symbol", F.col("candidate").alias("other"), F.col("usable").alias("u"))
    return x.join(other, ["symbol", "other"]).select("symbol", "candidate", "other", (F.col("usable") - F.col("u")).alias("more"))


QUERIES["j11_neighbours"] = near
SQL["j11_neighbours"] = sql(f"""
, n AS (SELECT symbol, count(*) AS n FROM bars_1wk GROUP BY symbol),
x AS (SELECT symbol, g.*, greatest(0, n - 2 * slow - 2 * signal_n + 4) AS usable FROM n, cal_grid g)
SELECT x.symbol, x.candidate, y.candidate AS other, x.usable - y.usable AS more FROM x JOIN x y ON x.symbol = y.symbol
  AND {' AND '.join(f'abs(x.{k} - y.{k}) <= {m}' for k, m in zip(('fast', 'slow', 'signal_n', 'buy', 'sell'), calibration.NEAR))}""", "bars_1wk", "cal_grid")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.paths(bars.load(spark, sf_dir, "1wk"), DEPTH)


_measured = ["growth", "max_drawdown", "volatility", "sharpe", "sortino", "calmar", "wins", "whipsaws", "exposure"]
_seg = (["symbol", "candidate", "part", "bars", "trades", "from_ts", "to_ts"], [], [*_measured, "score"])
QUERIES["a22_segments"] = lambda s, d: shown(calibration.scored(calibration.segments(_paths(s, d), calibration.split_parts)), *_seg)
SQL["a22_segments"] = sql(shown_sql("cal_x", *_seg), "cal_x", recursive=True)
_place = (["symbol", "candidate", "fast", "slow", "signal_n", "buy", "sell", "place"], [], ["train", "validation", "robust", "plateau", "final"])


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's candidates in order of choice; the part held out is not looked at."""
    found = calibration.scored(calibration.segments(_paths(spark, sf_dir), lambda n: calibration.split_parts(n)[:2]))
    return shown(calibration.ranking(found, calibration.grid(spark, DEPTH)), *_place)


QUERIES["a24_ranking"] = ranked
SQL["a24_ranking"] = sql(shown_sql("cal_rank", *_place), "cal_rank", recursive=True)
_forward = (["symbol", "fold", "candidate", "bars", "trades", "past_end", "from_ts", "to_ts"], [], ["past_score", *_measured])
QUERIES["a25_walk_forward"] = lambda s, d: shown(calibration.walk_forward(_paths(s, d)), *_forward)
SQL["a25_walk_forward"] = sql(shown_sql("cal_forward", *_forward), "cal_forward", recursive=True)
