"""SQL that gives the same rows as the registered queries, built from common table expressions.

CTES maps a name to (names it reads, text); sql() puts the needed ones in order before a query.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def r(value: str, digits: int = 6) -> str:
    return f"round({value} + 1e-9, {digits})"


def define(name: str, reads: tuple[str, ...], text: str) -> None:
    CTES[name] = (reads, text)


def sql(query: str, *reads: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                add(other)
            order.append(name)

    for name in reads:
        add(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + query


def _bars(grain: str, table: str, symbol: str, ts: str, key: str, price: str, bar: str) -> None:
    define(f"g_{grain}", (), f"""
      SELECT {symbol} AS symbol, ({bar})::TIMESTAMP AS bar_ts, arg_min({price}, {key}) AS open, max({price}) AS high,
             min({price}) AS low, arg_max({price}, {key}) AS close, count(*)::DOUBLE AS volume
      FROM {table} GROUP BY ALL""")
    define(f"bars_{grain}", (f"g_{grain}",), f"""
      SELECT symbol, bar_ts, open, high, low, close,
             close * (0.95::DOUBLE + 0.05::DOUBLE * row_number() OVER (PARTITION BY symbol ORDER BY bar_ts)
                      / count(*) OVER (PARTITION BY symbol)) AS adj_close, volume
      FROM g_{grain}""")
    define(f"adj_{grain}", (f"bars_{grain}",), f"""
      SELECT *, open * scale AS adj_open, high * scale AS adj_high, low * scale AS adj_low, close * scale AS px,
             volume / 1000 AS volume_k, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i
      FROM (SELECT *, adj_close / close AS scale FROM bars_{grain})""")


_bars("1wk", "orders", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", "date_trunc('week', o_orderdate)")
_bars("1d", "orders", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", "date_trunc('day', o_orderdate)")
_EVENT = "row(ts, event_id)"
_bars("1h", "events", "event_type", "ts", _EVENT, "value", "date_trunc('hour', ts)")
_bars("15m", "events", "event_type", "ts", _EVENT, "value", "time_bucket(INTERVAL 15 MINUTE, ts)")

W = "PARTITION BY symbol ORDER BY bar_ts"


def rows(first: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING" if last < 0 else f"{last} FOLLOWING"
    return f"{W} ROWS BETWEEN {-first} PRECEDING AND {end}"


SO_FAR = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def full(call: str, counted: str, n: int, over: str) -> str:
    return f"CASE WHEN count({counted}) OVER ({over}) = {n} THEN {call} OVER ({over}) END"


def prior(column: str, n: int = 1) -> str:
    return f"lag({column}, {n}) OVER ({W})"


def trend(grain: str, stop: str, name: str, atr=8, times=10.0, band=40, width=2.5, entry=52) -> None:
    """CTEs of tidelane.operators.trend: {name}_sig and {name}."""
    define(f"{name}_a", (f"adj_{grain}",), f"""
      SELECT *, CASE WHEN i = 0 THEN close / open - 1 ELSE px / {prior('px')} - 1 END AS ret,
        CASE WHEN i > 0 THEN greatest(adj_high - adj_low, abs(adj_high - {prior('px')}), abs(adj_low - {prior('px')})) END AS true_range
      FROM adj_{grain}""")
    define(f"{name}_b", (f"{name}_a",), f"""
      SELECT *, CASE WHEN i > 0 THEN {times} * avg(true_range) OVER ({rows(-atr)}) END AS atr_stop,
        max(px) OVER ({rows(-entry)}) AS max_price,
        CASE WHEN i > 0 THEN stddev_pop(px) OVER ({rows(-band)}) END AS band_sd,
        CASE WHEN i > 0 THEN avg(px) OVER ({rows(-band)}) - {width} * stddev_pop(px) OVER ({rows(-band)}) END AS lower_band
      FROM {name}_a""")
    define(f"{name}_c", (f"{name}_b",), f"""
      SELECT *, coalesce({prior('px')} >= {prior('max_price')}, false) AS buys FROM {name}_b""")
    define(f"{name}_d", (f"{name}_c",), f"""
      SELECT *, max(CASE WHEN i = 1 OR buys THEN atr_stop END) OVER ({SO_FAR}) AS trail FROM {name}_c""")
    column = {"atr": "atr_stop", "band": "lower_band", "trailing": "trail"}[stop]
    define(f"{name}_sig", (f"{name}_d",), f"""
      SELECT *, CASE WHEN buys THEN 'BUY' WHEN coalesce({prior('px')} <= {prior(column)}, false) THEN 'SELL' ELSE '' END AS signal
      FROM {name}_d""")
    positions(name, f"{name}_sig")


def positions(name: str, source: str, capital: float = 100_000.0) -> None:
    """CTE {name}: all in, all out on the signals of source."""
    define(f"{name}_p", (source,), f"""
      SELECT *, coalesce(last_value(CASE WHEN signal = 'BUY' THEN 1 WHEN signal = 'SELL' THEN 0 END IGNORE NULLS) OVER ({SO_FAR}), 0) AS held
      FROM {source}""")
    define(f"{name}_q", (f"{name}_p",), f"""
      SELECT *, (held = 1 AND coalesce({prior('held')}, 0) = 0)::INT AS first_buy,
             (held = 0 AND coalesce({prior('held')}, 0) = 1)::INT AS first_sell FROM {name}_p""")
    define(f"{name}_r", (f"{name}_q",), f"""
      SELECT *, {capital} * exp(sum(CASE WHEN first_sell = 1 THEN ln(adj_open) WHEN first_buy = 1 THEN -ln(adj_open) ELSE 0 END) OVER ({SO_FAR})) AS wealth
      FROM {name}_q""")
    define(name, (f"{name}_r",), f"""
      SELECT *, CASE WHEN held = 1 THEN wealth ELSE 0 END AS shares, CASE WHEN held = 0 THEN wealth ELSE 0 END AS cash,
             CASE WHEN held = 1 THEN wealth ELSE 0 END * px + CASE WHEN held = 0 THEN wealth ELSE 0 END AS portfolio,
             {capital} * px / first_value(px) OVER ({SO_FAR}) AS buy_hold
      FROM {name}_r""")


trend("1wk", "trailing", "trail_1wk")
trend("1wk", "band", "band_1wk")
trend("1d", "atr", "atr_1d", times=1.5, entry=20)


def kernel(grain: str, name: str, weights: list[float], band: float, source: str = "px") -> None:
    """CTE {name}: tidelane.operators.kernel.indicator with a full lookback."""
    n = len(weights)
    old_first = "[" + ", ".join(f"{v!r}::DOUBLE" for v in reversed(weights)) + "]"
    total = f"{sum(weights)!r}::DOUBLE"
    define(f"{name}_a", (f"adj_{grain}",), f"SELECT *, {source} AS src, list({source}) OVER ({rows(-(n - 1))}) AS seen FROM adj_{grain}")
    define(f"{name}_b", (f"{name}_a",), f"""
      SELECT *, CASE WHEN len(seen) = {n} THEN list_inner_product(seen, {old_first}) / {total} END AS trend FROM {name}_a""")
    define(f"{name}_c", (f"{name}_b",), f"""
      SELECT *, CASE WHEN trend IS NOT NULL THEN list_inner_product(list_transform(seen, lambda v: abs(v - trend)), {old_first}) / {total} END AS residual
      FROM {name}_b""")
    define(f"{name}_d", (f"{name}_c",), f"""
      SELECT * EXCLUDE (seen), trend + residual * {band} AS upper, trend - residual * {band} AS lower, trend - {prior('trend')} AS slope FROM {name}_c""")
    define(f"{name}_e", (f"{name}_d",), f"""
      SELECT *, coalesce(sign(slope), 0)::INT AS direction, slope / {prior('trend')} AS norm_slope FROM {name}_d""")
    define(f"{name}_f", (f"{name}_e",), f"SELECT *, norm_slope - {prior('norm_slope')} AS accel FROM {name}_e")
    define(name, (f"{name}_f",), f"""
      SELECT *, direction > 0 AND coalesce({prior('direction')} <= 0, false) AS bull_reversal,
        direction < 0 AND coalesce({prior('direction')} >= 0, false) AS bear_reversal,
        coalesce(src > upper AND {prior('src')} <= {prior('upper')}, false) AS cross_above_upper,
        coalesce(src < lower AND {prior('src')} >= {prior('lower')}, false) AS cross_below_lower,
        coalesce(accel > 0 AND {prior('accel')} <= 0 AND direction <= 0, false) AS momentum_up,
        coalesce(accel < 0 AND {prior('accel')} >= 0 AND direction >= 0, false) AS momentum_down,
        trend - greatest(coalesce(residual, 0) * 0.35, abs(coalesce(trend, 0)) * 0.002) AS bull_marker,
        trend + greatest(coalesce(residual, 0) * 0.35, abs(coalesce(trend, 0)) * 0.002) * 1.8 AS down_marker,
        src / trend - 1 AS price_gap, (upper - lower) / trend AS band_width,
        coalesce(src > trend, false) AS above_path, coalesce(src < trend, false) AS below_path
      FROM {name}_f""")


def kernel_strategy(source: str, name: str, enter_after: int = 2, leave_after: int = 1, reversal: bool = False) -> None:
    def lasts(value: int, n: int) -> str:
        over = rows(-(n - 1)) if n > 1 else f"{W} ROWS BETWEEN CURRENT ROW AND CURRENT ROW"
        return f"(min((direction = {value})::INT) OVER ({over}) = 1 AND count(direction) OVER ({over}) = {n})"

    enter = "bull_reversal" if reversal else lasts(1, enter_after)
    leave = "bear_reversal" if reversal else lasts(-1, leave_after)
    known = "trend IS NOT NULL AND i > 0"
    define(f"{name}_cond", (source,), f"""
      SELECT *, coalesce({known} AND {enter} AND above_path AND src <= upper, false) AS enter,
        coalesce({known} AND ({leave} OR below_path), false) AS leave FROM {source}""")
    define(f"{name}_sig", (f"{name}_cond",), f"""
      SELECT *, CASE WHEN coalesce({prior('enter')}, false) THEN 'BUY' WHEN coalesce({prior('leave')}, false) THEN 'SELL' ELSE '' END AS signal
      FROM {name}_cond""")
    positions(name, f"{name}_sig")


def relative(grain: str, name: str, w: int = 40, h: int = 8) -> None:
    past = rows(-w, -1)
    define(f"{name}_m", (f"bars_{grain}",), f"""
      SELECT symbol, coalesce(lead(symbol) OVER (ORDER BY symbol), first_value(symbol) OVER (ORDER BY symbol)) AS benchmark
      FROM (SELECT DISTINCT symbol FROM bars_{grain})""")
    define(f"{name}_n", (f"bars_{grain}",), f"SELECT symbol, count(*) AS n FROM bars_{grain} GROUP BY symbol")
    define(f"{name}_a", (f"{name}_m", f"{name}_n", f"adj_{grain}"), f"""
      SELECT a.symbol, a.bar_ts, a.px, b.adj_close AS bench, count(*) OVER (PARTITION BY a.symbol) AS matched,
        count(*) OVER (PARTITION BY a.symbol) / least(n.n, m.n)::DOUBLE AS aligned
      FROM adj_{grain} a JOIN {name}_m k ON a.symbol = k.symbol JOIN bars_{grain} b ON b.symbol = k.benchmark AND b.bar_ts = a.bar_ts
      JOIN {name}_n n ON n.symbol = a.symbol JOIN {name}_n m ON m.symbol = k.benchmark""")
    define(f"{name}_b", (f"{name}_a",), f"""
      SELECT *, ln(px) - ln({prior('px')}) AS a, ln(bench) - ln({prior('bench')}) AS b, ln(px / bench) AS ratio
      FROM {name}_a WHERE aligned >= 0.8 AND matched > {w + h + 2}""")
    define(f"{name}_c", (f"{name}_b",), f"""
      SELECT *, {full('covar_samp(a, b)', 'a', w, past)} / {full('var_samp(b)', 'b', w, past)} AS beta FROM {name}_b""")
    define(f"{name}_d", (f"{name}_c",), f"""
      SELECT *, {full('avg(a)', 'a', w, past)} - beta * {full('avg(b)', 'b', w, past)} AS alpha FROM {name}_c""")
    define(f"{name}_e", (f"{name}_d",), f"SELECT *, a - (alpha + beta * b) AS resid FROM {name}_d")
    define(f"{name}_f", (f"{name}_e",), f"""
      SELECT *, {full('stddev_samp(resid)', 'resid', w, past)} AS sigma, {full('sum(resid)', 'resid', h, rows(-(h - 1)))} AS drift,
        (ratio - {full('avg(ratio)', 'ratio', w, past)}) / {full('stddev_samp(ratio)', 'ratio', w, past)} AS ratio_z,
        px / {prior('px', h)} - 1 AS asset_h, bench / {prior('bench', h)} - 1 AS bench_h
      FROM {name}_e""")
    define(name, (f"{name}_f",), f"""
      SELECT x.symbol, x.bar_ts, bench, aligned, beta, alpha, resid, resid / sigma AS resid_z, drift,
        drift / (sigma * sqrt({h}::DOUBLE)) AS drift_z, ratio_z, asset_h, bench_h, asset_h - bench_h AS relative_h
      FROM bars_{grain} x LEFT JOIN {name}_f y ON x.symbol = y.symbol AND x.bar_ts = y.bar_ts""")
