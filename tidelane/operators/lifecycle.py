"""Double-smoothed MACD, directional strength, scores, and the position lifecycle on them.

Exponential means are recursions that no window function expresses, and the lifecycle depends on
its own path; both run as a grouped map by symbol over narrow columns (one instrument's bars are
one group; symbols spread over tasks). Everything between them is window columns.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelane.functions.scan import CHUNK, Mean, chunked, exponential
from tidelane.functions.windows import by_time, div, flag, frame, full, prior, so_far
from tidelane.sources.bars import adjusted


@dataclass(frozen=True)
class Macd:
    fast: int = 12
    slow: int = 26
    signal: int = 9
    plain_fast: int = 12
    plain_slow: int = 26
    plain_signal: int = 9
    adx: int = 14
    trend: int = 50
    swing: int = 20
    cross_bars: int = 3
    slope_bars: int = 2
    histogram_bars: int = 2
    adx_least: float = 18.0
    most_extension: float = 3.0
    signal_kind: str = "dema"
    #: Optional parts of the scores; one that is off leaves the denominator too.
    use_plain: bool = True
    use_adx: bool = True
    use_kernel: bool = True
    no_chase: bool = True


@dataclass(frozen=True)
class Cycle:
    capital: float = 100_000.0
    buy: float = 65.0
    watch: float = 35.0
    reduce: float = 50.0
    sell: float = 65.0
    buy_bars: int = 1
    sell_bars: int = 2
    cooldown: int = 3
    atr_times: float = 3.0
    hard_stop: float = 0.12
    need_bull_cross: bool = True
    need_bear_cross: bool = False
    execute_reduce: bool = False
    reduce_fraction: float = 0.5


#: Named settings; fixed values.
PRESETS = {
    "balanced": (Macd(), Cycle()),
    "continuation": (
        Macd(cross_bars=2, slope_bars=1, histogram_bars=1, use_adx=False, use_kernel=False, no_chase=False),
        Cycle(buy=60.0, sell=60.0, sell_bars=1, cooldown=1, need_bear_cross=True),
    ),
    "fast": (
        Macd(fast=8, slow=21, signal=5, trend=34, cross_bars=2, slope_bars=1, histogram_bars=1, adx_least=16.0, most_extension=2.8),
        Cycle(buy=60.0, watch=30.0, reduce=45.0, sell=60.0, sell_bars=1, cooldown=2, atr_times=2.7, hard_stop=0.10),
    ),
    "smooth": (
        Macd(fast=14, slow=35, signal=11, trend=75, cross_bars=4, slope_bars=3, adx_least=20.0, most_extension=3.5),
        Cycle(buy=70.0, watch=40.0, reduce=55.0, sell=70.0, buy_bars=2, sell_bars=3, cooldown=5, atr_times=3.5, hard_stop=0.15),
    ),
}

#: What each state means for the next open.
STATES = [
    ("WAIT / CASH", "no position, no setup", "none"),
    ("BUY WATCH", "a setup forms, or waits for the cooldown", "none"),
    ("BUY", "setup confirmed", "buy at the next open"),
    ("HOLD", "position kept", "none"),
    ("SELL WATCH", "first weakness", "none"),
    ("REDUCE", "weakness below a full sale", "part of the position, once, where that is switched on"),
    ("SELL", "weakness confirmed", "sell at the next open"),
    ("RISK EXIT", "a stop is breached", "sell at the next open"),
]


def checked(m: Macd, c: Cycle) -> None:
    """Raises ValueError where settings contradict one another."""
    lengths = [m.fast, m.slow, m.signal, m.plain_fast, m.plain_slow, m.plain_signal, m.adx, m.trend, m.swing, m.cross_bars, m.slope_bars, m.histogram_bars]
    if min(lengths) < 1 or m.fast >= m.slow or m.plain_fast >= m.plain_slow:
        raise ValueError("lengths must be 1 or more, the fast ones below the slow ones")
    if m.signal_kind not in ("dema", "ema") or m.adx_least < 0 or m.most_extension <= 0:
        raise ValueError("signal_kind is dema or ema; limits are positive")
    if c.capital <= 0 or not 0 <= c.watch <= c.reduce <= c.sell <= 100 or not 0 <= c.buy <= 100:
        raise ValueError("capital is positive; 0 <= watch <= reduce <= sell <= 100 and 0 <= buy <= 100")
    if min(c.buy_bars, c.sell_bars) < 1 or c.cooldown < 0 or c.atr_times <= 0 or not 0 < c.hard_stop < 1 or not 0 < c.reduce_fraction < 1:
        raise ValueError("bars are 1 or more, the stops positive, the fractions between 0 and 1")


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(STATES)], "place int, state string, meaning string, execution string")


def preset_table(spark: SparkSession) -> DataFrame:
    """The presets' settings: preset, setting, value."""
    rows = [(name, k, str(v)) for name, both in PRESETS.items() for part in both for k, v in asdict(part).items()]
    return spark.createDataFrame(rows, "preset string, setting string, value string")


def ema(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(span=n, adjust=False, min_periods=n).mean()


def dema(x: pd.Series, n: int) -> pd.Series:
    one = ema(x, n)
    return 2 * one - ema(one, n)


def wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


_SMOOTH = ["line", "signal", "plain", "plain_signal", "base", "atr", "plus_di", "minus_di", "adx"]


def _inputs(bars: DataFrame, *more: Column) -> DataFrame:
    """What the recursive columns are made of: px, true range and directional moves."""
    x = adjusted(bars).withColumns(
        {
            "tr": F.greatest(F.col("adj_high") - F.col("adj_low"), F.abs(F.col("adj_high") - prior("px")), F.abs(F.col("adj_low") - prior("px"))),
            "up": F.col("adj_high") - prior("adj_high"),
            "down": prior("adj_low") - F.col("adj_low"),
        }
    )
    return x.select(
        "symbol",
        "bar_ts",
        "px",
        "tr",
        F.when((F.col("up") > F.col("down")) & (F.col("up") > 0), F.col("up")).otherwise(0.0).alias("plus"),
        F.when((F.col("down") > F.col("up")) & (F.col("down") > 0), F.col("down")).otherwise(0.0).alias("minus"),
        *more,
    )


def smoothed_by_scan(bars: DataFrame, c: Macd = Macd(), chunk: int = CHUNK) -> DataFrame:
    """smoothed() without a grouped map: chunks of a symbol are scanned on their own (functions/scan.py)."""
    span = Mean.span
    wilder = lambda name, source: Mean(name, source, 1 / c.adx, c.adx)
    x = exponential(
        chunked(_inputs(bars), chunk),
        [
            *[span(f"{k}1", "px", n) for k, n in (("fast", c.fast), ("slow", c.slow), ("base", c.trend))],
            *[span("plain_fast", "px", c.plain_fast), span("plain_slow", "px", c.plain_slow)],
            *[wilder("atr", "tr"), wilder("ups", "plus"), wilder("downs", "minus")],
        ],
    )
    x = x.withColumns({"plain": F.col("plain_fast") - F.col("plain_slow"), **{f"{k}_di": 100 * div(F.col(v), F.col("atr")) for k, v in (("plus", "ups"), ("minus", "downs"))}})
    x = x.withColumn("strength", div(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    x = exponential(
        x,
        [
            *[span(f"{k}2", f"{k}1", n) for k, n in (("fast", c.fast), ("slow", c.slow), ("base", c.trend))],
            *[span("plain_signal", "plain", c.plain_signal), wilder("adx", "strength")],
        ],
    )
    double = lambda k: 2 * F.col(f"{k}1") - F.col(f"{k}2")
    x = x.withColumns({"line": double("fast") - double("slow"), "base": double("base")})
    x = exponential(x, [span("signal1", "line", c.signal)])
    if c.signal_kind == "dema":
        x = exponential(x, [span("signal2", "signal1", c.signal)]).withColumn("signal", double("signal"))
    else:
        x = x.withColumnRenamed("signal1", "signal")
    return x.select("symbol", "bar_ts", *_SMOOTH)


def smoothed(bars: DataFrame, c: Macd = Macd(), lengths: dict[str, Column] | None = None) -> DataFrame:
    """symbol, bar_ts and the recursive columns; lengths replaces fields of c by columns that are constant in a symbol.

    A grouped map: the bars of one symbol are one group. smoothed_by_scan() gives the same without that.
    """
    own = list(lengths or {})
    x = _inputs(bars, *[v.cast("int").alias(f"own_{k}") for k, v in (lengths or {}).items()])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = replace(c, **{k: int(g[f"own_{k}"].iat[0]) for k in own})
        g = g.sort_values("bar_ts")
        line = dema(g["px"], m.fast) - dema(g["px"], m.slow)
        plain = ema(g["px"], m.plain_fast) - ema(g["px"], m.plain_slow)
        atr = wilder(g["tr"], m.adx)
        plus, minus = (100 * wilder(g[k], m.adx) / atr.replace(0, np.nan) for k in ("plus", "minus"))
        strength = 100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan)
        columns = [line, (dema if m.signal_kind == "dema" else ema)(line, m.signal), plain, ema(plain, m.plain_signal), dema(g["px"], m.trend), atr, plus, minus, wilder(strength, m.adx)]
        return pd.DataFrame({"symbol": g["symbol"], "bar_ts": g["bar_ts"]} | dict(zip(_SMOOTH, columns)))

    out = x.groupBy("symbol").applyInPandas(run, "symbol string, bar_ts timestamp_ntz, " + ", ".join(f"{k} double" for k in _SMOOTH))
    # NaN from the recursion is null here.
    return out.select("symbol", "bar_ts", *[F.nanvl(F.col(k), F.lit(None).cast("double")).alias(k) for k in _SMOOTH])


def _steady(condition: Column, n: int) -> Column:
    return F.sum(flag(condition).cast("int")).over(frame(-(n - 1))) == n


def indicator(bars: DataFrame, c: Macd = Macd(), kernel: DataFrame | None = None, lengths: dict[str, Column] | None = None) -> DataFrame:
    """Adjusted bars with all columns and the two scores (0 to 100).

    kernel (symbol, bar_ts, direction, trend) adds its parts to the scores; without it they are not
    in the denominator. lengths: as for smoothed().
    """
    x = adjusted(bars).join(smoothed(bars, c, lengths), ["symbol", "bar_ts"])
    kernel = kernel if c.use_kernel else None
    if kernel is not None:
        x = x.join(kernel.select("symbol", "bar_ts", "direction", F.col("trend").alias("path")), ["symbol", "bar_ts"], "left")
    x = x.withColumns({"hist": F.col("line") - F.col("signal"), "plain_hist": F.col("plain") - F.col("plain_signal")})
    x = x.withColumns(
        {
            "signal_slope": F.col("signal") - prior("signal"),
            "hist_slope": F.col("hist") - prior("hist"),
            "base_slope": F.col("base") - prior("base"),
            "bull_cross": flag((F.col("line") > F.col("signal")) & (prior("line") <= prior("signal"))),
            "bear_cross": flag((F.col("line") < F.col("signal")) & (prior("line") >= prior("signal"))),
            "extension": div(F.col("px") - F.col("base"), F.col("atr")),
            "swing_low": full(F.min("adj_low"), "adj_low", c.swing, frame(-c.swing, -1)),
            "swing_high": full(F.max("adj_high"), "adj_high", c.swing, frame(-c.swing, -1)),
        }
    )
    recent = lambda k: F.max(F.col(k).cast("int")).over(frame(-(c.cross_bars - 1))) == 1
    x = x.withColumns(
        {
            "recent_bull": recent("bull_cross"),
            "recent_bear": recent("bear_cross"),
            "signal_rising": _steady(F.col("signal_slope") > 0, c.slope_bars),
            "signal_falling": _steady(F.col("signal_slope") < 0, c.slope_bars),
            "hist_rising": _steady(F.col("hist_slope") > 0, c.histogram_bars),
            "hist_falling": _steady(F.col("hist_slope") < 0, c.histogram_bars),
            "swing_break": flag(F.col("px") < F.col("swing_low")),
        }
    )
    col = F.col
    strong = col("adx") >= c.adx_least
    buy = [
        (col("recent_bull"), 16),
        (col("line") > col("signal"), 10),
        (col("signal_rising"), 10),
        (col("hist") > 0, 8),
        (col("hist_rising"), 8),
        (col("px") > col("base"), 10),
        (col("base_slope") > 0, 8),
        *[((col("plain") > col("plain_signal")) & (col("plain_hist") >= 0), 10)] * c.use_plain,
        *[(strong & (col("plus_di") > col("minus_di")), 8)] * c.use_adx,
        *[(col("extension") <= c.most_extension, 4)] * c.no_chase,
    ]
    sell = [
        (col("recent_bear"), 16),
        (col("line") < col("signal"), 10),
        (col("signal_falling"), 10),
        (col("hist") < 0, 8),
        (col("hist_falling"), 10),
        (col("px") < col("base"), 10),
        (col("base_slope") < 0, 8),
        *[((col("plain") < col("plain_signal")) & (col("plain_hist") <= 0), 8)] * c.use_plain,
        *[(strong & (col("minus_di") > col("plus_di")), 6)] * c.use_adx,
        (col("swing_break"), 6),
    ]
    if kernel is not None:
        buy.append((flag(col("direction") > 0) & flag(col("px") > col("path")), 8))
        sell.append((flag(col("direction") < 0) | flag(col("px") < col("path")), 8))

    def score(parts: list) -> Column:
        total = F.lit(0.0)
        for condition, weight in parts:
            total = total + F.when(flag(condition), float(weight)).otherwise(0.0)
        return 100.0 * total / float(sum(w for _, w in parts))

    return x.withColumns({"buy_score": score(buy), "sell_score": score(sell)})


class Walk:
    """An open or closed position, moved bar by bar: orders of a bar fill at the next one's open."""

    def __init__(self, c: Cycle, state: list | None = None):
        self.c = c
        # left: the bar that asked for the last full sale; order: what the bar before asked for.
        self.cash, self.shares, self.entry, self.peak, self.i, self.left, self.reduced, self.order = state or [c.capital, 0.0, 0.0, 0.0, 0, None, False, None]

    def state(self) -> list:
        return [self.cash, self.shares, self.entry, self.peak, self.i, self.left, self.reduced, self.order]

    def step(self, adj_open, px, atr, swing_break, buy_score, sell_score, candidate, buy_ok, sell_ok) -> tuple:
        """The bar's values of MOVES; atr may be None or NaN."""
        c, order, i = self.c, self.order, self.i
        bought = sold = cut = 0
        executed = ""
        # The order of the bar before fills at this open.
        if order in ("SELL", "RISK EXIT"):
            self.cash, self.shares, sold, executed = self.cash + self.shares * adj_open, 0.0, 1, order
        elif order == "REDUCE":
            part = self.shares * c.reduce_fraction
            self.cash, self.shares, self.reduced, cut, executed = self.cash + part * adj_open, self.shares - part, True, 1, order
        elif order == "BUY":
            self.shares, self.cash, self.entry, bought, executed, self.reduced = self.cash / adj_open, 0.0, adj_open, 1, order, False
            self.peak = max(adj_open, px)
        rested = self.left is None or i - self.left >= c.cooldown
        if self.shares > 0:
            self.peak = max(self.peak, px)
            stop = swing_break or px <= self.entry * (1 - c.hard_stop) or (atr is not None and atr == atr and px <= self.peak - c.atr_times * atr)
            state = "RISK EXIT" if stop else "SELL" if sell_ok else "REDUCE" if sell_score >= c.reduce else "SELL WATCH" if sell_score >= c.watch else "HOLD"
            if state in ("RISK EXIT", "SELL"):
                self.left = i
        else:
            hopeful = buy_score >= max(45.0, c.buy - 15.0)
            state = "BUY" if buy_ok and rested else "BUY WATCH" if (candidate and not rested) or hopeful else "WAIT / CASH"
        asks = state in ("BUY", "SELL", "RISK EXIT") or (state == "REDUCE" and c.execute_reduce and not self.reduced)
        self.order = state if asks else None
        self.i = i + 1
        inside = (self.entry, self.peak) if self.shares > 0 else (None, None)
        return (self.shares, self.cash, bought, sold, state, executed, cut, *inside, rested)


#: What a step of Walk gives.
MOVES = "shares double, cash double, first_buy int, first_sell int, state string, executed string, reduced int, entry double, peak double, rested boolean"
_ASKED = ["adj_open", "px", "atr", "swing_break", "buy_score", "sell_score", "candidate", "buy_ok", "sell_ok"]


def lifecycle(x: DataFrame, c: Cycle = Cycle(), levels: dict[str, Column] | None = None) -> DataFrame:
    """indicator() with shares, cash, portfolio, first_buy, first_sell, reduced, state (of the bar) and its
    reason, executed, entry and peak of the open position, hard_stop and atr_stop.

    levels replaces buy, watch, reduce or sell of c by columns that are constant in a symbol.
    """
    levels = levels or {}
    own = list(levels)
    candidate = flag(F.col("buy_score") >= levels.get("buy", F.lit(c.buy)))
    if c.need_bull_cross:
        candidate = candidate & F.col("recent_bull")
    x = x.withColumn("candidate", candidate)
    weak = flag(F.col("sell_score") >= levels.get("sell", F.lit(c.sell)))
    weak = weak & F.col("recent_bear") if c.need_bear_cross else weak
    x = x.withColumns({"buy_ok": _steady(F.col("candidate"), c.buy_bars), "sell_ok": _steady(weak, c.sell_bars)})
    x = x.withColumns({f"own_{k}": v.cast("double") for k, v in levels.items()})
    moves = StructType.fromDDL(MOVES)
    arrow = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bar_ts")
        walk = Walk(replace(c, **{k: t.column(f"own_{k}")[0].as_py() for k in own}))
        steps = list(zip(*map(walk.step, *(t.column(k).to_pylist() for k in _ASKED))))
        for f, values in zip(moves.fields, steps):
            t = t.append_column(f.name, pa.array(values, arrow[f.dataType.simpleString()]))
        return t

    # All columns go through the map, so that nothing is joined back.
    out = x.groupBy("symbol").applyInArrow(run, StructType([*x.schema.fields, *moves.fields])).drop(*[f"own_{k}" for k in own])
    first = F.first("px").over(so_far())
    out = out.withColumns(
        {
            "portfolio": F.col("shares") * F.col("px") + F.col("cash"),
            "buy_hold": c.capital * F.col("px") / first,
            "hard_stop": F.col("entry") * (1 - c.hard_stop),
            "atr_stop": F.col("peak") - c.atr_times * F.col("atr"),
        }
    )
    return out.withColumn("reason", reason(c))


def breaches() -> Column:
    """Names of the stops that an open position has breached, joined."""
    held = F.col("shares") > 0
    return F.concat_ws(
        ", ",
        F.when(held & (F.col("px") <= F.col("hard_stop")), "hard stop"),
        F.when(held & (F.col("px") <= F.col("atr_stop")), "trailing stop"),
        F.when(held & F.col("swing_break"), "swing low"),
    )


def reason(c: Cycle) -> Column:
    """Why a bar of lifecycle() has its state."""
    state = F.col("state")
    buy, sell = (F.format_string("%.1f", k) for k in ("buy_score", "sell_score"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(state == "RISK EXIT", text("capital protection: ", breaches()))
        .when(state == "SELL", text("sell score ", sell, f" confirmed for {c.sell_bars} bars"))
        .when(state == "REDUCE", text("sell score ", sell, " in the reduce tier"))
        .when(state == "SELL WATCH", text("sell score ", sell, " in the watch tier"))
        .when(state == "HOLD", text("held, sell score ", sell))
        .when(state == "BUY", text("buy score ", buy, " confirmed"))
        .when((state == "BUY WATCH") & F.col("candidate") & ~F.col("rested"), text("candidate at ", buy, " waits for the cooldown"))
        .when(state == "BUY WATCH", text("buy score ", buy, " improves"))
        .otherwise(text("no entry, buy score ", buy))
    )


def trades(x: DataFrame) -> DataFrame:
    """Each purchase of lifecycle() with its sale: days, bars, return, what the best close gave back, kind of exit.

    An open position is marked to the last close.
    """
    inside = x.withColumn("trade", F.sum("first_buy").over(so_far())).where("trade > 0 and (shares > 0 or first_sell = 1)")
    sold = F.col("first_sell") == 1
    out = inside.groupBy("symbol", "trade").agg(
        F.min("bar_ts").alias("entry_ts"),
        F.min_by("adj_open", "bar_ts").alias("entry_price"),
        F.max(F.when(sold, F.col("bar_ts"))).alias("exit_ts"),
        F.max(F.when(sold, F.col("adj_open"))).alias("exit_price"),
        F.max(F.when(sold, F.col("executed"))).alias("exit_type"),
        (F.count("*") - 1).alias("bars"),
        F.max("px").alias("peak"),
        F.max("bar_ts").alias("last_ts"),
        F.max_by("px", "bar_ts").alias("last_price"),
    )
    end = F.coalesce("exit_price", "last_price")
    return out.select(
        *["symbol", "trade", "entry_ts", "entry_price", "exit_ts", "exit_price", "bars"],
        F.datediff("last_ts", "entry_ts").cast("long").alias("days"),
        (end / F.col("entry_price") - 1).alias("trade_return"),
        (end / F.col("peak") - 1).alias("giveback"),
        F.coalesce("exit_type", F.lit("OPEN")).alias("exit_type"),
        F.when(F.col("exit_ts").isNotNull(), "CLOSED").otherwise("OPEN / MARK-TO-MARKET").alias("status"),
    )


def open_trades(x: DataFrame) -> DataFrame:
    """For each symbol: entry and best close of the open position (null: none), and the bar that asked for the last sale."""
    x = x.withColumn("asked", prior("bar_ts"))
    return x.groupBy("symbol").agg(
        F.max_by("entry", "bar_ts").alias("entry_price"),
        F.max_by("peak", "bar_ts").alias("peak"),
        F.max(F.when(F.col("first_sell") == 1, F.col("asked"))).alias("last_exit_asked"),
    )


def snapshot(x: DataFrame) -> DataFrame:
    """Each symbol's last bar: what to do at the next open and why, scores, stops, and gates (gate, status, observed)."""
    c = F.col
    shown = lambda form, k: F.when(c(k).isNotNull(), F.format_string(form, k)).otherwise("warming up")
    turn = lambda up, down, other: F.when(flag(up), "BULLISH").when(flag(down), "BEARISH").otherwise(other)
    hit = F.when(breaches() != "", breaches())
    gates = [
        ("trigger", F.when(c("recent_bull"), "BULL CROSS").when(c("recent_bear"), "BEAR CROSS").otherwise("NO RECENT CROSS"), shown("%.4f", "line")),
        ("momentum", turn(c("signal_rising") & (c("hist") > 0), c("signal_falling") & (c("hist") < 0), "MIXED"), shown("%.4f", "hist")),
        ("trend", turn((c("px") > c("base")) & (c("base_slope") > 0), (c("px") < c("base")) & (c("base_slope") < 0), "MIXED"), shown("%.2f", "extension")),
        ("strength", turn(c("plus_di") > c("minus_di"), c("minus_di") > c("plus_di"), "NEUTRAL"), shown("%.1f", "adx")),
        ("protection", F.when(hit.isNotNull(), "RISK EXIT").otherwise("CLEAR"), F.coalesce(hit, F.lit("no breach"))),
        ("state", c("state"), F.when(c("shares") > 0, "LONG").otherwise("CASH")),
    ]
    if "direction" in x.columns:
        path = turn(c("direction") > 0, c("direction") < 0, "FLAT")
        gates.insert(4, ("path", path, shown("%.4f", "path")))
    else:
        gates.insert(4, ("path", F.lit("NOT ACTIVE"), F.lit("not supplied")))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(g).alias("gate"), a.alias("status"), b.alias("observed")) for i, (g, a, b) in enumerate(gates)])
    last = F.struct("bar_ts", "state", "reason", "shares", "buy_score", "sell_score", "hard_stop", "atr_stop", "swing_low", rows.alias("gates"))
    out = x.groupBy("symbol").agg(F.max_by(last, "bar_ts").alias("s"))
    return out.select(
        "symbol",
        "s.bar_ts",
        c("s.state").alias("decision"),
        F.when(c("s.shares") > 0, "LONG").otherwise("CASH").alias("position"),
        "s.reason",
        "s.buy_score",
        "s.sell_score",
        (c("s.buy_score") - c("s.sell_score")).alias("spread"),
        "s.hard_stop",
        "s.atr_stop",
        c("s.swing_low").alias("swing_stop"),
        "s.gates",
    )


def events(x: DataFrame) -> DataFrame:
    """Bars where the state changes to one that matters, or an order fills."""
    matters = F.col("state").isin("BUY", "SELL", "RISK EXIT", "REDUCE", "SELL WATCH", "BUY WATCH")
    changed = F.coalesce(F.col("state") != prior("state"), F.lit(True))
    x = x.withColumn("changed", changed)
    kept = ["symbol", "bar_ts", "state", "executed", "buy_score", "sell_score", "px", "line", "signal", "hist", "adx", "reason"]
    return x.where((matters & F.col("changed")) | (F.col("executed") != "")).select(*kept)


def exit_quality(x: DataFrame, ahead: int = 20) -> DataFrame:
    """For each sale: worst and best close of the next bars against the fill, what was avoided and foregone."""
    over = by_time().rowsBetween(1, ahead)
    y = x.withColumns({"low": F.min("px").over(over), "high": F.max("px").over(over), "bars": F.count("px").over(over)})
    y = y.where((F.col("first_sell") == 1) & (F.col("bars") > 0))
    worst, best = F.col("low") / F.col("adj_open") - 1, F.col("high") / F.col("adj_open") - 1
    avoided, foregone = F.greatest(F.lit(0.0), -worst), F.greatest(F.lit(0.0), best)
    return y.select(
        "symbol",
        "bar_ts",
        F.col("executed").alias("exit_type"),
        F.col("adj_open").alias("exit_price"),
        "bars",
        avoided.alias("avoided"),
        foregone.alias("foregone"),
        worst.alias("worst"),
        best.alias("best"),
        (avoided - foregone).alias("utility"),
        (foregone > avoided + 0.03).alias("false_exit"),
    )


def exit_summary(quality: DataFrame) -> DataFrame:
    """Means of exit_quality() by symbol."""
    return quality.groupBy("symbol").agg(
        F.count("*").alias("exits"),
        F.avg("avoided").alias("avoided"),
        F.avg("foregone").alias("foregone"),
        F.avg("utility").alias("utility"),
        F.avg(F.col("false_exit").cast("int")).alias("false_exits"),
    )
