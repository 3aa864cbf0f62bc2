"""Causal kernel regression of prices, its bands, alerts and the strategy on it.

A bar's estimate is a weighted mean of its own and the earlier prices, weights falling with the
distance in bars. One array of the window's prices serves both the estimate and the mean weighted
distance from it (the residual), so each bar passes its window twice and needs no self-join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time, div, flag, frame, prior, sign
from tidelane.operators.trend import all_in_all_out
from tidelane.sources.bars import adjusted


@dataclass(frozen=True)
class Kernel:
    lookback: int = 60
    bandwidth: float = 8.0
    kernel: str = "gaussian"
    relative_weight: float = 1.0
    band: float = 1.5
    source: str = "close"
    full_lookback: bool = True

    def __post_init__(self):
        if self.lookback < 1 or self.bandwidth <= 0 or self.relative_weight <= 0 or self.band <= 0:
            raise ValueError("lookback, bandwidth, weight and band must be positive")

    def weight(self, lag: int) -> float:
        u = lag / self.bandwidth
        if self.kernel == "gaussian":
            return math.exp(-u * u / 2)
        if self.kernel == "rational_quadratic":
            return (1 + u * u / (2 * self.relative_weight)) ** -self.relative_weight
        compact = {
            "epanechnikov": 0.75 * (1 - u * u),
            "triangular": 1 - u,
            "quartic": 15 / 16 * (1 - u * u) ** 2,
            "cosine": math.pi / 4 * math.cos(math.pi * u / 2),
        }
        return compact[self.kernel] if u <= 1 else 0.0

    def weights(self) -> list[float]:
        """By lag, from 0 to lookback."""
        return [self.weight(k) for k in range(self.lookback + 1)]


@dataclass(frozen=True)
class Rules:
    mode: str = "confirmed"
    enter_after: int = 2
    leave_after: int = 1
    avoid_chase: bool = True
    capital: float = 100_000.0


def profile(spark: SparkSession, c: Kernel) -> DataFrame:
    """lag, weight and its share of all."""
    w = c.weights()
    return spark.createDataFrame([(k, v, v / sum(w)) for k, v in enumerate(w)], "lag int, weight double, share double")


def source(c: Kernel) -> Column:
    return {
        "close": F.col("px"),
        "hlc3": (F.col("adj_high") + F.col("adj_low") + F.col("px")) / 3,
        "ohlc4": (F.col("adj_open") + F.col("adj_high") + F.col("adj_low") + F.col("px")) / 4,
    }[c.source]


def crosses_above(a: str, b: str) -> Column:
    return flag((F.col(a) > F.col(b)) & (prior(a) <= prior(b)))


def crosses_below(a: str, b: str) -> Column:
    return flag((F.col(a) < F.col(b)) & (prior(a) >= prior(b)))


def indicator(bars: DataFrame, c: Kernel = Kernel()) -> DataFrame:
    """Adjusted bars with estimate, residual, bands, slope, direction, reversals, crosses and warnings."""
    w = c.weights()
    oldest_first = F.array(*[F.lit(v) for v in reversed(w)])
    x = adjusted(bars).withColumn("src", source(c))
    x = x.withColumn("_seen", F.collect_list("src").over(frame(-c.lookback)))
    n = F.size("_seen")
    weights = oldest_first if c.full_lookback else F.slice(oldest_first, F.lit(len(w) + 1) - n, n)
    x = x.withColumn("_w", weights)
    dot = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    total = F.lit(sum(w)) if c.full_lookback else dot("_w")
    ready = (n == len(w)) if c.full_lookback else F.lit(True)
    x = x.withColumn("trend", F.when(ready, dot(F.zip_with("_seen", "_w", lambda v, k: v * k)) / total))
    off = F.zip_with("_seen", "_w", lambda v, k: F.abs(v - F.col("trend")) * k)
    x = x.withColumn("residual", F.when(ready, dot(off) / total)).drop("_seen", "_w")
    x = x.withColumns(
        {
            "upper": F.col("trend") + F.col("residual") * c.band,
            "lower": F.col("trend") - F.col("residual") * c.band,
            "slope": F.col("trend") - prior("trend"),
        }
    )
    x = x.withColumns(
        {
            "direction": sign(F.col("slope")).cast("int"),
            "norm_slope": div(F.col("slope"), prior("trend")),
        }
    )
    x = x.withColumn("accel", F.col("norm_slope") - prior("norm_slope"))
    up, down = F.col("direction") > 0, F.col("direction") < 0
    gap = F.greatest(F.coalesce("residual", F.lit(0.0)) * 0.35, F.abs(F.coalesce("trend", F.lit(0.0))) * 0.002)
    return x.withColumns(
        {
            "bull_reversal": flag(up & (prior("direction") <= 0)),
            "bear_reversal": flag(down & (prior("direction") >= 0)),
            "cross_above_upper": crosses_above("src", "upper"),
            "cross_below_lower": crosses_below("src", "lower"),
            "momentum_up": flag((F.col("accel") > 0) & (prior("accel") <= 0) & ~up),
            "momentum_down": flag((F.col("accel") < 0) & (prior("accel") >= 0) & ~down),
            "bull_marker": F.col("trend") - gap,
            "bear_marker": F.col("trend") + gap,
            "up_marker": F.col("trend") - gap * 1.8,
            "down_marker": F.col("trend") + gap * 1.8,
            "price_gap": div(F.col("src"), F.col("trend")) - 1,
            "band_width": div(F.col("upper") - F.col("lower"), F.col("trend")),
            "above_path": flag(F.col("src") > F.col("trend")),
            "below_path": flag(F.col("src") < F.col("trend")),
        }
    )


def lasts(column: str, value: int, n: int) -> Column:
    """The last n values are all this one."""
    over = frame(-(n - 1))
    return flag((F.min((F.col(column) == value).cast("int")).over(over) == 1) & (F.count(column).over(over) == n))


def strategy(x: DataFrame, c: Rules = Rules()) -> DataFrame:
    """indicator() with the long-or-cash portfolio that fills at the open after a condition."""
    known = F.col("trend").isNotNull() & prior("px").isNotNull()
    if c.mode == "reversal":
        enter, leave = F.col("bull_reversal"), F.col("bear_reversal")
    else:
        enter, leave = lasts("direction", 1, c.enter_after), lasts("direction", -1, c.leave_after)
    calm = F.col("src") <= F.col("upper") if c.avoid_chase else F.lit(True)
    x = x.withColumns(
        {
            "enter": flag(known & enter & F.col("above_path") & calm),
            "leave": flag(known & (leave | F.col("below_path"))),
        }
    )
    # No bar meets both conditions, so the last one that was met is the position.
    was_in, was_out = flag(prior("enter")), flag(prior("leave"))
    return all_in_all_out(x.withColumn("signal", F.when(was_in, "BUY").when(was_out, "SELL").otherwise("")), c.capital)


ALERTS = {
    "bull_reversal": "BULLISH REVERSAL",
    "bear_reversal": "BEARISH REVERSAL",
    "cross_above_upper": "CROSS ABOVE UPPER BAND",
    "cross_below_lower": "CROSS BELOW LOWER BAND",
    "momentum_up": "MOMENTUM UPWARD WARNING",
    "momentum_down": "MOMENTUM DOWNWARD WARNING",
    "bull_reversal OR bear_reversal": "ANY REVERSAL",
}


def alerts(x: DataFrame) -> DataFrame:
    """A row for each flag that is set: symbol, bar_ts, alert, price, trend."""
    raised = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for c, name in ALERTS.items()]))
    return x.select("symbol", "bar_ts", F.explode(raised).alias("alert"), F.col("src").alias("price"), "trend")


#: What each alert says of the path: whether it is one of the indicator's own or an early warning, and its state.
#: The states are fixed values.
ALERT_STATES = {
    "BULLISH REVERSAL": ("INDICATOR", "BULLISH"),
    "BEARISH REVERSAL": ("INDICATOR", "BEARISH"),
    "ANY REVERSAL": ("INDICATOR", "REVERSAL"),
    "CROSS ABOVE UPPER BAND": ("INDICATOR", "OVEREXTENSION"),
    "CROSS BELOW LOWER BAND": ("INDICATOR", "BREAKDOWN"),
    "MOMENTUM UPWARD WARNING": ("WARNING", "EARLY BULLISH MOMENTUM"),
    "MOMENTUM DOWNWARD WARNING": ("WARNING", "EARLY BEARISH MOMENTUM"),
}


def alert_tape(x: DataFrame) -> DataFrame:
    """Each symbol's alerts in order of time, origin and name (place from 1), with the bar's values."""
    raised = F.array_compact(
        F.array(*[F.when(F.expr(c), F.struct(F.lit(name).alias("alert"), *[F.lit(v).alias(k) for k, v in zip(("origin", "state"), ALERT_STATES[name])])) for c, name in ALERTS.items()])
    )
    values = [F.col("src").alias("price"), "trend", "upper", "lower", "norm_slope", "accel"]
    out = x.select("symbol", "bar_ts", *values, F.inline(raised))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts", "origin", "alert")))


def snapshot(x: DataFrame) -> DataFrame:
    """Each symbol's last bar: state, next action and its gates (name, passed)."""
    last = x.groupBy("symbol").agg(F.max_by(F.struct("bar_ts", "src", "trend", "upper", "direction", "held", "enter", "leave", "above_path"), "bar_ts").alias("s"))
    s = F.col("s")
    invested = s["held"] == 1
    action = (
        F.when(s["trend"].isNull(), "DATA STOP").when(invested & s["leave"], "SELL").when(invested, "HOLD").when(s["enter"], "BUY").otherwise("WAIT")
    )
    gates = F.array(
        F.struct(F.lit("path available").alias("gate"), s["trend"].isNotNull().alias("passed")),
        F.struct(F.lit("direction up").alias("gate"), (s["direction"] > 0).alias("passed")),
        F.struct(F.lit("above path").alias("gate"), s["above_path"].alias("passed")),
        F.struct(F.lit("below upper band").alias("gate"), flag(s["src"] <= s["upper"]).alias("passed")),
    )
    return last.select("symbol", s["bar_ts"].alias("bar_ts"), action.alias("action"), gates.alias("gates"))


def gate_matrix(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("symbol", "bar_ts", "action", F.inline("gates"))


def paths(x: DataFrame) -> DataFrame:
    """The estimate split by direction for display: a piece between two bars takes the later bar's direction."""
    ahead = F.lead("direction").over(by_time())
    part = lambda test: F.when(test(F.col("direction")) | flag(test(ahead)), F.col("trend"))
    return x.select(
        "symbol",
        "bar_ts",
        part(lambda d: d > 0).alias("rising"),
        part(lambda d: d < 0).alias("falling"),
        part(lambda d: d == 0).alias("flat"),
    )
