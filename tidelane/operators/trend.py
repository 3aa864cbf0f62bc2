"""Trend-following with volatility stops, entirely in window columns.

Signals read the bar before and fill at the current adjusted open. The position is the last
signal's; since it is all in or all out, wealth is the capital times the product of sale over
purchase prices so far, a running sum of logarithms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time, first_in_symbol, flag, frame, prior, so_far
from tidelane.sources.bars import adjusted


@dataclass(frozen=True)
class Trend:
    capital: float = 100_000.0
    atr_bars: int = 8
    atr_times: float = 10.0
    band_bars: int = 40
    band_width: float = 2.5
    entry_bars: int = 52
    stop: str = "trailing"

    def __post_init__(self):
        if min(self.capital, self.atr_bars, self.atr_times, self.entry_bars) <= 0 or self.band_bars < 2:
            raise ValueError("lengths, multiples and capital must be positive")
        if self.stop not in ("atr", "band", "trailing"):
            raise ValueError(f"no stop named {self.stop!r}")


def signals(bars: DataFrame, c: Trend = Trend()) -> DataFrame:
    """bars with adjusted prices, return, range, stops, entry level and signal (buy, sell or empty)."""
    x = adjusted(bars).withColumn("i", F.row_number().over(by_time()) - 1)
    old = prior("px")
    x = x.withColumns(
        {
            "ret": F.when(F.col("i") == 0, F.col("close") / F.col("open") - 1).otherwise(F.col("px") / old - 1),
            "true_range": F.when(
                F.col("i") > 0,
                F.greatest(
                    F.col("adj_high") - F.col("adj_low"), F.abs(F.col("adj_high") - old), F.abs(F.col("adj_low") - old)
                ),
            ),
        }
    )
    later = lambda value: F.when(F.col("i") > 0, value)
    band = frame(-c.band_bars)
    x = x.withColumns(
        {
            "atr_stop": later(c.atr_times * F.avg("true_range").over(frame(-c.atr_bars))),
            "max_price": F.max("px").over(frame(-c.entry_bars)),
            "band_sd": later(F.stddev_pop("px").over(band)),
            "lower_band": later(F.avg("px").over(band) - c.band_width * F.stddev_pop("px").over(band)),
        }
    )
    x = x.withColumn("buys", flag(prior("px") >= prior("max_price")))
    # The trailing stop starts with the first level and rises on buying bars only.
    x = x.withColumn("trail", F.max(F.when((F.col("i") == 1) | F.col("buys"), F.col("atr_stop"))).over(so_far()))
    stop = {"atr": "atr_stop", "band": "lower_band", "trailing": "trail"}[c.stop]
    sells = ~F.col("buys") & flag(prior("px") <= prior(stop))
    return x.withColumn("signal", F.when(F.col("buys"), "BUY").when(sells, "SELL").otherwise(""))


def all_in_all_out(x: DataFrame, capital: float) -> DataFrame:
    """x (signal, adj_open, px) with first_buy, first_sell, shares, cash, portfolio, buy_hold, exposure."""
    held = F.last(F.when(F.col("signal") == "BUY", 1).when(F.col("signal") == "SELL", 0), ignorenulls=True)
    x = x.withColumn("held", F.coalesce(held.over(so_far()), F.lit(0)))
    was = F.coalesce(prior("held"), F.lit(0))
    x = x.withColumns(
        {
            "first_buy": ((F.col("held") == 1) & (was == 0)).cast("int"),
            "first_sell": ((F.col("held") == 0) & (was == 1)).cast("int"),
        }
    )
    price = F.ln("adj_open")
    gain = F.when(F.col("first_sell") == 1, price).when(F.col("first_buy") == 1, -price).otherwise(0.0)
    wealth = capital * F.exp(F.sum(gain).over(so_far()))
    x = x.withColumns(
        {
            "shares": F.when(F.col("held") == 1, wealth).otherwise(0.0),
            "cash": F.when(F.col("held") == 0, wealth).otherwise(0.0),
            "buy_hold": capital * F.col("px") / first_in_symbol("px"),
        }
    )
    return x.withColumn("portfolio", F.col("shares") * F.col("px") + F.col("cash"))


def run(bars: DataFrame, c: Trend = Trend()) -> DataFrame:
    return all_in_all_out(signals(bars, c), c.capital)


def snapshot(x: DataFrame, c: Trend = Trend()) -> DataFrame:
    """Each symbol's last bar: what to do at the next open, the last trades, and the gates (name, value, passed).

    The signal of the next bar is known: it reads the last one.
    """
    stop = {"atr": "atr_stop", "band": "lower_band", "trailing": "trail"}[c.stop]
    s = F.struct("bar_ts", "px", "max_price", F.col(stop).alias("stop"), "held")
    out = x.groupBy("symbol").agg(
        F.max_by(s, "bar_ts").alias("s"),
        F.max(F.when(F.col("first_buy") == 1, F.col("bar_ts"))).alias("last_buy"),
        F.max(F.when(F.col("first_sell") == 1, F.col("bar_ts"))).alias("last_sell"),
        F.count("*").alias("bars"),
    )
    entry, leave = F.col("s.px") >= F.col("s.max_price"), flag(F.col("s.px") <= F.col("s.stop"))
    held = F.col("s.held") == 1
    action = F.when(entry & ~held, "BUY").when(leave & ~entry & held, "SELL").when(held, "HOLD").otherwise("WAIT")
    return out.select(
        "symbol",
        "s.bar_ts",
        action.alias("action"),
        "last_buy",
        "last_sell",
        (F.col("bars") > c.entry_bars).alias("full_entry_window"),
        (F.col("s.px") / F.col("s.max_price") - 1).alias("entry_gap"),
        (F.col("s.px") / F.col("s.stop") - 1).alias("stop_gap"),
    )
