"""Dimension tables: instruments by market and group, benchmarks by symbol, horizons by bar length.

The tables are parameters: any nested mapping market -> group -> [(name, ticker)] will do. DEMO is a
small one for tests and examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEMO = {
    "Equity": {"Index": [("Broad 500", "^B500"), ("Tech 100", "^T100")], "Single": [("Acme", "ACME"), ("Globex", "GLBX")]},
    "Commodity": {"Metal": [("Gold", "GC=F"), ("Copper", "HG=F")], "Energy": [("Crude", "CL=F")]},
    "Crypto": {"Coin": [("Bitcoin", "BTC-USD"), ("Ether", "ETH-USD")]},
}

#: Bars of a horizon, by bar length; fixed values.
HORIZONS = {
    "15m": {"32B": 32, "64B": 64, "128B": 128, "256B": 256},
    "1d": {"3M": 63, "6M": 126, "12M": 252, "24M": 504, "36M": 756},
    "1wk": {"3M": 13, "6M": 26, "12M": 52, "24M": 104, "36M": 156},
    "1mo": {"3M": 3, "6M": 6, "12M": 12, "24M": 24, "36M": 36},
}


def horizons(spark: SparkSession) -> DataFrame:
    """grain, horizon, bars."""
    return spark.createDataFrame([(g, h, n) for g, by in HORIZONS.items() for h, n in by.items()], "grain string, horizon string, bars int")


def instruments(spark: SparkSession, universe: dict = DEMO) -> DataFrame:
    """market, group, instrument, ticker."""
    rows = [(m, g, n, t) for m, groups in universe.items() for g, items in groups.items() for n, t in items]
    return spark.createDataFrame(rows, "market string, group string, instrument string, ticker string")


def markets(table: DataFrame) -> DataFrame:
    return table.select("market").distinct()


def groups(table: DataFrame, market: str) -> DataFrame:
    return table.where(F.col("market") == market).select("group").distinct()


def chosen(table: DataFrame, in_markets: list[str] | None = None, in_groups: list[str] | None = None) -> DataFrame:
    """Instruments of these markets and groups; None takes all."""
    if in_markets is not None:
        table = table.where(F.col("market").isin(in_markets))
    return table if in_groups is None else table.where(F.col("group").isin(in_groups))


def named(symbols: DataFrame, table: DataFrame) -> DataFrame:
    """symbols (symbol, ...) with the instrument's name, or the symbol itself where it has none."""
    names = table.select(F.col("ticker").alias("symbol"), "instrument")
    return symbols.join(names, "symbol", "left").withColumn("name", F.coalesce("instrument", "symbol")).drop("instrument")


def horizon_bars(grain: str, horizon: str) -> int:
    try:
        return HORIZONS[grain][horizon]
    except KeyError:
        raise ValueError(f"no horizon {horizon!r} for bars of {grain!r}") from None


def entry_bars(mode: str, grain: str, horizon: str = "12M", custom: int | None = None) -> int:
    """Length of the entry window: by horizon ("frequency"), 2000 bars ("legacy"), or custom (2 or more)."""
    if mode == "frequency":
        return horizon_bars(grain, horizon)
    if mode == "legacy":
        return 2000
    if mode == "custom" and custom is not None and custom >= 2:
        return custom
    raise ValueError("mode must be frequency, legacy, or custom with at least 2 bars")
