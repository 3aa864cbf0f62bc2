"""Bars from nested JSON payloads: parallel arrays of times and prices, one document a symbol.

Arrays of different lengths make the row a failure, kept apart from the bars with its reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTE = "open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>"
SCHEMA = f"struct<zone: string, timestamp: array<bigint>, quote: array<struct<{_QUOTE}>>, adjclose: array<struct<adjclose: array<double>>>>"
_ARRAYS = ["open", "high", "low", "close", "volume"]


def parsed(payloads: DataFrame) -> DataFrame:
    """payloads (symbol, body) -> symbol, p (the parts), failure (null if sound)."""
    x = payloads.select("symbol", F.from_json("body", SCHEMA).alias("p"))
    n = F.size("p.timestamp")
    short = F.lit(False)
    for k in _ARRAYS:
        short = short | (F.size(F.col("p.quote")[0][k]) != n)
    short = short | (F.size(F.col("p.adjclose")[0]["adjclose"]) != n)
    failure = F.when(F.col("p").isNull() | F.col("p.timestamp").isNull(), "UNREADABLE").when(short, "LENGTH MISMATCH")
    return x.withColumn("failure", failure)


def bars(payloads: DataFrame, daily: bool = True) -> DataFrame:
    """Bars of the sound payloads, in the exchange's local time; daily bars at midnight."""
    q = F.col("p.quote")[0]
    zipped = F.arrays_zip(F.col("p.timestamp").alias("t"), *[q[k].alias(k) for k in _ARRAYS], F.col("p.adjclose")[0]["adjclose"].alias("adj_close"))
    x = parsed(payloads).where("failure is null").select("symbol", F.col("p.zone").alias("zone"), F.explode(zipped).alias("b"))
    local = F.from_utc_timestamp(F.timestamp_seconds(F.col("b.t")), F.coalesce("zone", F.lit("UTC"))).cast("timestamp_ntz")
    at = F.date_trunc("day", local).cast("timestamp_ntz") if daily else local
    return x.select("symbol", at.alias("bar_ts"), "b.open", "b.high", "b.low", "b.close", "b.adj_close", "b.volume")


def failures(payloads: DataFrame) -> DataFrame:
    return parsed(payloads).where("failure is not null").select("symbol", "failure")
