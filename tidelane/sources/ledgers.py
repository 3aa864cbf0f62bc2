"""CSV: golden tables in, ledgers out. Names of the columns are parameters; a sink writes those that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the staged-exposure ledger and of the intraday one, in order.
TACTICAL = [
    *["symbol", "bar_ts", "adj_open", "adj_high", "adj_low", "px", "volume", "src", "trend", "upper", "lower", "slope", "norm_slope", "accel", "direction"],
    *["bull_reversal", "bear_reversal", "cross_above_upper", "cross_below_lower", "reenter_below_upper", "reenter_above_lower", "envelope_z", "drift_z"],
    *["relative_volume", "rule", "action", "target", "change", "exposure", "shares", "cash", "traded", "turnover", "portfolio", "buy_hold", "wealth_ratio"],
]
INTRADAY = [
    *["symbol", "bar_ts", "session_date", "in_session", "session_bar", "adj_open", "adj_high", "adj_low", "px", "volume", "vwap", "vwap_gap", "vwap_gap_atr"],
    *["or_high", "or_low", "or_width", "or_final", "or_position", "or_up", "or_down", "vwap_up", "vwap_down", "slot_volume", "slot_ratio", "climax"],
    *["atr", "real_vol", "session_gap", "session_ret", "session_drawdown", "direction", "drift_z", "score", "state", "parts"],
]
_TIME = "yyyy-MM-dd'T'HH:mm:ss"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, by its schema; times as timestamp_ntz in ISO form. A bad cell is null."""
    return spark.read.schema(schema).option("timestampNTZFormat", _TIME).csv(path, header=True, enforceSchema=False, mode="PERMISSIVE")


def rows(x: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that x has, in the given order; doubles with all digits."""
    return x.select(*[c for c in columns if c in x.columns])


def write(x: DataFrame, path: str, columns: list[str]) -> None:
    """Those rows as CSV files with a header; a symbol's rows are together and in order of time."""
    out = rows(x, columns).repartition("symbol").sortWithinPartitions("symbol", "bar_ts")
    out.write.option("timestampNTZFormat", _TIME).csv(path, header=True, emptyValue="")


def newest(x: DataFrame, most: int) -> DataFrame:
    """The newest rows for a report, latest first."""
    return x.orderBy(F.desc("bar_ts"), "symbol").limit(most)
