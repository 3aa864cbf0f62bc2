"""Summaries, ledgers and regimes of a portfolio path (symbol, bar_ts, portfolio, buy_hold, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time, div, prior, so_far


def periodicity(bars: DataFrame) -> DataFrame:
    """symbol -> gap_s (median seconds between bars), seven_days, bars_day, per_year, label."""
    gaps = bars.select("symbol", "bar_ts", (F.unix_micros(F.col("bar_ts").cast("timestamp")) / 1e6).alias("s"))
    gaps = gaps.withColumn("gap", F.col("s") - F.lag("s").over(by_time()))
    by_day = gaps.groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.count("*").alias("n"))
    days = by_day.groupBy("symbol").agg(
        F.percentile(F.when(F.col("n") > 1, F.col("n")), 0.5).alias("typical"),
        F.count("*").alias("days"),
        F.avg(F.dayofweek("day").isin(1, 7).cast("int")).alias("weekend"),
    )
    whole = gaps.groupBy("symbol").agg(F.percentile("gap", 0.5).alias("gap_s"), F.count("*").alias("bars"))
    x = whole.join(days, "symbol")
    seven = (F.col("bars") >= 14) & (F.col("days") >= 10) & (F.col("weekend") >= 0.10)
    minutes = F.greatest(F.lit(1), F.bround(F.col("gap_s") / 60).cast("int"))
    fallback = F.bround(F.when(F.col("seven_days"), 1440.0).otherwise(390.0) / F.col("minutes"))
    x = x.withColumn("seven_days", seven).withColumn("minutes", minutes)
    x = x.withColumn("bars_day", F.greatest(F.lit(1), F.coalesce(F.bround("typical"), fallback).cast("int")))
    intraday, daily, weekly = (F.col("gap_s") < s for s in (18 * 3600, 3 * 86400 + 1, 10 * 86400 + 1))
    year = F.when(F.col("seven_days"), 365).otherwise(252)
    label = F.when(intraday, F.concat(F.lit("Intraday"), F.when(F.col("seven_days"), " 7D").otherwise(""), F.lit(" ("), F.col("minutes"), F.lit("m)")))
    label = label.when(daily, F.when(F.col("seven_days"), "Daily 7D").otherwise("Daily")).when(weekly, "Weekly").otherwise("Monthly")
    per_year = F.when(intraday, year * F.col("bars_day")).when(daily, year).when(weekly, 52).otherwise(12)
    return x.select("symbol", "gap_s", "seven_days", "bars_day", per_year.alias("per_year"), label.alias("label"))


def drawdown(value: str) -> Column:
    return F.col(value) / F.max(value).over(so_far()) - 1


def summary(path: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """symbol -> length, ends, growth a year, volatility, deepest drawdowns, trades, last signal."""
    gap = F.datediff("bar_ts", prior("bar_ts"))
    x = path.select(
        "*",
        (F.col("portfolio") / prior("portfolio") - 1).alias("r"),
        drawdown("portfolio").alias("dd"),
        drawdown("buy_hold").alias("dd_hold"),
        gap.alias("gap"),
    )
    out = x.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.min("bar_ts").alias("first"),
        F.max("bar_ts").alias("last"),
        F.max_by("portfolio", "bar_ts").alias("final"),
        F.max_by("buy_hold", "bar_ts").alias("hold"),
        F.stddev_samp("r").alias("sd"),
        F.min("dd").alias("max_drawdown"),
        F.min("dd_hold").alias("hold_drawdown"),
        F.sum("first_buy").cast("long").alias("buys"),
        F.sum("first_sell").cast("long").alias("sells"),
        F.max_by("signal", "bar_ts").alias("signal"),
        F.percentile("gap", 0.5).alias("gap"),
    )
    years = F.datediff("last", "first") / 365.25
    yearly = F.when(F.col("gap") <= 3, 252.0).when(F.col("gap") <= 10, 52.0).otherwise(12.0)
    growth = lambda end: F.when(years > 0, F.pow(F.col(end) / capital, 1 / years) - 1)
    return out.select(
        "symbol",
        "n",
        "first",
        "last",
        "final",
        "hold",
        growth("final").alias("growth"),
        growth("hold").alias("hold_growth"),
        (F.col("sd") * F.sqrt(yearly)).alias("volatility"),
        "max_drawdown",
        "hold_drawdown",
        "buys",
        "sells",
        F.when(F.col("signal") == "", "HOLD").otherwise(F.col("signal")).alias("last_signal"),
    )


def trades(path: DataFrame) -> DataFrame:
    """Each purchase with the sale that follows; the open one is marked to the last close."""
    number = F.sum("first_buy").over(so_far())
    x = path.withColumn("trade", number).where("trade > 0")
    out = x.groupBy("symbol", "trade").agg(
        F.min("bar_ts").alias("entry_ts"),
        F.min_by("adj_open", "bar_ts").alias("entry_price"),
        F.max(F.when(F.col("first_sell") == 1, F.col("bar_ts"))).alias("exit_ts"),
        F.max(F.when(F.col("first_sell") == 1, F.col("adj_open"))).alias("exit_price"),
        F.max("bar_ts").alias("last_ts"),
        F.max_by("px", "bar_ts").alias("last_price"),
    )
    closed = F.col("exit_ts").isNotNull()
    return out.select(
        "symbol",
        "trade",
        "entry_ts",
        "entry_price",
        "exit_ts",
        "exit_price",
        (F.coalesce("exit_price", "last_price") / F.col("entry_price") - 1).alias("trade_return"),
        F.datediff(F.when(closed, F.col("exit_ts")).otherwise(F.col("last_ts")), "entry_ts").alias("days"),
        F.when(closed, "CLOSED").otherwise("OPEN / MARK-TO-MARKET").alias("status"),
    )


def trade_statistics(ledger: DataFrame) -> DataFrame:
    closed = F.when(F.col("status") == "CLOSED", F.col("trade_return"))
    return ledger.groupBy("symbol").agg(
        F.count(closed).alias("closed"),
        F.avg((closed > 0).cast("int")).alias("win_rate"),
        F.avg(closed).alias("mean_return"),
        F.max(closed).alias("best"),
        F.min(closed).alias("worst"),
        F.avg(F.when(closed.isNotNull(), F.col("days"))).alias("mean_days"),
    )


def cash_regimes(path: DataFrame) -> DataFrame:
    """Each unbroken run of bars without shares."""
    is_cash = F.col("shares") <= 0
    starts = F.coalesce(is_cash != prior(is_cash), F.lit(True)).cast("int")
    x = path.withColumn("start", starts).withColumn("run", F.sum("start").over(so_far())).where(is_cash)
    out = x.groupBy("symbol", "run").agg(
        F.min("bar_ts").alias("start_ts"),
        F.max("bar_ts").alias("end_ts"),
        F.count("*").alias("bars"),
        F.min_by("px", "bar_ts").alias("from_price"),
        F.max_by("px", "bar_ts").alias("to_price"),
        F.min_by("portfolio", "bar_ts").alias("from_wealth"),
        F.max_by("portfolio", "bar_ts").alias("to_wealth"),
    )
    longest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bars"), "start_ts")) == 1
    return out.select(
        "symbol",
        "start_ts",
        "end_ts",
        F.datediff("end_ts", "start_ts").alias("days"),
        "bars",
        (div(F.col("to_price"), F.col("from_price")) - 1).alias("price_return"),
        "from_wealth",
        "to_wealth",
        longest.alias("longest"),
    )


def execution_events(path: DataFrame) -> DataFrame:
    """symbol -> the last purchase and the last sale (null: none), and how many there were."""
    bought, sold = F.col("first_buy") == 1, F.col("first_sell") == 1
    return path.groupBy("symbol").agg(
        F.max(F.when(bought, F.col("bar_ts"))).alias("last_buy"),
        F.max(F.when(sold, F.col("bar_ts"))).alias("last_sell"),
        F.count_if(bought).alias("buys"),
        F.count_if(sold).alias("sales"),
    )


def comparison(runs: dict[str, tuple[DataFrame, Column]], capital: float = 100_000.0) -> DataFrame:
    """Strategies side by side: symbol, strategy, final, growth a year, max_drawdown, trades.

    runs: by name a path (symbol, bar_ts, portfolio, ...) and what counts as one of its trades. The first path's
    buy_hold comes last, as a strategy without trades.
    """
    parts = [x.select("symbol", "bar_ts", F.col("portfolio").alias("value"), F.coalesce(trade, F.lit(False)).alias("trade"), F.lit(name).alias("strategy")) for name, (x, trade) in runs.items()]
    held = next(iter(runs.values()))[0]
    parts.append(held.select("symbol", "bar_ts", F.col("buy_hold").alias("value"), F.lit(False).alias("trade"), F.lit("buy and hold").alias("strategy")))
    x = parts[0]
    for part in parts[1:]:
        x = x.unionByName(part)
    until = Window.partitionBy("symbol", "strategy").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("fall", F.col("value") / F.max("value").over(until) - 1)
    out = x.groupBy("symbol", "strategy").agg(
        F.max_by("value", "bar_ts").alias("final"),
        F.datediff(F.max("bar_ts"), F.min("bar_ts")).alias("days"),
        F.min("fall").alias("max_drawdown"),
        F.count_if("trade").alias("trades"),
    )
    years = F.greatest(F.col("days") / 365.25, F.lit(1e-9))
    growth = F.when(F.col("final") > 0, F.pow(F.col("final") / capital, 1 / years) - 1)
    return out.select("symbol", "strategy", "final", growth.alias("growth"), "max_drawdown", "trades")
