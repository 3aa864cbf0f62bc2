"""Staged exposure: ordered rules on the bar before move a target between tiers.

A rule caps the target (reduces to a level), floors it (restores to a level) or leaves it. Such
caps and floors act on each tier by itself: a tier is off after a cap below it, on after a floor
at or above it. So the target at any bar is a sum, over tiers, of the last rule that touched the tier,
a window column each, and no bar waits for the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time, div, first_in_symbol, flag, frame, full, prior, so_far
from tidelane.operators.kernel import crosses_above, crosses_below


@dataclass(frozen=True)
class Tactical:
    weak: float = 1.5
    strong: float = 2.0
    extreme: float = 3.0
    volume_window: int = 20
    climax: float = 1.5
    trim: float = 0.75
    half: float = 0.50
    low: float = 0.25
    start: float = 1.0
    capital: float = 100_000.0
    cash_rate: float = 0.0
    #: Trade back to the target at every open, not only where it changes.
    every_bar: bool = False


#: Levels that the target moves between.
TIERS = (0.25, 0.50, 0.75, 1.0)


def features(x: DataFrame, relative: DataFrame, c: Tactical = Tactical()) -> DataFrame:
    """Indicator rows with drift z, band and path crosses, envelope z, slope change, relative volume."""
    x = x.join(relative.select("symbol", "bar_ts", "drift_z"), ["symbol", "bar_ts"], "left")
    before = frame(-c.volume_window, -1)
    return x.withColumns(
        {
            "reenter_below_upper": flag((F.col("src") <= F.col("upper")) & (prior("src") > prior("upper"))),
            "reenter_above_lower": flag((F.col("src") >= F.col("lower")) & (prior("src") < prior("lower"))),
            "cross_below_path": crosses_below("src", "trend"),
            "cross_above_path": crosses_above("src", "trend"),
            "envelope_z": div(F.col("src") - F.col("trend"), F.col("upper") - F.col("trend")),
            "relative_volume": div(F.col("volume"), full(F.percentile("volume", 0.5), "volume", c.volume_window, before)),
        }
    )


#: Rules in order: name, action ("hold", "reduce", "restore"), level as an attribute or a number.
RULES = [
    ("WARMUP", "hold", None),
    ("LOWER_BAND_BEAR_BREAK", "reduce", 0.0),
    ("EXTREME_RELATIVE_BREAKDOWN", "reduce", 0.0),
    ("PATH_LOSS_BEAR_REV_STRONG_WEAK", "reduce", 0.0),
    ("UPPER_REENTRY_BEAR_CONFIRM", "reduce", "low"),
    ("UPPER_REENTRY", "reduce", "half"),
    ("UPPER_CROSS_STRONG_OR_CLIMAX", "reduce", "half"),
    ("UPPER_CROSS", "reduce", "trim"),
    ("EXTREME_OUTPERF_DECEL", "reduce", "trim"),
    ("STRONG_RELATIVE_WEAKNESS", "reduce", "low"),
    ("WEAK_RELATIVE_PLUS_WEAK_STRUCTURE", "reduce", "half"),
    ("BEARISH_NW_REVERSAL", "reduce", "trim"),
    ("LOWER_REENTRY_BULL_RECOVERY", "restore", 0.50),
    ("BULL_REV_ABOVE_PATH", "restore", 0.75),
    ("FULL_BULLISH_RESTORE", "restore", 1.0),
    ("DEFAULT_HOLD", "hold", None),
]


def level(rule: tuple, c: Tactical) -> float | None:
    return getattr(c, rule[2]) if isinstance(rule[2], str) else rule[2]


def conditions(c: Tactical) -> dict[str, Column]:
    """Each rule's trigger on a row of features(), the last one apart."""
    z, col = F.col("drift_z"), F.col
    bear, bull = col("direction") < 0, col("direction") > 0
    climax = flag(col("relative_volume") >= c.climax)
    return {
        "WARMUP": col("trend").isNull() | z.isNull(),
        "LOWER_BAND_BEAR_BREAK": col("cross_below_lower") & bear,
        "EXTREME_RELATIVE_BREAKDOWN": z <= -c.extreme,
        "PATH_LOSS_BEAR_REV_STRONG_WEAK": col("below_path") & col("bear_reversal") & (z <= -c.strong),
        "UPPER_REENTRY_BEAR_CONFIRM": col("reenter_below_upper") & (bear | col("bear_reversal")) & (z >= c.weak),
        "UPPER_REENTRY": col("reenter_below_upper"),
        "UPPER_CROSS_STRONG_OR_CLIMAX": col("cross_above_upper") & ((z >= c.strong) | climax),
        "UPPER_CROSS": col("cross_above_upper"),
        "EXTREME_OUTPERF_DECEL": (z >= c.extreme) & flag(col("accel") < 0),
        "STRONG_RELATIVE_WEAKNESS": z <= -c.strong,
        "WEAK_RELATIVE_PLUS_WEAK_STRUCTURE": (z <= -c.weak) & (col("below_path") | bear),
        "BEARISH_NW_REVERSAL": col("bear_reversal"),
        "LOWER_REENTRY_BULL_RECOVERY": col("reenter_above_lower") & col("bull_reversal") & (z <= -c.weak),
        "BULL_REV_ABOVE_PATH": col("bull_reversal") & col("above_path") & (z > -c.weak),
        "FULL_BULLISH_RESTORE": col("above_path") & bull & (z >= 0),
    }


def decisions(x: DataFrame, c: Tactical = Tactical()) -> DataFrame:
    """features() with rule (that bar's first true one), the target and its change, and the action."""
    rule = F.coalesce(*[F.when(flag(when), F.lit(name)) for name, when in conditions(c).items()], F.lit("DEFAULT_HOLD"))
    x = x.withColumn("rule", rule)
    acted = prior("rule")
    caps = {r[0]: level(r, c) for r in RULES if r[1] == "reduce"}
    floors = {r[0]: level(r, c) for r in RULES if r[1] == "restore"}
    cap, floor = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, value in caps.items():
        cap = F.when(acted == name, value).otherwise(cap)
    for name, value in floors.items():
        floor = F.when(acted == name, value).otherwise(floor)
    x = x.withColumn("cap", cap).withColumn("floor", floor)
    target, below = F.lit(0.0), 0.0
    for tier in TIERS:
        touched = F.when(F.col("cap") < tier, 0).when(F.col("floor") >= tier, 1)
        on = F.coalesce(F.last(touched, ignorenulls=True).over(so_far()), F.lit(int(c.start >= tier)))
        target, below = target + on * (tier - below), tier
    x = x.withColumn("target", target)
    before = F.coalesce(prior("target"), F.lit(c.start))
    change = F.col("target") - before
    percent = lambda v: F.concat(F.round(100 * v).cast("int").cast("string"), F.lit("%"))
    action = (
        F.when(acted.isNull(), F.concat(F.lit("INITIALIZE "), percent(F.col("target")), F.lit(" EXPOSURE")))
        .when(F.col("cap").isNotNull() & (before <= 0), "WAIT / CASH")
        .when((change < 0) & (F.col("target") <= 0), "SELL / EXIT TO CASH — 0%")
        .when(change < 0, F.concat(F.lit("REDUCE TO "), percent(F.col("target"))))
        .when(change > 0, F.concat(F.lit("BUY / RESTORE TO "), percent(F.col("target"))))
        .when(F.col("cap").isNotNull() | F.col("floor").isNotNull(), F.concat(F.lit("HOLD "), percent(before)))
        .otherwise("HOLD")
    )
    return x.withColumns({"change": change, "action": action})


def execution(x: DataFrame, c: Tactical = Tactical()) -> DataFrame:
    """decisions() with shares, cash, portfolio, exposure, turnover, buy_hold, wealth_ratio.

    Trades only where the target changes (or at every bar, by every_bar), at the open; cash grows at the yearly rate, by days over
    365. Wealth from one trade to the next is a product of known factors, so it is a running sum of logarithms.
    """
    first = prior("px").isNull()
    trades = first | (F.col("change") != 0) | F.lit(c.every_bar)
    days = (F.unix_micros(F.col("bar_ts").cast("timestamp")) - F.first(F.unix_micros(F.col("bar_ts").cast("timestamp"))).over(so_far())) / 86_400e6
    # The growth of cash from the first bar on.
    x = x.withColumns({"trades": trades, "growth": F.pow(F.lit(1 + c.cash_rate), days / 365)})
    fill = F.when(first, F.col("px")).otherwise(F.col("adj_open"))
    x = x.withColumn("_last", F.last(F.when(F.col("trades"), F.struct(fill.alias("price"), "growth", "target")), ignorenulls=True).over(so_far()))
    held = prior("_last")
    factor = held["target"] * F.col("adj_open") / held["price"] + (1 - held["target"]) * F.col("growth") / held["growth"]
    x = x.withColumn("_log", F.when(F.col("trades") & ~first, F.ln(factor)).otherwise(0.0))
    wealth = c.capital * F.exp(F.sum("_log").over(so_far()))
    now = F.col("_last")
    x = x.withColumns(
        {
            "shares": wealth * now["target"] / now["price"],
            "cash": wealth * (1 - now["target"]) * F.col("growth") / now["growth"],
            "buy_hold": c.capital * F.col("px") / first_in_symbol("px"),
        }
    )
    x = x.withColumn("portfolio", F.col("shares") * F.col("px") + F.col("cash"))
    moved = F.when(first | ~F.col("trades"), 0.0).otherwise(F.abs(F.col("shares") - prior("shares")) * F.col("adj_open"))
    equity = F.col("shares") * F.col("adj_open") + F.col("cash")
    return x.withColumns(
        {
            "exposure": F.coalesce(div(F.col("shares") * F.col("px"), F.col("portfolio")), F.lit(0.0)),
            "traded": moved,
            "turnover": F.coalesce(div(moved, equity), F.lit(0.0)),
            "wealth_ratio": div(F.col("portfolio"), F.col("buy_hold")),
        }
    ).drop("_last", "_log", "growth", "trades")


def rule_table(x: DataFrame, c: Tactical = Tactical()) -> DataFrame:
    """Each symbol's last bar: every rule in order, whether it is true, and which one counts."""
    known = conditions(c)
    rules = F.array(
        *[
            F.struct(F.lit(i + 1).alias("place"), F.lit(name).alias("rule_id"), flag(known[name]).alias("holds") if name in known else F.lit(False).alias("holds"))
            for i, (name, *_) in enumerate(RULES)
        ]
    )
    last = x.withColumn("rules", rules).groupBy("symbol").agg(F.max_by(F.struct("bar_ts", "rule", "target", "rules"), "bar_ts").alias("s"))
    y = last.select("symbol", "s.bar_ts", "s.rule", "s.target", F.inline("s.rules"))
    chosen = F.col("rule_id") == F.col("rule")
    # In the warm-up no other rule is looked at; the default holds where no other does.
    holds = F.when(F.col("rule") == "WARMUP", chosen).otherwise(F.col("holds") | (chosen & (F.col("rule_id") == "DEFAULT_HOLD")))
    return y.select("symbol", "bar_ts", "place", "rule_id", holds.alias("holds"), chosen.alias("selected"), "target")


def action_ledger(x: DataFrame) -> DataFrame:
    """Bars where the target changes, latest first within a symbol."""
    n = F.row_number().over(by_time())
    return x.withColumn("n", n).where("n > 1 and change <> 0").select("symbol", "bar_ts", "rule", "action", "target", "change", "adj_open")


def rulebook(spark, c: Tactical = Tactical()) -> DataFrame:
    """The rules in order, what each does and to which level."""
    rows = [(i + 1, r[0], r[1], level(r, c)) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "place int, rule_id string, does string, level double")
