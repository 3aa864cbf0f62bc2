"""Gates of the last bar: for each symbol what each condition of a strategy says, as rows
(symbol, bar_ts, place, gate, status, value). One aggregation picks a symbol's last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.windows import div, flag
from tidelane.operators.tactical import RULES, Tactical, conditions, level
from tidelane.operators.trend import Trend

Gate = tuple[str, Column, Column]


def _none() -> Column:
    return F.lit(None).cast("double")


def table(x: DataFrame, gates: list[Gate]) -> DataFrame:
    """gates (name, status, value) of each symbol's last row of x."""
    rows = [
        F.struct(F.lit(i + 1).alias("place"), F.lit(name).alias("gate"), status.alias("status"), value.cast("double").alias("value"))
        for i, (name, status, value) in enumerate(gates)
    ]
    last = x.groupBy("symbol").agg(F.max_by(F.struct("bar_ts", F.array(*rows).alias("gates")), "bar_ts").alias("s"))
    return last.select("symbol", "s.bar_ts", F.inline("s.gates"))


def _set(condition: Column, yes: str = "TRIGGERED", no: str = "NOT TRIGGERED") -> Column:
    return F.when(flag(condition), yes).otherwise(no)


def _direction() -> Column:
    return F.when(F.col("direction") > 0, "BULLISH").when(F.col("direction") < 0, "BEARISH").otherwise("FLAT")


def trend_gates(x: DataFrame, c: Trend = Trend()) -> DataFrame:
    """Of trend.run(): what the next open will do."""
    stop = F.col({"atr": "atr_stop", "band": "lower_band", "trailing": "trail"}[c.stop])
    px, held = F.col("px"), F.col("held") == 1
    entry, leave = flag(px >= F.col("max_price")), flag(px <= stop)
    action = F.when(entry & ~held, "BUY").when(leave & ~entry & held, "SELL").when(held, "HOLD").otherwise("WAIT / CASH")
    return table(
        x,
        [
            ("breakout", _set(entry), div(px, F.col("max_price")) - 1),
            ("stop", _set(leave), div(px, stop) - 1),
            ("position", F.when(held, "INVESTED").otherwise("CASH"), F.col("held")),
            ("execution", action, _none()),
        ],
    )


def kernel_gates(x: DataFrame) -> DataFrame:
    """Of kernel.strategy()."""
    src, trend, held = F.col("src"), F.col("trend"), F.col("held") == 1
    return table(
        x,
        [
            ("slope", _direction(), F.col("slope")),
            ("path", F.when(flag(src > trend), "ABOVE").otherwise("BELOW / EQUAL"), div(src, trend) - 1),
            ("bullish reversal", _set(F.col("bull_reversal")), _none()),
            ("bearish reversal", _set(F.col("bear_reversal")), _none()),
            ("upper band", _set(F.col("cross_above_upper")), _none()),
            ("lower band", _set(F.col("cross_below_lower")), _none()),
            ("upward warning", _set(F.col("momentum_up")), F.col("accel")),
            ("downward warning", _set(F.col("momentum_down")), F.col("accel")),
            ("extension", F.when(flag(src > F.col("upper")), "ABOVE UPPER").when(flag(src < F.col("lower")), "BELOW LOWER").otherwise("INSIDE BAND"), div(src - trend, F.col("upper") - trend)),
            ("position", F.when(held, "LONG").otherwise("CASH"), F.col("held")),
        ],
    )


def tactical_gates(x: DataFrame, c: Tactical = Tactical()) -> DataFrame:
    """Of tactical.execution()."""
    z, percent = F.col("drift_z"), lambda v: F.concat(F.round(100 * v).cast("int").cast("string"), F.lit("%"))
    drift = (
        F.when(z <= -c.extreme, "EXTREME WEAK")
        .when(z <= -c.strong, "STRONG WEAK")
        .when(z <= -c.weak, "WEAK")
        .when(z >= c.extreme, "EXTREME OUTPERFORMANCE")
        .when(z >= c.strong, "STRONG OUTPERFORMANCE")
        .otherwise("NORMAL")
    )
    return table(
        x,
        [
            ("upper band cross", _set(F.col("cross_above_upper"), no="NO"), F.col("envelope_z")),
            ("upper band re-entry", _set(F.col("reenter_below_upper"), no="NO"), _none()),
            ("lower band break", _set(F.col("cross_below_lower"), no="NO"), _none()),
            ("slope", _direction(), F.col("norm_slope")),
            ("relative drift", drift, z),
            ("relative volume", _set(F.col("relative_volume") >= c.climax, "CLIMAX", "NORMAL / NA"), F.col("relative_volume")),
            ("target exposure", percent(F.col("target")), F.col("target")),
            ("actual exposure", percent(F.col("exposure")), F.col("exposure")),
        ],
    )


def tactical_next(x: DataFrame, c: Tactical = Tactical()) -> DataFrame:
    """Each symbol's next target by its last bar of tactical.decisions(), the action and, for a hold, why.

    The rule of a bar takes effect at the next open, so the last one is still to come.
    """
    rule, now = F.col("rule"), F.col("target")
    goal = now
    for r in RULES:
        if r[1] != "hold":
            to = F.lit(float(level(r, c)))
            goal = F.when(rule == r[0], (F.least if r[1] == "reduce" else F.greatest)(now, to)).otherwise(goal)
    kind = F.create_map(*[F.lit(v) for r in RULES for v in (r[0], r[1])])[rule]
    percent = lambda v: F.concat(F.round(100 * v).cast("int").cast("string"), F.lit("%"))
    y = x.withColumns({"next": goal, "kind": kind})
    after = F.col("next")
    action = (
        F.when((F.col("kind") == "reduce") & (now <= 0), "WAIT / CASH")
        .when((after < now) & (after <= 0), "SELL")
        .when(after < now, "REDUCE")
        .when(after > now, "RESTORE")
        .otherwise("HOLD")
    )
    why = (
        F.when(action == "WAIT / CASH", "a reducing rule holds and nothing is invested")
        .when((action == "HOLD") & (rule == "WARMUP"), "inputs are warming up")
        .when((action == "HOLD") & (F.col("kind") == "reduce"), "already at or below the level of the rule")
        .when((action == "HOLD") & (F.col("kind") == "restore"), "already at or above the level of the rule")
        .when(action == "HOLD", "no rule of higher rank holds")
        .otherwise("the rule moves the target")
    )
    s = F.struct("bar_ts", "rule", F.col("target").alias("target"), F.col("next").alias("next_target"), action.alias("action"), why.alias("why"), percent(now).alias("now"))
    return y.groupBy("symbol").agg(F.max_by(s, "bar_ts").alias("s")).select("symbol", "s.*")


def rules_held(x: DataFrame, c: Tactical = Tactical()) -> DataFrame:
    """Each bar's true rules, by name (the default where there is none), beside the one that counts."""
    known = conditions(c)
    names = F.array_compact(F.array(*[F.when(flag(when), F.lit(name)) for name, when in known.items()]))
    return x.select("symbol", "bar_ts", "rule", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("DEFAULT_HOLD"))).alias("rules"))


def intraday_gates(x: DataFrame) -> DataFrame:
    """Of intraday.scored() with its context: the last bar in session."""
    place = F.when(F.col("or_position") > 0, "ABOVE").when(F.col("or_position") < 0, "BELOW").otherwise("INSIDE")
    vwap = F.when(F.col("px") > F.col("vwap"), "ABOVE").when(F.col("vwap").isNotNull(), "BELOW").otherwise("NA")
    return table(
        x.where("in_session"),
        [
            ("trend", _direction(), F.col("direction")),
            ("session average price", vwap, F.col("vwap_gap")),
            ("opening range", F.concat(F.when(F.col("or_final"), "FINAL").otherwise("FORMING"), F.lit(" / "), place), F.col("or_width")),
            ("slot volume", _set(F.col("climax"), "CLIMAX", "NORMAL / WARM-UP"), F.col("slot_ratio")),
            ("relative drift", F.when(F.col("drift_z").isNotNull(), "AVAILABLE").otherwise("NA / WARM-UP"), F.col("drift_z")),
            ("session drawdown", F.lit("CURRENT"), F.col("session_drawdown")),
            ("confirmation", F.col("state"), F.col("score")),
        ],
    )
