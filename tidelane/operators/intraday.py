"""Sessions of quarter-hour bars: volume-weighted price, opening range, slot volume, score.

A session is a symbol's bars of one local date within its hours (hours that pass midnight belong to
the next date). Windows by session never pass into another; the slot baseline looks at the same
bar number of earlier sessions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelane.functions.windows import div, flag, frame, full, log, prior, ratio, sign
from tidelane.sources.bars import adjusted


@dataclass(frozen=True)
class Session:
    zone: str = "UTC"
    opens: int = 0
    closes: int = 1440
    days: int = 365
    bars: int = 96

    @property
    def rolls(self) -> bool:
        """Whether it opens in the evening of the date before."""
        return self.opens > self.closes


@dataclass(frozen=True)
class Lab:
    opening_bars: int = 4
    slot_sessions: int = 10
    atr_bars: int = 14
    vol_bars: int = 32
    climax: float = 1.5
    up: float = 20.0
    strong: float = 50.0


#: Sessions by the ending of a ticker, in local time; the last one is for all others.
SESSIONS = {
    ".IS": Session("Europe/Istanbul", 600, 1080, 252, 32),
    "-USD": Session("UTC", 0, 1440, 365, 96),
    "=F": Session("America/New_York", 1080, 1020, 252, 92),
    "": Session("America/New_York", 570, 960, 252, 26),
}


def session_of(ticker: Column) -> Column:
    """The key of SESSIONS for a ticker."""
    name = F.upper(F.trim(ticker))
    out = F.lit("")
    for ending in reversed([e for e in SESSIONS if e]):
        out = F.when(name.endswith(ending), ending).otherwise(out)
    return out


def completed(bars: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Without each symbol's last bar where that is still running."""
    last = F.col("bar_ts") == F.max("bar_ts").over(Window.partitionBy("symbol"))
    running = F.col("bar_ts") + F.make_dt_interval(mins=F.lit(minutes)) > now
    return bars.withColumn("_running", last & running).where(~F.col("_running")).drop("_running")


def labelled(bars: DataFrame, s: Session = Session()) -> DataFrame:
    """With local_minute, in_session and session_date; bar_ts is UTC without a zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(s.zone), "bar_ts")
    minute = F.hour(local) * 60 + F.minute(local)
    inside = (minute >= s.opens) | (minute < s.closes) if s.rolls else (minute >= s.opens) & (minute < s.closes)
    date = F.to_date(local)
    if s.rolls:
        date = F.when(minute >= s.opens, F.date_add(date, 1)).otherwise(date)
    return bars.withColumns({"local_minute": minute, "in_session": inside, "session_date": F.when(inside, date)})


def in_session() -> WindowSpec:
    """A session's bars in order."""
    return Window.partitionBy("symbol", "session_date").orderBy("bar_ts")


def analytics(bars: DataFrame, s: Session = Session(), c: Lab = Lab()) -> DataFrame:
    """Bars in and out of session with all measures; those of a session are null outside."""
    x = labelled(adjusted(bars), s)
    inside = lambda value: F.when(F.col("in_session"), value)
    x = x.withColumns(
        {
            "true_range": F.greatest(
                F.col("adj_high") - F.col("adj_low"), F.abs(F.col("adj_high") - prior("px")), F.abs(F.col("adj_low") - prior("px"))
            ),
            "log_ret": log(F.col("px") / prior("px")),
            "bar_ret": F.col("px") / prior("px") - 1,
            "same_session": flag(F.col("session_date") == prior("session_date")),
        }
    )
    x = x.withColumns(
        {
            "atr": full(F.avg("true_range"), "true_range", c.atr_bars, frame(-(c.atr_bars - 1))),
            "real_vol": full(F.stddev_samp("log_ret"), "log_ret", c.vol_bars, frame(-(c.vol_bars - 1))) * (s.days * s.bars) ** 0.5,
        }
    )
    # A session's first and last known price, and the last price of the session before: one row a session.
    known = lambda price: F.when(F.col(price).isNotNull(), F.col("bar_ts"))
    sessions = x.where("in_session").groupBy("symbol", "session_date").agg(
        F.min_by("adj_open", known("adj_open")).alias("session_open"), F.max_by("px", known("px")).alias("_close")
    )
    days = Window.partitionBy("symbol").orderBy("session_date")
    sessions = sessions.withColumn("prior_close", F.lag("_close").over(days)).drop("_close")
    x = x.join(sessions, ["symbol", "session_date"], "left")
    until_now = in_session().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("adj_high") + F.col("adj_low") + F.col("px")) / 3
    x = x.withColumn("session_bar", inside(F.row_number().over(in_session())))
    early = F.col("session_bar") <= c.opening_bars
    x = x.withColumns(
        {
            "vwap": inside(div(F.sum(typical * F.col("volume")).over(until_now), F.sum("volume").over(until_now))),
            "session_high": inside(F.max("adj_high").over(until_now)),
            "session_low": inside(F.min("adj_low").over(until_now)),
            "session_drawdown": inside(F.col("px") / F.max("px").over(until_now) - 1),
            "or_high": inside(F.max(F.when(early, F.col("adj_high"))).over(until_now)),
            "or_low": inside(F.min(F.when(early, F.col("adj_low"))).over(until_now)),
            "or_final": flag(F.col("session_bar") >= c.opening_bars),
            "session_gap": ratio(F.col("session_open"), F.col("prior_close")) - 1,
            "session_ret": ratio(F.col("px"), F.col("session_open")) - 1,
        }
    )
    slot = Window.partitionBy("symbol", "session_bar").orderBy("session_date").rowsBetween(-c.slot_sessions, -1)
    enough = F.count("volume").over(slot) >= min(3, c.slot_sessions)
    x = x.withColumn("slot_volume", inside(F.when(enough, F.percentile("volume", 0.5).over(slot))))
    x = x.withColumn("slot_ratio", div(F.col("volume"), F.col("slot_volume")))
    px, same = F.col("px"), F.col("same_session")
    x = x.withColumns(
        {
            "or_width": ratio(F.col("or_high"), F.col("or_low")) - 1,
            "climax": flag(F.col("slot_ratio") >= c.climax),
            "vwap_gap": ratio(px, F.col("vwap")) - 1,
            "vwap_gap_atr": ratio(px - F.col("vwap"), F.col("atr")),
            "or_up": flag(same & F.col("or_final") & (px > F.col("or_high")) & (prior("px") <= prior("or_high"))),
            "or_down": flag(same & F.col("or_final") & (px < F.col("or_low")) & (prior("px") >= prior("or_low"))),
            "vwap_up": flag(same & (px > F.col("vwap")) & (prior("px") <= prior("vwap"))),
            "vwap_down": flag(same & (px < F.col("vwap")) & (prior("px") >= prior("vwap"))),
            "or_position": F.when(F.col("or_final") & (px > F.col("or_high")), 1).when(F.col("or_final") & (px < F.col("or_low")), -1).otherwise(0),
        }
    )
    return x


def scored(x: DataFrame, context: DataFrame | None = None, c: Lab = Lab()) -> DataFrame:
    """analytics() with the confirmation score (-100 to 100), its state and the parts available.

    context (symbol, bar_ts, direction, momentum_up, momentum_down, drift_z) adds its parts.
    """
    score = 15.0 * sign(F.col("px") - F.col("vwap")) + 15.0 * F.col("or_position")
    score = score + F.when(F.col("climax"), 10.0 * sign(F.col("bar_ret"))).otherwise(0.0)
    parts = F.col("vwap").isNotNull().cast("int") + F.col("or_final").cast("int") + F.col("slot_ratio").isNotNull().cast("int")
    if context is not None:
        x = x.join(context.select("symbol", "bar_ts", "direction", "momentum_up", "momentum_down", "drift_z"), ["symbol", "bar_ts"], "left")
        z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.coalesce("drift_z", F.lit(0.0))))
        warn = F.coalesce(F.col("momentum_up").cast("int"), F.lit(0)) - F.coalesce(F.col("momentum_down").cast("int"), F.lit(0))
        score = score + 25.0 * sign(F.col("direction")) + 10.0 * warn + F.when(F.col("drift_z").isNotNull(), z / 3 * 20).otherwise(0.0)
        parts = parts + F.col("direction").isNotNull().cast("int") + 1 + F.col("drift_z").isNotNull().cast("int")
    inside = F.col("in_session")
    x = x.withColumn("score", F.when(inside, F.greatest(F.lit(-100.0), F.least(F.lit(100.0), score))))
    v = F.col("score")
    state = (
        F.when(~inside, "OUTSIDE PRIMARY SESSION")
        .when(v <= -c.strong, "STRONG DOWN CONFIRMATION")
        .when(v <= -c.up, "DOWN CONFIRMATION")
        .when(v >= c.strong, "STRONG UP CONFIRMATION")
        .when(v >= c.up, "UP CONFIRMATION")
        .otherwise("NEUTRAL")
    )
    return x.withColumns({"state": state, "parts": F.when(inside, parts).otherwise(0)})


def audit(x: DataFrame) -> DataFrame:
    """symbol -> bars, those in and out of session, sessions."""
    return x.groupBy("symbol").agg(
        F.count("*").alias("bars"),
        F.count_if("in_session").alias("inside"),
        F.count_if(~F.col("in_session")).alias("outside"),
        F.count_distinct("session_date").alias("sessions"),
    )


def snapshot(x: DataFrame) -> DataFrame:
    """Each symbol's last bar in session."""
    s = F.struct("bar_ts", "session_bar", "state", "or_position", "climax", "px", "vwap", "score")
    last = x.where("in_session").groupBy("symbol").agg(F.max_by(s, "bar_ts").alias("s"))
    return last.select("symbol", "s.*")
