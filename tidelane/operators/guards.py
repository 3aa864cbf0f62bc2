"""Checks on inputs and runs: names of columns, numbers as text, order, requests, sessions, golden tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.windows import prior, so_far

def insist(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """df, in whose plan stands that the condition holds on every row: a row that breaks it (or where it is unknown)
    fails the query with the message. No pass of its own over the data."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.coalesce(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(text).cast("boolean")), F.lit(True)))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of both sides, whose rows must be the same by keys, each once: else the query fails and says why.

    The counts of repeated keys, the join and the check of partners share one partitioning by keys. A null in a
    key has no partner.
    """
    if both := (set(left.columns) & set(right.columns)) - set(keys):
        raise ValueError(f"columns of both sides: {sorted(both)}")
    same = Window.partitionBy(*keys)
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    own = [c for c in [*left.columns, *right.columns] if c not in keys]

    def once(df: DataFrame, side: str) -> DataFrame:
        df = df.withColumn(f"_{side}", F.count(F.lit(1)).over(same))
        return insist(df, F.col(f"_{side}") == 1, F.concat(F.lit(f"repeated on the {side} side: "), shown))

    x = once(left, "left").join(once(right, "right"), keys, "full")
    x = insist(x, F.col("_left").isNotNull(), F.concat(F.lit("missing on the left side: "), shown))
    x = insist(x, F.col("_right").isNotNull(), F.concat(F.lit("missing on the right side: "), shown))
    return x.select(*keys, *own)


def ordered(bars: DataFrame) -> DataFrame:
    """bars, in whose plan stands that each symbol's time stamps rise strictly and none is null."""
    text = lambda what: F.concat(F.lit(f"{what}: "), F.coalesce("symbol", F.lit("no symbol")), F.lit(" "), F.coalesce(F.col("bar_ts").cast("string"), F.lit("no time")))
    x = insist(bars, F.col("bar_ts").isNotNull(), text("untimed bar"))
    x = x.withColumn("_before", prior("bar_ts"))
    return insist(x, F.col("_before").isNull() | (F.col("bar_ts") > F.col("_before")), text("repeated bar")).drop("_before")


def priced(bars: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "adj_close")) -> DataFrame:
    """bars, in whose plan stands that these prices are finite and above 0 and that low and high enclose the others."""
    good = F.lit(True)
    for c in columns:
        good = good & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    if {"open", "high", "low", "close"} <= set(columns):
        good = good & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return insist(bars, good, F.concat(F.lit("faulty prices: "), F.coalesce("symbol", F.lit("no symbol")), F.lit(" "), F.coalesce(F.col("bar_ts").cast("string"), F.lit("no time"))))


#: What a provider's message says when it turns requests away; fixed values.
TURNED_AWAY = ("ratelimit", "rate limit", "too many requests", "429")


def rate_limited(message: Column) -> Column:
    """Whether a failure's message speaks of too many requests; null: no."""
    return F.coalesce(F.lower(message).rlike("|".join(TURNED_AWAY)), F.lit(False))


#: Names of bar columns as providers write them, without spaces, marks and case.
_KNOWN = {"open": "open", "high": "high", "low": "low", "close": "close", "adjclose": "adj_close", "adjustedclose": "adj_close", "volume": "volume", "date": "bar_ts", "datetime": "bar_ts", "timestamp": "bar_ts"}


def canonical(df: DataFrame) -> DataFrame:
    """Columns of a provider's table under the names of a bar frame; others keep theirs.

    Two columns that mean the same are an error.
    """
    names = {c: _KNOWN.get("".join(ch for ch in c.lower() if ch.isalnum()), c) for c in df.columns}
    if len(set(names.values())) < len(names):
        raise ValueError(f"two columns have one meaning: {sorted(names)}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has all the columns."""
    if lacking := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns are missing: {lacking}")
    return df


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what isn't a finite number becomes null."""
    value = {c: F.col(c).cast("string").try_cast("double") for c in columns}
    return df.withColumns({c: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for c, v in value.items()})


def numbers_found(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, valid, status (a column without a valid number is a stop); one aggregation."""
    x = numeric(df, columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("ok")) for c in columns])
    found = x.select(F.inline(cells)).groupBy("column").agg(F.count("*").alias("rows"), F.count_if("ok").alias("valid"))
    return found.withColumn("status", F.when(F.col("valid") > 0, "OK").otherwise("NO VALID NUMBER"))


def order_status(bars: DataFrame) -> DataFrame:
    """symbol -> bars, repeated time stamps, whether each time stamp stands once."""
    x = bars.withColumn("again", F.coalesce(F.col("bar_ts") <= prior("bar_ts"), F.lit(False)))
    out = x.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("again").alias("repeated"), F.count_if(F.col("bar_ts").isNull()).alias("untimed"))
    return out.withColumn("unique", (F.col("repeated") == 0) & (F.col("untimed") == 0))


@dataclass(frozen=True)
class Request:
    ticker: str
    start: date
    end: date
    grain: str = "1d"
    benchmark: str | None = None


#: Days that providers keep bars of a quarter of an hour.
QUARTER_HOUR_DAYS = 59


def faults(r: Request, today: date, need_benchmark: bool = False) -> list[str]:
    """What is wrong with a request; none: it may run."""
    out = []
    if not r.ticker.strip():
        out.append("no ticker")
    if r.start >= r.end:
        out.append("start is not before end")
    if r.grain == "15m":
        if (r.end - r.start).days > QUARTER_HOUR_DAYS:
            out.append(f"more than {QUARTER_HOUR_DAYS} days of 15m bars")
        if r.start < today - timedelta(days=QUARTER_HOUR_DAYS):
            out.append(f"15m bars reach back {QUARTER_HOUR_DAYS} days only")
    if need_benchmark and not (r.benchmark or "").strip():
        out.append("no benchmark")
    return out


def completed_sessions(calendar: DataFrame, now: Column, after: int = 20) -> DataFrame:
    """calendar (symbol, bar_ts, close_utc) -> with completed: the close was at least some minutes before now."""
    return calendar.withColumn("completed", F.col("close_utc") + F.make_dt_interval(mins=F.lit(after)) <= now)


def cutoffs(calendar: DataFrame) -> DataFrame:
    """symbol -> the last completed session and how many there are."""
    done = calendar.where("completed")
    return done.groupBy("symbol").agg(F.max("bar_ts").alias("cutoff"), F.count("*").alias("sessions"))


def running_withheld(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars up to each symbol's cutoff."""
    return bars.join(cutoffs(calendar).select("symbol", "cutoff"), "symbol").where(F.col("bar_ts") <= F.col("cutoff")).drop("cutoff")


def windows_around(gaps: DataFrame, days: int = 2) -> DataFrame:
    """gaps (symbol, bar_ts) -> symbol, first, last: the stretches to ask for again, overlapping ones joined."""
    x = gaps.select("symbol", "bar_ts", F.date_sub("bar_ts", days).alias("a"), F.date_add("bar_ts", days).alias("b"))
    before = prior("b")
    x = x.withColumn("new", F.coalesce((F.col("a") > F.date_add(before, 1)).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("new").over(so_far()))
    return x.groupBy("symbol", "run").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.count("*").alias("gaps")).drop("run")


def recovered(bars: DataFrame, gaps: DataFrame, again: DataFrame, days: int = 2) -> DataFrame:
    """bars, with the gaps (symbol, bar_ts) filled from another route's bars near them.

    Only rows within the asked stretches are looked at, and only those that fill a gap are taken;
    origin says which route a bar came from.
    """
    asked = windows_around(gaps, days).select(F.col("symbol").alias("s"), "first", "last")
    near = again.join(asked, (F.col("symbol") == F.col("s")) & F.col("bar_ts").cast("date").between(F.col("first"), F.col("last")), "left_semi")
    found = near.join(gaps.select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_semi")
    rest = bars.join(found.select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_anti")
    return rest.withColumn("origin", F.lit("FIRST")).unionByName(found.select(*bars.columns).withColumn("origin", F.lit("RECOVERED")))


def golden(calculated: DataFrame, expected: DataFrame, fields: list[str], texts: list[str] = (), most: float = 1e-8) -> DataFrame:
    """Both by (symbol, bar_ts): field -> compared, largest difference, mismatches, passed.

    A number that only one side has is a mismatch; texts compare by equality, null as empty.
    """
    both = calculated.select("symbol", "bar_ts", *fields, *texts).join(
        expected.select("symbol", "bar_ts", *[F.col(c).alias(f"{c}_e") for c in [*fields, *texts]]), ["symbol", "bar_ts"], "full"
    )
    one = lambda c: F.struct(
        F.lit(c).alias("field"),
        (F.col(c).isNotNull() | F.col(f"{c}_e").isNotNull()).alias("there"),
        F.abs(F.col(c) - F.col(f"{c}_e")).alias("off"),
        F.coalesce(F.abs(F.col(c) - F.col(f"{c}_e")) > most, F.col(c).isNull() != F.col(f"{c}_e").isNull()).alias("bad"),
    )
    text = lambda c: F.struct(
        F.lit(c).alias("field"),
        F.lit(True).alias("there"),
        F.lit(0.0).alias("off"),
        (F.coalesce(c, F.lit("")) != F.coalesce(f"{c}_e", F.lit(""))).alias("bad"),
    )
    cells = both.select(F.inline(F.array(*[one(c) for c in fields], *[text(c) for c in texts])))
    out = cells.groupBy("field").agg(F.count_if("there").alias("compared"), F.max("off").alias("max_off"), F.count_if("bad").alias("mismatches"))
    return out.withColumn("passed", F.col("mismatches") == 0)
