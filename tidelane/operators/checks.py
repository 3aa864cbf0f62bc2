"""Validation of bars and reconciliation of several routes to the same bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close", "adj_close", "volume"]
PRICES = FIELDS[:5]
#: Single precision: the step from 1 to the next number.
EPS32 = 1.1920929e-07


def status(bars: DataFrame, least: int = 30) -> DataFrame:
    """symbol -> the first rule that its bars break, or OK; one aggregation."""
    any_null = F.lit(False)
    for f in ["bar_ts", *FIELDS]:
        any_null = any_null | F.col(f).isNull()
    low = F.lit(False)
    for f in PRICES:
        low = low | (F.col(f) <= 0)
    by_time = bars.groupBy("symbol", "bar_ts").agg(
        F.count("*").alias("n"), F.count_if(any_null).alias("nulls"), F.count_if(low).alias("low"), F.count_if(F.col("volume") < 0).alias("neg")
    )
    out = by_time.groupBy("symbol").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("nulls").alias("nulls"), F.sum("low").alias("low"), F.sum("neg").alias("neg")
    )
    first = (
        F.when(F.col("most") > 1, "DUPLICATE TIMESTAMP")
        .when(F.col("nulls") > 0, "MISSING VALUE")
        .when(F.col("low") > 0, "NON-POSITIVE PRICE")
        .when(F.col("neg") > 0, "NEGATIVE VOLUME")
        .when(F.col("n") < least, "TOO FEW OBSERVATIONS")
        .otherwise("OK")
    )
    return out.select("symbol", "n", first.alias("status"))


def first_of_each(x: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """keys -> n, the number of rows, and first, the k least values of order; k is at most 1000.

    Each task keeps k rows of a group before the exchange, so no group is sorted or collected whole.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k is from 1 to 1000")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    few = x.select(*keys, order).withColumn("_place", place).where(F.col("_place") <= k)
    lists = few.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("first"))
    return x.groupBy(*keys).agg(F.count("*").alias("n")).join(lists, keys)


def first_faults(bars: DataFrame, k: int = 8) -> DataFrame:
    """symbol, fault -> how many time stamps have it, and the first k of them."""
    null, low = F.lit(False), F.lit(False)
    for f in FIELDS:
        null = null | F.col(f).isNull()
    for f in PRICES:
        low = low | (F.col(f) <= 0)
    at = bars.where(F.col("bar_ts").isNotNull()).groupBy("symbol", "bar_ts").agg(
        F.count("*").alias("n"), F.count_if(null).alias("nulls"), F.count_if(low).alias("low"), F.count_if(F.col("volume") < 0).alias("neg")
    )
    kinds = [(F.col("n") > 1, "DUPLICATE TIMESTAMP"), (F.col("nulls") > 0, "MISSING VALUE"), (F.col("low") > 0, "NON-POSITIVE PRICE"), (F.col("neg") > 0, "NEGATIVE VOLUME")]
    found = at.select("symbol", "bar_ts", F.explode(F.array_compact(F.array(*[F.when(c, name) for c, name in kinds]))).alias("fault"))
    return first_of_each(found, ["symbol", "fault"], "bar_ts", k)


def valid_only(bars: DataFrame, least: int = 30) -> DataFrame:
    """Bars of the symbols that break no rule."""
    return bars.join(status(bars, least).where("status = 'OK'").select("symbol"), "symbol", "left_semi")


def latest(rows: DataFrame, arrival: str) -> DataFrame:
    """One row for each symbol and day: the one that arrived last."""
    day = F.date_trunc("day", "bar_ts").cast("timestamp_ntz")
    x = rows.withColumn("bar_ts", day)
    back = F.row_number().over(Window.partitionBy("symbol", "bar_ts").orderBy(F.desc(arrival)))
    return x.withColumn("_back", back).where("_back = 1").drop("_back")


def missing_fields() -> Column:
    """Names of the null fields of a row."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS]))


def missing(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "bar_ts", missing_fields().alias("fields")).where(F.size("fields") > 0)


def placeholder() -> Column:
    """No prices, and no volume or none known."""
    empty = F.coalesce(F.col("volume"), F.lit(0.0)) == 0
    for f in PRICES:
        empty = empty & F.col(f).isNull()
    return empty


def classified(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """rows against a calendar (bar_ts, completed): quarantine, withhold, missing or complete."""
    x = rows.join(sessions, "bar_ts", "left")
    kind = (
        F.when(F.col("completed").isNull() & placeholder(), "QUARANTINE")
        .when(~F.coalesce("completed", F.lit(True)), "WITHHOLD")
        .when(F.size(missing_fields()) > 0, "MISSING")
        .otherwise("COMPLETE")
    )
    return x.withColumn("kind", kind)


def tolerance(field: str, reference: Column) -> Column:
    """How far a value may be from the reference and still agree."""
    if field == "volume":
        return F.lit(0.5)
    return F.greatest(F.lit(2e-6), 16 * EPS32 * F.greatest(F.abs(reference), F.lit(1.0)))


def consensus(routes: DataFrame) -> DataFrame:
    """routes (symbol, bar_ts, fields, route, priority) -> for each bar the value of the first route that
    has one, whether all that have one agree, the widest spread in basis points, fields still missing.

    One aggregation over the union; no join of routes.
    """
    aggs, conflict, spread = [], F.lit(False), F.lit(0.0)
    for f in FIELDS:
        aggs += [
            F.min_by(f, F.when(F.col(f).isNotNull(), F.col("priority"))).alias(f),
            F.max(f).alias(f"_max_{f}"),
            F.min(f).alias(f"_min_{f}"),
        ]
        off = F.greatest(F.abs(F.col(f"_max_{f}") - F.col(f)), F.abs(F.col(f"_min_{f}") - F.col(f)))
        conflict = conflict | F.coalesce(off > tolerance(f, F.col(f)), F.lit(False))
        if f != "volume":
            spread = F.greatest(spread, F.coalesce(F.try_divide(off, F.abs(F.col(f))) * 1e4, F.lit(0.0)))
    x = routes.groupBy("symbol", "bar_ts").agg(*aggs, F.array_sort(F.collect_set("route")).alias("routes"))
    return x.select("symbol", "bar_ts", *FIELDS, "routes", conflict.alias("conflict"), spread.alias("spread_bps"), missing_fields().alias("missing"))


def cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that both have: how many, and how many differ beyond the plain tolerances."""
    x = a.join(b.withColumnsRenamed({f: f"{f}_b" for f in FIELDS}), ["symbol", "bar_ts"])
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                (F.col(f).isNotNull() & F.col(f"{f}_b").isNotNull()).alias("both"),
                F.abs(F.col(f) - F.col(f"{f}_b")).alias("off"),
                (F.lit(0.5) if f == "volume" else 1e-8 + 1e-7 * F.abs(F.col(f"{f}_b"))).alias("most"),
            )
            for f in FIELDS
        ]
    )
    y = x.select("symbol", F.inline(cells)).where("both")
    return y.groupBy("symbol", "field").agg(F.count("*").alias("compared"), F.max("off").alias("max_off"), F.count_if(F.col("off") > F.col("most")).alias("different"))


def gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Completed sessions (symbol, bar_ts) for which a symbol has no full bar."""
    full = bars.where(F.size(missing_fields()) == 0)
    return sessions.join(full, ["symbol", "bar_ts"], "left_anti")
