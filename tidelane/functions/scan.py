"""Exponential means as a segmented scan: no Python, and no task that walks a symbol's bars one by one.

Each bar maps the mean before it to the mean after it, y -> a * y + b, and such maps compose. Bars are cut into chunks;
within a chunk the composition up to each bar is a running sum (of ln a, and of b over the product of the a so far,
which a chunk's length keeps far from overflow). What a chunk leaves is one value and its decay; the mean that enters
a chunk is made of those alone, and each bar adds its part of it. The frame of that sum ranges over the accumulated
decay, so it takes in just the chunks whose weight is at least exp(-42): a double does not see the others. All of it is
window columns over one partitioning, and nothing is joined back.

A missing value leaves the mean as it is and ages it: the value after g missing ones counts with
alpha / ((1 - alpha) ** (g + 1) + alpha). The first value is the first mean. A mean is null until it has seen as many
values as asked for. x needs the columns symbol, bar_ts, and those that chunked() adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time, so_far

CHUNK = 64
#: -ln of the least weight of an earlier chunk.
FAR = 42
PLACE, PART = "scan_place", "scan_part"


@dataclass(frozen=True)
class Mean:
    """Column name: the mean of source with this alpha, null until it has seen least values."""

    name: str
    source: str
    alpha: float
    least: int

    @classmethod
    def span(cls, name: str, source: str, n: int) -> Mean:
        return cls(name, source, 2 / (n + 1), n)


def chunked(x: DataFrame, bars: int = CHUNK) -> DataFrame:
    """x with each bar's place in its symbol and its chunk of so many bars."""
    place = F.row_number().over(by_time()).cast("long") - 1
    return x.withColumn(PLACE, place).withColumn(PART, F.floor(F.col(PLACE) / bars))


def exponential(x: DataFrame, means: list[Mean]) -> DataFrame:
    """chunked() bars with a column for each mean; all are scanned together."""
    last = [m for m in means if m.alpha >= 1]
    x = x.withColumns({m.name: F.last(m.source, ignorenulls=True).over(so_far()) for m in last})
    x = x.withColumns({m.name: F.when(F.count(m.source).over(so_far()) >= m.least, F.col(m.name)) for m in last})
    means = [m for m in means if m.alpha < 1]
    if not means:
        return x
    own = x.columns
    of = lambda kind, m: F.col(f"scan_{kind}_{m.name}")
    made = lambda kind, value: {f"scan_{kind}_{m.name}": value(m) for m in means}
    known = lambda m: F.col(m.source).isNotNull()
    past = by_time().rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns(made("n", lambda m: F.count(m.source).over(so_far())) | made("last", lambda m: F.max(F.when(known(m), F.col(PLACE))).over(past)))
    weight = lambda m: F.pow(F.lit(1 - m.alpha), F.col(PLACE) - of("last", m))
    first = lambda m: of("last", m).isNull()
    x = x.withColumns(
        made("a", lambda m: F.when(~known(m) | first(m), 0.0).otherwise(F.ln(weight(m) / (weight(m) + m.alpha))))
        | made("b", lambda m: F.when(~known(m), 0.0).when(first(m), F.col(m.source)).otherwise(m.alpha / (weight(m) + m.alpha) * F.col(m.source)))
    )
    inside = Window.partitionBy("symbol", PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns(made("p", lambda m: F.sum(of("a", m)).over(inside)))
    x = x.withColumns(made("y", lambda m: F.exp(of("p", m)) * F.sum(of("b", m) * F.exp(-of("p", m))).over(inside)))
    # What a chunk leaves stands at the next one's first bar, with the decay up to there.
    x = x.withColumns(made("left", lambda m: F.lag(of("y", m)).over(by_time())) | made("d", lambda m: -F.sum(of("a", m)).over(past)))
    x = x.withColumns(made("d", lambda m: F.coalesce(F.first(of("d", m)).over(inside), F.lit(0.0))))
    begins = F.col(PLACE) == F.min(PLACE).over(inside)
    x = x.withColumn("scan_begins", begins)
    for m in means:
        near = Window.partitionBy("symbol").orderBy(of("d", m)).rangeBetween(-FAR, 0)
        one = F.struct(F.col(PART).alias("part"), of("d", m).alias("d"), of("left", m).alias("y"))
        x = x.withColumn(f"scan_near_{m.name}", F.collect_list(F.when(F.col("scan_begins") & of("left", m).isNotNull(), one)).over(near))

    def value(m: Mean) -> Column:
        # Later chunks without decay are in the frame as well.
        weighed = lambda s: F.when(s["part"] <= F.col(PART), s["y"] * F.exp(s["d"] - of("d", m))).otherwise(0.0)
        entering = F.aggregate(of("near", m), F.lit(0.0), lambda acc, s: acc + weighed(s))
        return of("y", m) + F.exp(of("p", m)) * entering

    return x.select(*own, *[F.when(of("n", m) >= m.least, value(m)).alias(m.name) for m in means])
