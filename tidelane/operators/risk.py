"""Rolling risk and value at risk by symbol.

Rolling windows are frames of the bars; value at risk is an exact quantile, a normal one, or a
quantile of scenarios that are drawn from the observed returns. Stretches of scenarios are rows, and each
draws its own stretch of one seeded stream, so their number does not pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.windows import by_time, frame, full, prior


@dataclass(frozen=True)
class Risk:
    window: int = 13
    per_year: int = 52
    horizon: int = 5
    calibration: int = 252
    least: int = 30
    scenarios: int = 25_000
    seed: int = 20260820


#: Windows by the kind of bars: label and number of bars.
WINDOWS = {
    "Daily 7D": [("1M", 30), ("3M", 91), ("6M", 182), ("1Y", 365)],
    "Daily": [("1M", 21), ("3M", 63), ("6M", 126), ("1Y", 252)],
    "Weekly": [("1M", 4), ("3M", 13), ("6M", 26), ("1Y", 52)],
    "Monthly": [("3M", 3), ("6M", 6), ("1Y", 12), ("2Y", 24)],
}


def window_options(periodicity: DataFrame, sizes: DataFrame) -> DataFrame:
    """symbol, label, bars: the windows that are shorter than the series, else a third of it."""
    x = periodicity.join(sizes, "symbol")
    named = F.lit(None)
    for kind, options in WINDOWS.items():
        named = F.when(F.col("label") == kind, F.array(*[F.struct(F.lit(a).alias("window"), F.lit(b).alias("size")) for a, b in options])).otherwise(named)
    days = F.when(F.col("seven_days"), F.array(*map(F.lit, (1, 7, 30, 60)))).otherwise(F.array(*map(F.lit, (1, 5, 21, 42))))
    labels = F.array(*map(F.lit, ("1D", "1W", "1M", "2M")))
    short = F.zip_with(labels, days, lambda a, b: F.struct(a.alias("window"), (b * F.col("bars_day")).alias("size")))
    options = F.filter(F.coalesce(named, short), lambda o: o["size"] < F.col("n"))
    third = F.greatest(F.lit(2), F.floor(F.col("n") / 3)).cast("int")
    fallback = F.array(F.struct(F.concat(third.cast("string"), F.lit(" obs")).alias("window"), third.alias("size")))
    return x.select("symbol", F.inline(F.when(F.size(options) > 0, options).otherwise(fallback)))


def rolling(path: DataFrame, c: Risk = Risk()) -> DataFrame:
    """path (px, portfolio, shares) with returns and volatility of asset and strategy over the window."""
    w = c.window
    over = frame(-(w - 1))
    x = path.withColumns(
        {
            "asset_r": F.col("px") / prior("px") - 1,
            "strategy_r": F.col("portfolio") / prior("portfolio") - 1,
            "invested": (F.col("shares") > 0).cast("int"),
        }
    )
    year = c.per_year**0.5
    x = x.withColumns(
        {
            "asset_return": F.col("px") / prior("px", w) - 1,
            "asset_vol": full(F.stddev_samp("asset_r"), "asset_r", w, over) * year,
            "strategy_return": F.col("portfolio") / prior("portfolio", w) - 1,
            "strategy_vol": full(F.stddev_samp("strategy_r"), "strategy_r", w, over) * year,
            "exposure": full(F.avg("invested"), "invested", w, over),
        }
    )
    # The figures of windows that are all cash are not shown.
    cash = F.coalesce(F.col("exposure") == 0, F.lit(False))
    return x.withColumns(
        {
            "pure_cash": cash,
            "shown_return": F.when(~cash, F.col("strategy_return")),
            "shown_vol": F.when(~cash, F.col("strategy_vol")),
        }
    )


def dynamics(x: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Whether rolling figures stand still while the price moves."""
    out = x.groupBy("symbol").agg(
        F.count_distinct("px").alias("prices"),
        F.count_distinct("asset_return").alias("returns"),
        F.count_distinct("asset_vol").alias("vols"),
        (F.max("px") - F.min("px")).alias("price_range"),
        (F.max("asset_return") - F.min("asset_return")).alias("return_range"),
        (F.max("asset_vol") - F.min("asset_vol")).alias("vol_range"),
        F.count("asset_return").alias("_nr"),
        F.count("asset_vol").alias("_nv"),
    )
    flat = lambda n, span: (F.col(n) >= 10) & (F.coalesce(F.col(span), F.lit(0.0)) <= tolerance)
    moving = (F.col("prices") > 3) & (F.col("price_range") > tolerance)
    return out.withColumn("impossible", moving & flat("_nr", "return_range") & flat("_nv", "vol_range")).drop("_nr", "_nv")


def state(x: DataFrame) -> DataFrame:
    """Each symbol's last rolling figures and the share of bars in cash."""
    s = F.struct("bar_ts", "asset_return", "asset_vol", "strategy_return", "strategy_vol", "exposure", "shares")
    out = x.groupBy("symbol").agg(F.max_by(s, "bar_ts").alias("s"), F.avg((F.col("shares") <= 0).cast("int")).alias("cash_share"))
    position = F.when(F.col("s.shares") > 0, "INVESTED").otherwise("CASH")
    return out.select("symbol", "s.*", "cash_share", position.alias("position")).drop("shares")


def returns(series: DataFrame, c: Risk = Risk()) -> DataFrame:
    """series (symbol, bar_ts, series, r): usable returns of the last calibration bars, with their place."""
    keyed = Window.partitionBy("symbol", "series")
    good = series.where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf")) & (F.col("r") > -0.999999999))
    back = F.row_number().over(keyed.orderBy(F.desc("bar_ts")))
    x = good.withColumn("back", back).where(F.col("back") <= c.calibration)
    return x.withColumn("place", F.row_number().over(keyed.orderBy("bar_ts")))


def value_at_risk(series: DataFrame, c: Risk = Risk(), confidences=(0.95, 0.99)) -> DataFrame:
    """symbol, series, method, confidence, var, n, status."""
    r = returns(series, c)
    keyed = Window.partitionBy("symbol", "series").orderBy("bar_ts").rowsBetween(-(c.horizon - 1), 0)
    compound = F.when(F.count("r").over(keyed) == c.horizon, F.exp(F.sum(F.log1p("r")).over(keyed)) - 1)
    x = r.withColumn("h", compound).withColumn("l", F.log1p("r"))
    stats = x.groupBy("symbol", "series").agg(
        F.count("*").alias("n"),
        F.avg("l").alias("mu"),
        F.stddev_samp("l").alias("sd"),
        *[F.percentile("h", 1 - q).alias(f"hist_{i}") for i, q in enumerate(confidences)],
    )
    loss = lambda v: F.greatest(F.lit(0.0), -v)
    rows = []
    for i, q in enumerate(confidences):
        normal = F.expm1(F.col("mu") * c.horizon + NormalDist().inv_cdf(1 - q) * F.col("sd") * c.horizon**0.5)
        for method, value in (("Historical", F.col(f"hist_{i}")), ("Parametric Normal", normal)):
            rows.append(F.struct(F.lit(method).alias("method"), F.lit(q).alias("confidence"), loss(value).alias("var")))
    few = F.col("n") < c.least
    stop = F.array(F.struct(F.lit("DATA STOP").alias("method"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("var")))
    status = F.when(few, f"Insufficient observations (<{c.least})").otherwise("OK")
    return stats.select("symbol", "series", "n", status.alias("status"), F.inline(F.when(few, stop).otherwise(F.array(*rows))))


def _raw(seed: int, first: int, n: int) -> np.ndarray:
    """Numbers first to first + n - 1 of the 32-bit stream of a PCG64 generator: the halves of its outputs, low one first."""
    g = np.random.PCG64(seed).advance(first // 2)
    return g.random_raw((first % 2 + n + 1) // 2).astype("<u8").view("<u4")[first % 2 :][:n].astype(np.uint64)


def draws(seed: int, n: int, first: int, count: int, rejected: Sequence[int]) -> np.ndarray:
    """Draws first to first + count - 1 of default_rng(seed).integers(0, n), made on their own.

    A draw takes one number of the 32-bit stream, unless that is one of the rejected places of it.
    """
    gone = np.asarray(sorted(rejected), np.int64)
    # Where draw k stands: k and the rejected places before it.
    start = first + int(np.searchsorted(gone - np.arange(len(gone)), first, "right"))
    inside = gone[gone >= start]
    more = int(np.searchsorted(inside - np.arange(len(inside)), start + count, "left")) if len(inside) else 0
    raw = _raw(seed, start, count + more)
    kept = np.ones(len(raw), bool)
    kept[inside[inside < start + len(raw)] - start] = False
    return ((raw[kept][:count] * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def rejections(seed: int, n: int, first: int, count: int) -> np.ndarray:
    """Places among so many of the 32-bit stream that give no draw below n, as they would favour some values."""
    raw = _raw(seed, first, count)
    low = (raw * np.uint64(n)) & np.uint64(0xFFFFFFFF)
    return first + np.flatnonzero(low < np.uint64((1 << 32) % n))


#: Scenarios of one row of work, and spare places of the stream that rejections are looked for in.
STRETCH, SPARE = 5_000, 4_096


def bootstrap(series: DataFrame, c: Risk = Risk(), confidences=(0.95, 0.99)) -> DataFrame:
    """Value at risk from scenarios of horizon returns each, drawn with replacement by a seeded generator.

    The draws are those of numpy.random.default_rng(seed + 1000 * confidence).integers(0, n, (scenarios, horizon)). The
    generator jumps to any place of its stream, so stretches of scenarios are rows that any task can work on, with the
    series' returns (at most `calibration`) in each. The rare places that give no draw depend on n and the seed alone
    and are found first.
    """
    if c.calibration > 1 << 16:
        raise ValueError("the bootstrap draws from at most 65,536 returns")
    seeds = F.array(*[F.struct(F.lit(q).alias("confidence"), F.lit(c.seed + int(q * 1000)).cast("long").alias("seed")) for q in confidences])
    r = returns(series, c).select("symbol", "series", F.struct("place", F.log1p("r").alias("l")).alias("x"))
    lists = r.groupBy("symbol", "series").agg(F.sort_array(F.collect_list("x"))["l"].alias("l"))
    lists = lists.withColumn("n", F.size("l").cast("long")).where(F.col("n") >= c.least)

    def stretches(x: DataFrame, total: int, size: int) -> DataFrame:
        first = F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"), F.lit(size).cast("long"))
        return x.select("*", F.inline(seeds)).withColumn("first", F.explode(first))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                at = rejections(x["seed"], x["n"], x["first"], 1 << 16)
                yield pa.RecordBatch.from_pydict({"n": pa.array([x["n"]] * len(at), pa.int64()), "seed": pa.array([x["seed"]] * len(at), pa.int64()), "at": pa.array(at)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                count = min(STRETCH, c.scenarios - x["first"])
                place = draws(x["seed"], x["n"], x["first"] * c.horizon, count * c.horizon, x["gone"] or ())
                ends = np.expm1(np.array(x["l"])[place.reshape(count, c.horizon)].sum(axis=1))
                own = {k: pa.array([x[k]] * count) for k in ("symbol", "series", "confidence")}
                yield pa.RecordBatch.from_pydict(own | {"r": pa.array(ends)})

    sizes = stretches(lists.select("n").distinct(), c.scenarios * c.horizon + SPARE, 1 << 16)
    gone = sizes.mapInArrow(find, "n long, seed long, at long").groupBy("n", "seed").agg(F.sort_array(F.collect_list("at")).alias("gone"))
    work = stretches(lists, c.scenarios, STRETCH).join(gone, ["n", "seed"], "left")
    ends = work.repartition("symbol", "series", "confidence", "first").mapInArrow(run, "symbol string, series string, confidence double, r double")
    value = F.coalesce(*[F.when(F.col("confidence") == q, F.col(f"q{i}")) for i, q in enumerate(confidences)])
    out = ends.groupBy("symbol", "series", "confidence").agg(*[F.percentile("r", 1 - q).alias(f"q{i}") for i, q in enumerate(confidences)])
    return out.select("symbol", "series", F.lit("Monte Carlo Bootstrap").alias("method"), "confidence", F.greatest(F.lit(0.0), -value).alias("var"))


def all_methods(series: DataFrame, c: Risk = Risk(), confidences=(0.95, 0.99)) -> DataFrame:
    """One table of the three methods: symbol, series, n, method, confidence, var, status; a stop row where there is too little."""
    told = value_at_risk(series, c, confidences)
    sizes = told.where("method = 'Historical'").select("symbol", "series", "n", "status").distinct()
    drawn = bootstrap(series, c, confidences).join(sizes, ["symbol", "series"])
    return told.unionByName(drawn.select(*told.columns))
