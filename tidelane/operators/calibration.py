"""Parameter search for the lifecycle: grid, segment measures, ranking, plateau, walk-forward.

Candidates are rows that join the bars. Each (symbol, candidate) runs on its own, so the search spreads
over the cluster; the smoothed columns of candidates that share lengths are made once. A path is read once for all
parts and folds: summaries of its stretches merge (segments()). Ranking, neighbours and folds are joins and
windows within a symbol.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.operators import lifecycle

#: Fast, slow and signal lengths, buy and sell levels of each grid. Fixed values.
GRIDS = {
    "focused": ([10, 12], [24, 26, 30], [7, 9], [60, 65], [60, 65]),
    "balanced": ([8, 10, 12, 14], [21, 26, 30, 35], [5, 7, 9], [60, 65], [60, 65]),
    "deep": ([6, 8, 10, 12, 14, 16], [20, 24, 26, 30, 35, 40], [4, 5, 7, 9, 11], [55, 60, 65, 70], [55, 60, 65, 70]),
}
_KEYS = ["fast", "slow", "signal_n", "buy", "sell"]


def grid(spark: SparkSession, depth: str) -> DataFrame:
    """candidate, fast, slow, signal_n, buy, sell; the fast length below the slow one."""
    rows = [c for c in product(*GRIDS[depth]) if c[0] < c[1]]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(rows)], "candidate int, " + ", ".join(f"{k} int" for k in _KEYS))


def paths(bars: DataFrame, depth: str = "focused") -> DataFrame:
    """The lifecycle's path for every symbol and candidate of a grid."""
    candidates = grid(bars.sparkSession, depth)
    lengths = ["fast", "slow", "signal_n"]
    # Below, a symbol's bars with one set of lengths, then with one candidate, are a symbol of their own.
    x = bars.withColumn("name", F.col("symbol")).crossJoin(F.broadcast(candidates.select(*lengths).distinct()))
    x = x.withColumn("symbol", F.concat_ws("|", *lengths, "name"))
    x = lifecycle.indicator(x, lengths={"fast": F.col("fast"), "slow": F.col("slow"), "signal": F.col("signal_n")})
    numbered = candidates.withColumnRenamed("candidate", "number")
    x = x.join(F.broadcast(numbered), lengths).withColumn("symbol", F.concat_ws("|", "number", "name"))
    # All that the lifecycle asks for: every column of its input goes through its map.
    asked = ["adj_open", "px", "atr", "swing_break", "buy_score", "sell_score", "recent_bull", "recent_bear"]
    x = x.select("symbol", "bar_ts", "name", "number", "buy", "sell", *asked)
    watch = F.least(F.lit(35.0), F.col("sell") - 20.0)
    reduce = F.least(F.greatest(F.lit(50.0), watch), F.col("sell") - 10.0)
    x = lifecycle.lifecycle(x, levels={"buy": F.col("buy"), "watch": watch, "reduce": reduce, "sell": F.col("sell")})
    kept = ["bar_ts", "px", "portfolio", "shares", "adj_open", "first_buy", "first_sell"]
    return x.select(F.col("name").alias("symbol"), *kept, F.col("number").alias("candidate"))


#: Bars that a part or a fold needs, and a history as a whole.
LEAST_PART, LEAST_HISTORY = 3, 180

Part = tuple[str, Column, Column]


def split_parts(n: Column, train: float = 0.6, validation: float = 0.2, least: int = 80) -> list[Part]:
    """(name, from, to) of train, validation and held_out by a history's number of bars; least: bars of warm-up."""
    first = F.greatest(F.floor(n * train), F.lit(least + 20).cast("long"))
    second = F.least(F.greatest(F.floor(n * (train + validation)), first + 20), n - 20)
    return [("train", F.lit(0).cast("long"), first), ("validation", first, second), ("held_out", second, n)]


def fold_parts(n: Column, folds: int = 3, least: int = 80) -> list[Part]:
    """(past_k, 0, from) and (test_k, from, to) of the walk-forward's folds.

    Folds begin after 45% of the bars (and the warm-up) and have 10 bars at least; the last goes to the end. One that
    begins too late or is too short is empty.
    """
    initial = F.greatest(F.floor(n * 0.45), F.lit(least + 20).cast("long"))
    size = F.greatest(F.lit(10).cast("long"), F.floor((n - initial) / folds))
    out = []
    for k in range(folds):
        start = initial + k * size
        end = n if k == folds - 1 else F.least(n, start + size)
        known = (start < n - 2) & (end - start >= LEAST_PART)
        end, past = F.when(known, end).otherwise(start), F.when(known, start).otherwise(0)
        out += [(f"past_{k}", F.lit(0).cast("long"), past), (f"test_{k}", start, end)]
    return out


# The summary of a stretch of a path. Stretches that follow one another merge, in whatever grouping, so the path is
# read once however many parts overlap in it: moments are (count, mean, sum of squared deviations); head is a sale
# whose purchase came before the stretch, tail a purchase that is still open at its end, as (place, price).
_MOMENTS = "struct<n:bigint,mean:double,m2:double>"
_TRADE = "struct<at:bigint,price:double>"
_SUMMARY = (
    f"struct<first:bigint,n:bigint,t0:timestamp_ntz,t1:timestamp_ntz,p0:double,p1:double,peak:double,trough:double,fall:double,r:{_MOMENTS},"
    f"down:{_MOMENTS},held:bigint,closed:bigint,wins:bigint,whipsaws:bigint,bought:boolean,head:{_TRADE},tail:{_TRADE}>"
)


def _moments(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(m2, F.lit(0.0)).alias("m2"))


def _joined(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    apart = b["mean"] - a["mean"]
    return _moments(n, a["mean"] + apart * share, a["m2"] + b["m2"] + apart * apart * share * a["n"])


def merged(a: Column, b: Column, whipsaw: int) -> Column:
    """The summary of a, then b, which begins where a ends."""
    gap = b["p0"] / a["p1"] - 1
    one = lambda counts: _moments(F.when(counts, 1).otherwise(0), F.when(counts, gap), F.lit(0.0))
    closes = a["tail"].isNotNull() & b["head"].isNotNull()
    more = lambda c: F.when(closes & c, 1).otherwise(0).cast("long")
    both = F.struct(
        a["first"].alias("first"),
        (a["n"] + b["n"]).alias("n"),
        a["t0"].alias("t0"),
        b["t1"].alias("t1"),
        a["p0"].alias("p0"),
        b["p1"].alias("p1"),
        F.greatest(a["peak"], b["peak"]).alias("peak"),
        F.least(a["trough"], b["trough"]).alias("trough"),
        F.least(a["fall"], b["fall"], b["trough"] / a["peak"] - 1).alias("fall"),
        _joined(_joined(a["r"], one(gap.isNotNull())), b["r"]).alias("r"),
        _joined(_joined(a["down"], one(gap < 0)), b["down"]).alias("down"),
        (a["held"] + b["held"]).alias("held"),
        (a["closed"] + b["closed"] + more(F.lit(True))).alias("closed"),
        (a["wins"] + b["wins"] + more(b["head"]["price"] > a["tail"]["price"])).alias("wins"),
        (a["whipsaws"] + b["whipsaws"] + more(b["head"]["at"] - a["tail"]["at"] <= whipsaw)).alias("whipsaws"),
        (a["bought"] | b["bought"]).alias("bought"),
        F.coalesce(a["head"], F.when(~a["bought"], b["head"])).alias("head"),
        F.when(b["bought"], b["tail"]).when(b["head"].isNull(), a["tail"]).alias("tail"),
    )
    return F.when(a["n"] == 0, b).otherwise(both).cast(_SUMMARY)


def summaries(path: DataFrame, edges: list[Column], whipsaw: int = 10) -> DataFrame:
    """path (symbol, candidate, ...) -> symbol, candidate, n, stretches: summaries of the stretches between edges, in order.

    edges: places (from 0) that cut a path, by columns of n, its number of bars.
    """
    whole = Window.partitionBy("symbol", "candidate")
    order = whole.orderBy("bar_ts")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    x = path.withColumns({"i": (F.row_number().over(order) - 1).cast("long"), "n": F.count("*").over(whole)})
    cuts = F.array_distinct(F.array(*edges))
    buys, sells = F.col("first_buy") == 1, F.col("first_sell") == 1
    x = x.withColumns(
        {
            "stretch": F.size(F.filter(cuts, lambda c: c <= F.col("i"))),
            "r": F.col("portfolio") / F.lag("portfolio").over(order) - 1,
            "entry": F.last(F.when(buys, F.struct(F.col("i").alias("at"), F.col("adj_open").alias("price"))), ignorenulls=True).over(so_far),
        }
    )
    inside = Window.partitionBy("symbol", "candidate", "stretch").orderBy("bar_ts")
    x = x.withColumns(
        {
            "place": F.row_number().over(inside),
            "top": F.max("portfolio").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "start": F.first("i").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    r = F.when(F.col("place") > 1, F.col("r"))
    mine = sells & (F.col("entry.at") >= F.col("start"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    m2 = lambda c: F.var_pop(c) * F.count(c)
    trade = lambda c: F.struct(F.col("i").alias("at"), F.col("adj_open").alias("price"))
    last_buy, last_sale = F.max(F.when(buys, trade("buy"))), F.max(F.when(sells, F.col("i")))
    fields = x.groupBy("symbol", "candidate", "n", "stretch").agg(
        F.min("i").alias("first"),
        F.count("*").alias("bars"),
        F.min("bar_ts").alias("t0"),
        F.max("bar_ts").alias("t1"),
        F.min_by("portfolio", "i").alias("p0"),
        F.max_by("portfolio", "i").alias("p1"),
        F.max("portfolio").alias("peak"),
        F.min("portfolio").alias("trough"),
        F.min(F.col("portfolio") / F.col("top") - 1).alias("fall"),
        _moments(F.count(r), F.avg(r), m2(r)).alias("r"),
        _moments(F.count(F.when(r < 0, r)), F.avg(F.when(r < 0, r)), m2(F.when(r < 0, r))).alias("down"),
        count(F.col("shares") > 0).alias("held"),
        count(mine).alias("closed"),
        count(mine & (F.col("adj_open") > F.col("entry.price"))).alias("wins"),
        count(mine & (F.col("i") - F.col("entry.at") <= whipsaw)).alias("whipsaws"),
        (count(buys) > 0).alias("bought"),
        F.min(F.when(sells & ~F.coalesce(F.col("entry.at") >= F.col("start"), F.lit(False)), trade("sale"))).alias("head"),
        last_buy.alias("last_buy"),
        last_sale.alias("last_sale"),
    )
    tail = F.when(F.col("last_sale").isNull() | (F.col("last_sale") < F.col("last_buy.at")), F.col("last_buy"))
    fields = fields.withColumn("tail", tail)
    named = [f.split(":")[0] for f in ("first", "n", "t0", "t1", "p0", "p1", "peak", "trough", "fall", "r", "down", "held", "closed", "wins", "whipsaws", "bought", "head", "tail")]
    one = F.struct(*[F.col("bars" if f == "n" else f).alias(f) for f in named]).cast(_SUMMARY)
    return fields.groupBy("symbol", "candidate", "n").agg(F.array_sort(F.collect_list(one)).alias("stretches"))


def segments(path: DataFrame, parts: Callable[[Column], list[Part]] | list[tuple[str, float, float]], whipsaw: int = 10) -> DataFrame:
    """path (symbol, candidate, ...) -> measures of each part that parts(n) names for a history of n bars.

    Parts may also be given as shares of the bars (name, from, to). They may overlap: they are merged from the
    summaries of the stretches between all their edges. A part under three bars has no measures and no trades; a
    history under 180 bars has no parts. Bars per year follow from the part's mean distance of bars: 252 up to 2
    days, 52 up to 10, else 12. Measures are rounded to 9 digits, so that candidates with equal paths tie in
    whatever order their sums were made.
    """
    n = F.col("n")
    share = lambda v: n if v == 1 else F.floor(n * v)
    named = parts(n) if callable(parts) else [(name, share(a), share(b)) for name, a, b in parts]
    x = summaries(path, [e for _, a, b in named for e in (a, b)], whipsaw).where(F.col("n") >= LEAST_HISTORY)
    none = F.from_json(F.lit('{"n": 0}'), _SUMMARY)

    def whole(a: Column, b: Column) -> Column:
        own = F.filter("stretches", lambda s: (s["first"] >= a) & (s["first"] < b))
        return F.aggregate(own, none, lambda s, t: merged(s, t, whipsaw))

    x = x.select("symbol", "candidate", F.inline(F.array(*[F.struct(F.lit(name).alias("part"), a.alias("from"), b.alias("to"), whole(a, b).alias("s")) for name, a, b in named])))
    x = x.where(F.col("to") > F.col("from"))
    s = lambda k: F.col(f"s.{k}")
    seconds = F.unix_seconds(s("t1").cast("timestamp")) - F.unix_seconds(s("t0").cast("timestamp"))
    mean_days = seconds / 86400 / (s("n") - 1)
    per_year = F.when(mean_days <= 2, 252.0).when(mean_days <= 10, 52.0).otherwise(12.0)
    years = F.greatest(F.floor(seconds / 86400) / 365.25, 1 / per_year)
    growth = F.pow(s("p1") / s("p0"), 1 / years) - 1
    spread = lambda k: F.when(s(f"{k}.n") > 1, F.sqrt(s(f"{k}.m2") / (s(f"{k}.n") - 1) * per_year))
    yearly = F.when(s("r.n") > 0, s("r.mean") * per_year)
    enough = s("n") >= LEAST_PART
    known = lambda c, name: F.when(enough, F.round(c, 9)).alias(name)
    of_closed = lambda k: F.when(s("closed") > 0, s(k) / s("closed"))
    return x.select(
        "symbol",
        "candidate",
        "part",
        s("n").alias("bars"),
        s("t0").alias("from_ts"),
        s("t1").alias("to_ts"),
        known(growth, "growth"),
        known(s("fall"), "max_drawdown"),
        known(spread("r"), "volatility"),
        known(yearly / F.when(spread("r") > 1e-12, spread("r")), "sharpe"),
        known(yearly / F.when(spread("down") > 1e-12, spread("down")), "sortino"),
        known(growth / F.when(s("fall") < 0, F.abs(s("fall"))), "calmar"),
        known(of_closed("wins"), "wins"),
        known(of_closed("whipsaws"), "whipsaws"),
        known(s("held") / s("n"), "exposure"),
        F.when(enough, s("closed")).otherwise(0).alias("trades"),
    )


#: Measure, weight, whether more is better. Fixed values.
WEIGHTS = [
    ("growth", 0.25, True),
    ("calmar", 0.20, True),
    ("sortino", 0.15, True),
    ("sharpe", 0.10, True),
    ("max_drawdown", 0.10, True),
    ("wins", 0.08, True),
    ("whipsaws", 0.07, False),
    ("exposure", 0.05, True),
]


def scored(measures: DataFrame, least_trades: int = 2) -> DataFrame:
    """measures with score: weighted shares of rank among a symbol's candidates in the same part.

    Ties take the mean rank; nulls rank nowhere and count 0; few trades cost 45 in a hundred.
    """
    total = F.lit(0.0)
    for name, weight, more in WEIGHTS:
        by = Window.partitionBy("symbol", "part").orderBy(F.col(name).asc_nulls_last() if more else F.col(name).desc_nulls_last())
        ties = F.count("*").over(Window.partitionBy("symbol", "part", name))
        share = (F.rank().over(by) + (ties - 1) / 2) / F.count(name).over(Window.partitionBy("symbol", "part"))
        total = total + weight * F.when(F.col(name).isNotNull(), share).otherwise(0.0)
    # Rounded, as scores that are equal but for the order of sums are equal.
    return measures.withColumn("score", F.round(F.when(F.col("trades") < least_trades, total * 0.55).otherwise(total), 9))


#: How far the settings of neighbouring candidates may differ, in the order of _KEYS.
NEAR = (2, 5, 2, 5, 5)


def neighbours(candidates: DataFrame) -> DataFrame:
    """candidate, other: those of a grid whose settings are near, itself included.

    The grid alone is compared with itself, once for all symbols; its size is fixed by GRIDS.
    """
    other = candidates.select(F.col("candidate").alias("other"), *[F.col(k).alias(f"_{k}") for k in _KEYS])
    close = F.lit(True)
    for k, most in zip(_KEYS, NEAR):
        close = close & (F.abs(F.col(k) - F.col(f"_{k}")) <= most)
    return candidates.join(F.broadcast(other), close).select("candidate", "other")


def ranking(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """scores of the parts train and validation -> each symbol's candidates with robust and plateau scores and place.

    Only the best quarter by train score may be chosen; the part held out is never looked at.
    """
    wide = scores.groupBy("symbol", "candidate").agg(
        F.max(F.when(F.col("part") == "train", F.col("score"))).alias("train"),
        F.max(F.when(F.col("part") == "validation", F.col("score"))).alias("validation"),
    )
    cut = wide.groupBy("symbol").agg(F.round(F.percentile("train", 0.75), 9).alias("cut"))
    x = wide.join(cut, "symbol").join(candidates, "candidate")
    robust = F.round(0.7 * F.col("train") + 0.3 * F.col("validation"), 9)
    x = x.withColumn("robust", F.when(F.col("train") >= F.col("cut"), robust).otherwise(0.0)).drop("cut")
    near = neighbours(candidates).join(x.select("symbol", F.col("candidate").alias("other"), F.col("robust").alias("near")), "other")
    plateau = (
        x.select("symbol", "candidate", "robust")
        .join(near, ["symbol", "candidate"])
        .groupBy("symbol", "candidate")
        .agg(F.avg((F.col("near") >= F.round(0.95 * F.col("robust"), 9)).cast("int")).alias("plateau"))
    )
    x = x.join(plateau, ["symbol", "candidate"]).withColumn("plateau", F.when(F.col("robust") > 0, F.col("plateau")).otherwise(0.0))
    x = x.withColumn("final", F.round(F.col("robust") * (0.85 + 0.15 * F.col("plateau")), 9))
    best = Window.partitionBy("symbol").orderBy(F.desc("final"), F.desc("validation"), F.desc("train"), F.desc("plateau"), "candidate")
    return x.withColumn("place", F.row_number().over(best))


def walk_forward(path: DataFrame, folds: int = 3, least_trades: int = 2, whipsaw: int = 10) -> DataFrame:
    """For each fold: the candidate that is best on all bars before it (ties: the first), and its measures in the fold."""
    x = scored(segments(path, lambda n: fold_parts(n, folds), whipsaw), least_trades)
    x = x.withColumn("fold", F.regexp_extract("part", "[0-9]+", 0).cast("int"))
    past = x.where(F.col("part").startswith("past_"))
    best = Window.partitionBy("symbol", "fold").orderBy(F.desc("score"), "candidate")
    chosen = past.withColumn("place", F.row_number().over(best)).where("place = 1")
    chosen = chosen.select("symbol", "fold", "candidate", F.col("score").alias("past_score"), F.col("to_ts").alias("past_end"))
    test = x.where(F.col("part").startswith("test_"))
    return chosen.join(test.drop("part", "score"), ["symbol", "fold", "candidate"])
