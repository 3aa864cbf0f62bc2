"""Operators against bar-by-bar loops, and the invariants that every causal operator keeps."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelane.operators import calibration, checks, kernel, lifecycle, performance, relative, tactical, trend
from tidelane.sources import bars, payloads, universe

KIND = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"


def walk(symbol, n, seed):
    r = random.Random(seed)
    price, out = 100.0, []
    for i in range(n):
        start = price * math.exp(r.gauss(0, 0.01))
        price = start * math.exp(r.gauss(0.0005, 0.03))
        high, low = max(start, price) * (1 + r.random() / 100), min(start, price) * (1 - r.random() / 100)
        out.append((symbol, datetime(2001, 1, 1) + timedelta(weeks=i), start, high, low, price, price * (0.9 + 0.1 * i / n), 100.0 + r.randrange(900)))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    rows = [x for k, s in enumerate("abc") for x in walk(s, 260, k)]
    return spark.createDataFrame(rows, KIND).cache()


def by_bar(df, *columns):
    return {(r.symbol, r.bar_ts): tuple(r[c] for c in columns) for r in df.select("symbol", "bar_ts", *columns).collect()}


def test_portfolio_matches_a_loop(sample):
    c = trend.Trend(entry_bars=20, atr_times=18.0, stop="atr")
    out = trend.run(sample, c)
    for symbol in "abc":
        rows = sorted(out.where(F.col("symbol") == symbol).collect(), key=lambda r: r.bar_ts)
        shares, cash = 0.0, c.capital
        for r in rows:
            if r.signal == "SELL" and shares:
                cash, shares = cash + shares * r.adj_open, 0.0
            elif r.signal == "BUY" and not shares:
                shares, cash = cash / r.adj_open, 0.0
            assert r.shares == pytest.approx(shares, rel=1e-9) and r.portfolio == pytest.approx(shares * r.px + cash, rel=1e-9)
    trades = performance.trades(out).collect()
    assert sum(t.status != "CLOSED" for t in trades) <= 3 and len(trades) > 3


@pytest.mark.parametrize(
    "run, columns",
    [
        (lambda b: trend.run(b, trend.Trend(entry_bars=20)), ("signal", "portfolio", "trail")),
        (lambda b: kernel.strategy(kernel.indicator(b, kernel.Kernel(lookback=20))), ("trend", "residual", "signal", "portfolio")),
        (lambda b: lifecycle.indicator(b), ("line", "signal", "adx", "buy_score")),
        (lambda b: tactical.decisions(tactical.features(kernel.indicator(b, kernel.Kernel(lookback=20)), relative.analytics(b, relative.next_symbol(b)))), ("rule", "target")),
    ],
)
def test_later_bars_change_nothing(spark, sample, run, columns):
    cut = datetime(2001, 1, 1) + timedelta(weeks=200)
    whole, part = by_bar(run(sample), *columns), by_bar(run(sample.where(F.col("bar_ts") < F.lit(cut))), *columns)
    assert len(part) == 600
    for key, values in part.items():
        for a, b in zip(values, whole[key]):
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("shape", ["gaussian", "rational_quadratic", "epanechnikov", "triangular", "quartic", "cosine"])
def test_kernel_shapes_and_bands(sample, shape):
    c = kernel.Kernel(lookback=15, kernel=shape)
    w = c.weights()
    assert min(w) >= 0 and w == sorted(w, reverse=True)
    rows = kernel.indicator(sample, c).where("trend is not null").collect()
    assert len(rows) == 3 * (260 - 15)
    assert all(r.lower <= r.trend <= r.upper and r.residual >= 0 for r in rows)


def test_staged_exposure_accounts(sample):
    x = tactical.features(kernel.indicator(sample, kernel.Kernel(lookback=20)), relative.analytics(sample, relative.next_symbol(sample)))
    c = tactical.Tactical(cash_rate=0.03)
    rows = sorted(tactical.execution(tactical.decisions(x, c), c).collect(), key=lambda r: (r.symbol, r.bar_ts))
    seen = set()
    for a, b in zip(rows, rows[1:]):
        seen.add(b.target)
        if a.symbol != b.symbol:
            continue
        cash = a.cash * 1.03 ** ((b.bar_ts - a.bar_ts).days / 365)
        equity = cash + a.shares * b.adj_open
        want = (a.shares, cash) if b.change == 0 else (b.target * equity / b.adj_open, (1 - b.target) * equity)
        assert (b.shares, b.cash) == pytest.approx(want, rel=1e-9, abs=1e-6)
        assert b.portfolio == pytest.approx(b.shares * b.px + b.cash) and (b.traded == 0) == (b.change == 0)
    assert seen <= {0.0, 0.25, 0.5, 0.75, 1.0} and len(seen) > 2


def test_lifecycle_fills_next_open(sample):
    rows = sorted(lifecycle.lifecycle(lifecycle.indicator(sample), lifecycle.Cycle(buy=50.0, sell=50.0)).collect(), key=lambda r: (r.symbol, r.bar_ts))
    assert {r.state for r in rows} >= {"BUY", "WAIT / CASH"} and any(r.first_sell for r in rows)
    for a, b in zip(rows, rows[1:]):
        if a.symbol == b.symbol and b.first_buy:
            assert a.state == "BUY" and b.shares == pytest.approx(a.cash / b.adj_open)
        if a.symbol == b.symbol and b.first_sell:
            assert a.state in ("SELL", "RISK EXIT") and b.cash == pytest.approx(a.shares * b.adj_open)


def test_search_never_looks_at_the_held_out_part(spark, sample, monkeypatch):
    monkeypatch.setitem(calibration.GRIDS, "tiny", ([10], [24, 26], [9], [50], [50, 55]))
    path = calibration.paths(sample, "tiny").cache()
    parts = [("train", 0.0, 0.6), ("validation", 0.6, 0.8)]
    table = calibration.ranking(calibration.scored(calibration.segments(path, parts)), calibration.grid(spark, "tiny")).collect()
    assert sorted((r.symbol, r.place) for r in table) == [(s, i) for s in "abc" for i in range(1, 5)]
    assert all(0 <= r.plateau <= 1 and r.final <= r.robust <= 1.000001 for r in table)
    folds = calibration.walk_forward(path, 2).collect()
    assert sorted((r.symbol, r.fold) for r in folds) == [(s, i) for s in "abc" for i in range(2)]


def test_agreement_of_routes(spark):
    assert checks.EPS32 * 16 > 1.9e-6
    base = ("s", datetime(2024, 1, 1), 10.0, 11.0, 9.0, 10.5, 10.4, 100.0)
    rows = [(*base, "A", 1), (*base[:6], None, 100.4, "B", 2), (*base[:5], 10.5 + 1e-6, 10.4, 100.0, "C", 3)]
    kind = KIND + ", route string, priority int"
    (one,) = checks.consensus(spark.createDataFrame(rows, kind)).collect()
    assert not one.conflict and one.adj_close == 10.4 and one.routes == ["A", "B", "C"] and one.missing == [] and 0 < one.spread_bps < 0.01
    (two,) = checks.consensus(spark.createDataFrame([rows[0], (*base[:5], 10.6, 10.4, 100.0, "C", 3)], kind)).collect()
    assert two.conflict


def test_calendar_classes(spark):
    day = lambda k: datetime(2024, 1, k)
    full = (1.0, 1.0, 1.0, 1.0, 1.0, 5.0)
    rows = [("s", day(1), *full), ("s", day(2), *full[:4], None, 5.0), ("s", day(3), *full), ("s", day(4), *[None] * 5, 0.0)]
    sessions = spark.createDataFrame([(day(1), True), (day(2), True), (day(3), False)], "bar_ts timestamp_ntz, completed boolean")
    out = checks.classified(spark.createDataFrame(rows, KIND), sessions)
    assert [r.kind for r in out.orderBy("bar_ts").collect()] == ["COMPLETE", "MISSING", "WITHHOLD", "QUARANTINE"]


def test_payloads_and_universe(spark):
    quote = '"quote": [{"open": [1, 2], "high": [3, 4], "low": [1, 1], "close": [2, 3], "volume": [9, 8]}]'
    good = '{"zone": "Europe/Istanbul", "timestamp": [1704096000, 1704182400], ' + quote + ', "adjclose": [{"adjclose": [2, 3]}]}'
    rows = [("a", good), ("b", good.replace("[2, 3]}]}", "[2]}]}")), ("c", "oops")]
    df = spark.createDataFrame(rows, "symbol string, body string")
    assert [(r.symbol, r.bar_ts, r.close) for r in payloads.bars(df).orderBy("bar_ts").collect()] == [("a", datetime(2024, 1, 1), 2.0), ("a", datetime(2024, 1, 2), 3.0)]
    assert {(r.symbol, r.failure) for r in payloads.failures(df).collect()} == {("b", "LENGTH MISMATCH"), ("c", "UNREADABLE")}
    table = universe.instruments(spark)
    assert table.count() == 9 and universe.chosen(table, ["Crypto"]).count() == 2 and universe.groups(table, "Commodity").count() == 2
    named = universe.named(spark.createDataFrame([("BTC-USD",), ("x",)], "symbol string"), table)
    assert {r.name for r in named.collect()} == {"Bitcoin", "x"}
    assert universe.entry_bars("frequency", "1wk") == 52 and universe.entry_bars("legacy", "1d") == 2000
    with pytest.raises(ValueError):
        universe.entry_bars("custom", "1d", custom=1)


def test_bars_have_one_row_each(spark):
    ticks = spark.createDataFrame([("s", datetime(2024, 1, 1, 0, m), m, float(m + 1)) for m in (0, 14, 15, 59)], "symbol string, ts timestamp_ntz, key int, price double")
    got = bars.from_ticks(ticks, bars.quarter_hour(F.col("ts"))).orderBy("bar_ts").collect()
    assert [(r.bar_ts.minute, r.open, r.close, r.volume) for r in got] == [(0, 1.0, 15.0, 2.0), (15, 16.0, 16.0, 1.0), (45, 60.0, 60.0, 1.0)]


def test_lifecycle_settings():
    import pytest

    from tidelane.operators import lifecycle as L

    for m, c in L.PRESETS.values():
        L.checked(m, c)
    for m, c in [(L.Macd(fast=30), L.Cycle()), (L.Macd(signal_kind="x"), L.Cycle()), (L.Macd(), L.Cycle(watch=60.0)), (L.Macd(), L.Cycle(hard_stop=1.5))]:
        with pytest.raises(ValueError):
            L.checked(m, c)


def test_parts_that_are_off_leave_the_denominator(spark):
    from pyspark.sql import functions as F

    from tidelane.operators import lifecycle as L
    from tidelane.sources import bars

    b = bars.load(spark, "/root/testdata/sf0.001", "1wk")
    m = L.Macd(use_plain=False, use_adx=False, no_chase=False, signal_kind="ema")
    x = L.indicator(b, m)
    most, least = x.agg(F.max("buy_score"), F.min("sell_score")).first()
    assert 0 <= least and most <= 100
    # 70 points are left on the buying side: every score is a share of them.
    scores = [r.buy_score * 70 / 100 for r in x.select("buy_score").distinct().collect()]
    assert all(abs(s - round(s)) < 1e-6 for s in scores)
    # All in, then half out once: never more than one reduction a position.
    y = L.lifecycle(L.indicator(b), L.Cycle(execute_reduce=True, reduce=36.0, watch=35.0))
    for r in y.groupBy("symbol").agg(F.sum("reduced").alias("cut"), F.sum("first_buy").alias("bought")).collect():
        assert r.cut <= r.bought
