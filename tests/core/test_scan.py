import datetime as dt
import random

import pandas as pd
import pytest

from tidelane.functions import scan
from tidelane.operators import lifecycle

START = dt.datetime(2020, 1, 1)


def series(n, seed, missing):
    r = random.Random(seed)
    out = [None if r.random() < missing else 100 + r.gauss(0, 30) for _ in range(n)]
    return [None] * (seed % 5) + out


@pytest.mark.parametrize("chunk", [2, 7, 64])
def test_means_equal_the_recursion(spark, chunk):
    """Leading and inner gaps, chunks without any value, slow and fast decay; the recursion is pandas'."""
    data = {"a": series(300, 1, 0.0), "b": series(150, 2, 0.5), "c": series(20, 3, 0.95), "d": [None] * 30, "e": [5.0, *[None] * 100, 7.0, 8.0, *[None] * 70]}
    rows = [(s, START + dt.timedelta(days=i), v) for s, values in data.items() for i, v in enumerate(values)]
    x = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, v double")
    means = [scan.Mean.span("m3", "v", 3), scan.Mean.span("m120", "v", 120), scan.Mean("w14", "v", 1 / 14, 14), scan.Mean("m1", "v", 1.0, 1), scan.Mean("first", "v", 0.3, 0)]
    out = scan.exponential(scan.chunked(x, chunk), means)
    assert out.columns == ["symbol", "bar_ts", "v", scan.PLACE, scan.PART, "m1", "m3", "m120", "w14", "first"]
    got = {(r.symbol, r.bar_ts): r for r in out.collect()}
    assert len(got) == len(rows)
    for s, values in data.items():
        v = pd.Series(values, dtype=float)
        want = {m.name: v.ewm(alpha=m.alpha, adjust=False, min_periods=m.least).mean() for m in means}
        for i in range(len(values)):
            for k, w in want.items():
                value = got[s, START + dt.timedelta(days=i)][k]
                if pd.isna(w[i]):
                    assert value is None or k == "first", (s, i, k, value)
                else:
                    assert value == pytest.approx(w[i], rel=1e-9), (s, i, k)


@pytest.mark.parametrize("kind", ["dema", "ema"])
def test_smoothed_without_a_grouped_map(spark, kind):
    r, rows = random.Random(4), []
    for s in "ab":
        p = 50.0
        for i in range(170):
            o, p = p, p * (1 + (r.random() - 0.5) / 9 * (i % 50 != 0))
            rows.append((s, START + dt.timedelta(days=i), o, max(o, p), min(o, p), p, p, 1.0))
    bars = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double")
    c = lifecycle.Macd(fast=5, slow=9, signal=4, trend=20, adx=6, signal_kind=kind)
    scanned = lifecycle.smoothed_by_scan(bars, c, chunk=32)
    assert "InPandas" not in scanned._jdf.queryExecution().toString()
    want = {(x.symbol, x.bar_ts): x for x in lifecycle.smoothed(bars, c).collect()}
    got = {(x.symbol, x.bar_ts): x for x in scanned.collect()}
    assert set(got) == set(want) and len(got) == 340
    for k, x in got.items():
        for name, v in x.asDict().items():
            assert want[k][name] == (pytest.approx(v, rel=1e-8, abs=1e-9) if isinstance(v, float) else v), (k, name)


def test_no_bars(spark):
    x = spark.createDataFrame([], "symbol string, bar_ts timestamp_ntz, v double")
    assert scan.exponential(scan.chunked(x), [scan.Mean.span("m", "v", 3)]).collect() == []
