import os
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidelane.operators import calibration, lifecycle
from tidelane.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_candidates_as_rows_match_one_run_each(spark, monkeypatch):
    monkeypatch.setitem(calibration.GRIDS, "tiny", ([10, 12], [24], [9], [50], [50, 65]))
    rows = [(s, datetime(2001, 1, 1) + timedelta(weeks=i), *[100.0 + (7 * i * i + 13 * k) % (31 + i)] * 4, 1.0, 5.0) for k, s in enumerate("ab") for i in range(150)]
    rows = [(*r[:6], r[5], r[7]) for r in rows]
    bars = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double")
    path = calibration.paths(bars, "tiny")
    columns = ["px", "portfolio", "shares", "adj_open", "first_buy", "first_sell"]
    got = {(r.candidate, r.symbol, r.bar_ts): tuple(r[c] for c in columns) for r in path.collect()}
    assert len(got) == 4 * 300 == path.count() and any(v[2] for v in got.values())
    for i, (fast, slow, n, buy, sell) in enumerate(product(*calibration.GRIDS["tiny"])):
        c = lifecycle.Cycle(buy=float(buy), sell=float(sell), watch=min(35.0, sell - 20.0), reduce=min(50.0, sell - 10.0))
        for r in lifecycle.lifecycle(lifecycle.indicator(bars, lifecycle.Macd(fast=fast, slow=slow, signal=n)), c).collect():
            assert got[i, r.symbol, r.bar_ts] == pytest.approx(tuple(r[c] for c in columns), rel=1e-12)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")
def test_queries_search_a_whole_grid(spark):
    known = registry.queries()
    found = known["a22_segments"](spark, SMALL).groupBy("symbol", "part").agg(F.count_distinct("candidate").alias("n")).collect()
    assert len(found) == 15 and {r.n for r in found} == {192}
    assert {"a24_ranking", "a25_walk_forward"} <= set(known)


def some_path(spark, n=200, symbols=2):
    """Random walks with purchases and sales in turn."""
    import random

    r, rows = random.Random(8), []
    for s in range(symbols):
        for c in range(3):
            p, held = 100.0, 0
            for i in range(n + 3 * s):
                move = r.random() < 0.12
                held, was = (1 - held if move else held), held
                p *= 1 + (r.random() - 0.5) / 8 * (was or held)
                rows.append((f"s{s}", datetime(2001, 1, 1) + timedelta(weeks=i), 50 + 9 * r.random(), p, float(held), int(move and held), int(move and not held), c))
    return spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, adj_open double, portfolio double, shares double, first_buy int, first_sell int, candidate int")


def test_summaries_merge_in_any_grouping(spark):
    """The whole and its halves measure the same, however finely the path is cut."""
    path = some_path(spark)
    wide = lambda n: [("all", F.lit(0).cast("long"), n), ("half", F.floor(n / 2), n)]
    fine = lambda n: [*wide(n), *[(f"cut_{k}", F.lit(7 * k).cast("long"), F.lit(7 * k + 5).cast("long")) for k in range(25)]]
    one = calibration.segments(path, wide).collect()
    two = {(r.symbol, r.candidate, r.part): r for r in calibration.segments(path, fine).collect()}
    assert len(one) == 12 and len(two) == 12 + 150
    for r in one:
        other = two[r.symbol, r.candidate, r.part]
        for k, v in r.asDict().items():
            assert other[k] == (pytest.approx(v, rel=1e-7, abs=1e-8) if isinstance(v, float) else v), (k, r, other)


def test_measures_against_plain_code(spark):
    import numpy as np

    path = some_path(spark)
    rows = {}
    for r in sorted(path.collect(), key=lambda r: (r.symbol, r.candidate, r.bar_ts)):
        rows.setdefault((r.symbol, r.candidate), []).append(r)
    for r in calibration.segments(path, calibration.split_parts).collect():
        g = rows[r.symbol, r.candidate]
        n = len(g)
        first = max(int(n * 0.6), 100)
        second = min(max(int(n * 0.8), first + 20), n - 20)
        a, b = {"train": (0, first), "validation": (first, second), "held_out": (second, n)}[r.part]
        g = g[a:b]
        p = np.array([x.portfolio for x in g])
        rets = p[1:] / p[:-1] - 1
        years = (g[-1].bar_ts - g[0].bar_ts).days / 365.25
        closed, bought = [], None
        for i, x in enumerate(g):
            bought = (i, x.adj_open) if x.first_buy else bought
            if x.first_sell and bought:
                closed.append((x.adj_open > bought[1], i - bought[0] <= 10))
                bought = None
        growth, fall = (p[-1] / p[0]) ** (1 / years) - 1, (p / np.maximum.accumulate(p) - 1).min()
        want = {
            "growth": growth,
            "max_drawdown": fall,
            "volatility": rets.std(ddof=1) * 52**0.5,
            "sharpe": rets.mean() * 52 / (rets.std(ddof=1) * 52**0.5),
            "sortino": rets.mean() * 52 / (rets[rets < 0].std(ddof=1) * 52**0.5),
            "calmar": growth / abs(fall),
            "wins": np.mean([w for w, _ in closed]) if closed else None,
            "whipsaws": np.mean([w for _, w in closed]) if closed else None,
            "exposure": np.mean([x.shares > 0 for x in g]),
        }
        assert (r.bars, r.trades) == (b - a, len(closed))
        for k, v in want.items():
            assert r[k] == (None if v is None else pytest.approx(v, rel=1e-6, abs=1e-8)), (k, r)


def test_folds_begin_and_end_as_stated(spark):
    lengths = [180, 189, 250, 345, 1000]
    x = spark.createDataFrame([(n,) for n in lengths], "n long")
    for folds in (1, 3, 8):
        parts = calibration.fold_parts(F.col("n"), folds)
        for r in x.select("n", *[F.struct(a.alias("a"), b.alias("b")).alias(p) for p, a, b in parts]).collect():
            first = max(int(r.n * 0.45), 100)
            size = max(10, (r.n - first) // folds)
            for k in range(folds):
                start = first + k * size
                end = r.n if k == folds - 1 else min(r.n, start + size)
                if start >= r.n - 2 or end - start < 3:
                    assert r[f"test_{k}"].a >= r[f"test_{k}"].b and r[f"past_{k}"].b == 0
                else:
                    assert tuple(r[f"test_{k}"]) == (start, end) and tuple(r[f"past_{k}"]) == (0, start)


def test_short_histories_and_parts(spark):
    path = some_path(spark, n=179, symbols=1)
    assert calibration.segments(path, calibration.split_parts).collect() == []
    tiny = lambda n: [("two", F.lit(5).cast("long"), F.lit(7).cast("long")), ("none", n, n)]
    found = calibration.segments(some_path(spark, symbols=1), tiny).collect()
    assert {r.part for r in found} == {"two"} and all(r.growth is None and r.trades == 0 and r.bars == 2 for r in found)
