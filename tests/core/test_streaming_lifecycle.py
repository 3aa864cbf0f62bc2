import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import lifecycle
from tidelane.streaming import lifecycle as S

START = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(2), []
    for k, symbol in enumerate("ab"):
        p = 100.0
        for i in range(160):
            o, p = p, max(5.0, p * (1 + (r.random() - 0.48) / 6))
            rows.append((symbol, START + dt.timedelta(days=i), o, max(o, p) * 1.01, min(o, p) * 0.99, p, p * 0.9 + k, 10.0))
    return spark.createDataFrame(rows, S.BARS)


def rows_of(df):
    return {(r.symbol, r.bar_ts): r for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, r in got.items():
        for c, v in r.asDict().items():
            assert want[k][c] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), (k, c, v, want[k][c])


SETTINGS = [
    (lifecycle.Macd(fast=5, slow=9, signal=4, trend=20), lifecycle.Cycle(buy=45.0, sell=50.0, reduce=40.0, sell_bars=1, cooldown=2, execute_reduce=True)),
    (lifecycle.Macd(fast=4, slow=8, signal=3, trend=10, signal_kind="ema", use_adx=False), lifecycle.Cycle(buy=40.0, need_bull_cross=False, buy_bars=2)),
]


def wanted(bars, k):
    m, c = SETTINGS[k]
    return rows_of(lifecycle.lifecycle(lifecycle.indicator(bars, m), c))


@pytest.mark.parametrize("k", [0, 1])
def test_follower_equals_the_batch(bars, k):
    """Whatever place the state is stored and read at, through JSON."""
    import json

    want, got = wanted(bars, k), {}
    assert any(r.first_buy for r in want.values()) and any(r.first_sell for r in want.values())
    for symbol in "ab":
        f = S.Follower(*SETTINGS[k])
        for i, b in enumerate(sorted(bars.where(F.col("symbol") == symbol).collect(), key=lambda b: b.bar_ts)):
            if i % 17 == 0:
                f = S.Follower(*SETTINGS[k], json.loads(json.dumps(f.state())))
            got[symbol, b.bar_ts] = f.add(b)
    assert set(got) == set(want)
    for key, row in got.items():
        for c, v in row.items():
            assert want[key][c] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v), (key, c)


def test_restart_mixed_and_late_bars(spark, bars, tmp_path):
    """Bars that batches mix within the delay, repeated and late ones, and a stop between two of the files."""
    want, place = wanted(bars, 0), str(tmp_path / "in")
    day = F.datediff("bar_ts", F.lit(START))

    def write(some):
        some.coalesce(1).write.mode("append").parquet(place)

    def run():
        rows = S.follow(S.bar_files(spark, place), *SETTINGS[0], delay="10 days")
        S.start(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.schema(S.OUT).parquet(str(tmp_path / "out"))

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # Days 0 to 59, of which every third of the last nine comes a file later.
    held = (day >= 51) & (day < 60) & (day % 3 == 0)
    write(bars.where((day < 60) & ~held))
    first = rows_of(run())
    assert first and max(t for _, t in first) <= START + dt.timedelta(days=49)
    # The rest of these, a bar again, and one far too late with another price.
    late = bars.where("symbol = 'a'").where(day == 3).withColumn("close", F.lit(1.0))
    write(bars.where(held | ((day >= 60) & (day < 100))).unionByName(bars.where(day == 99)).unionByName(late))
    run()
    write(bars.where(day >= 100))
    S.heartbeat(spark, place, START + dt.timedelta(days=400))
    same(rows_of(run()), want)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_replay_of_no_bars(spark, bars):
    assert S.replay(spark, bars.limit(0)).count() == 0
