import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators.intraday import Lab, Session
from tidelane.streaming import lifecycle as L
from tidelane.streaming import sessions as S

#: The clocks of this zone go back on 2023-11-05.
ZONE = Session("America/New_York", 570, 960, 252, 26)


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(3), []
    for symbol in "ab":
        for i in range(96 * 5):
            o, p = 100 + r.random(), 100 + r.random()
            rows.append((symbol, dt.datetime(2023, 11, 2) + dt.timedelta(minutes=15 * i), o, max(o, p), min(o, p), p, p * 0.9, float(r.randint(0, 9))))
    return spark.createDataFrame(rows, L.BARS)


def rows_of(df):
    return {(r.symbol, r.session_date): r for r in df.collect()}


def same(got, want):
    assert set(got) == set(want) and got
    for k, r in got.items():
        for c, v in r.asDict().items():
            assert want[k][c] == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v), (k, c)


def test_sessions_of_a_zone_equal_those_of_the_history(spark, bars):
    want = rows_of(S.of_history(bars, ZONE))
    assert {d.isoformat() for _, d in want} == {f"2023-11-0{k}" for k in range(2, 7)} and {r.bars for r in want.values()} == {26}
    same(rows_of(S.replay(spark, bars, ZONE, batches=3)), want)


def test_each_session_once_at_close_and_buffer(spark, bars, tmp_path):
    """Bars within the buffer count in any order, repeated ones once, those after it never; a restart between."""
    place, session = str(tmp_path / "in"), Session("UTC", 480, 600, 365, 8)
    at = F.col("bar_ts")

    def run():
        rows = S.finalised(L.bar_files(spark, place), session, Lab(opening_bars=3))
        L.start(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.schema(S.OUT).parquet(str(tmp_path / "out"))

    def write(some):
        some.coalesce(1).write.mode("append").parquet(place)

    own = bars.where("symbol = 'a'").where(at < dt.datetime(2023, 11, 3))
    held = at == dt.datetime(2023, 11, 2, 9, 45)
    # Up to 10:00, the close, but for the bar of 9:45; that one then, with the one of 8:00 again: nothing is closed before 10:20.
    write(own.where((at <= dt.datetime(2023, 11, 2, 10)) & ~held))
    assert run().count() == 0
    write(own.where(held | (at == dt.datetime(2023, 11, 2, 8)) | (at == dt.datetime(2023, 11, 2, 10, 15))))
    assert run().count() == 0
    write(own.where(at == dt.datetime(2023, 11, 2, 11)))
    want = rows_of(S.of_history(own, session, Lab(opening_bars=3)))
    same(rows_of(run()), want)
    # Far too late: no second row.
    write(own.where(held).withColumn("high", F.lit(1e6)))
    L.heartbeat(spark, place, dt.datetime(2023, 11, 9))
    assert run().count() == 1


def test_no_bars(spark, bars):
    assert S.replay(spark, bars.limit(0), ZONE).count() == 0
