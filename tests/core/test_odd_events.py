"""Events without value, time or symbol, and below 0: queries give the rows of their SQL."""

import datetime as dt
import random

import duckdb
import pytest

from tidelane.plans import registry
from tidelane.streaming.bars import EVENTS

CHECKED = [
    "w50_final_sessions_night",
    "w50_sessions_night",
    "w53_opening_range_day",
    "w53_opening_range_night",
    "w54_slot_volume_night",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, rows = random.Random(11), []
    for symbol in ("a", "b", "c", "d", None):
        for i in range(4 * 96):
            day, place = i // 96 + 1, i % 96
            values = [round(20 + 30 * r.random(), 2) for _ in range(r.randint(3, 5))]
            start = dt.datetime(2024, 1, day) + dt.timedelta(minutes=15 * place)
            times = [start + dt.timedelta(minutes=k) for k in range(len(values))]
            if symbol == "a":
                # The first or last value of some bars; all of a session's first bar and of its last.
                if place % 7 == 0:
                    values[r.choice([0, -1])] = None
                if (day, place) in ((2, 32), (2, 71), (2, 72), (3, 67)):
                    values = [None] * len(values)
            if symbol == "b" and place % 11 == 0:
                times[0] = None
            if symbol == "c" and (day, place) in ((2, 40), (3, 20)):
                values = [-v for v in values]
            if symbol == "c" and (day, place) == (3, 72):
                # A mean price of 0.
                values = [5.0, -2.5, -2.5]
            if symbol == "d" and (day, place) in ((2, 33), (3, 73)):
                values[1] = -0.0
            rows += [(len(rows) + k, at, 1, symbol, v, "{}") for k, (at, v) in enumerate(zip(times, values))]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", CHECKED)
def test_rows_equal_sql(spark, tables, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet/*.parquet'")
    found = registry.queries()[name](spark, tables)
    columns = sorted(found.columns)
    plain = lambda rows: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    want = plain(con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
    assert plain(found.select(*columns).collect()) == want
