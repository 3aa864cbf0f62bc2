from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelane.operators import guards as G
from tidelane.sources import ledgers, universe


def test_requests():
    today = date(2024, 3, 1)
    ok = G.Request("ACME", date(2024, 2, 1), date(2024, 2, 20), "15m", "^B500")
    assert G.faults(ok, today, need_benchmark=True) == []
    bad = G.Request(" ", date(2023, 1, 1), date(2023, 1, 1), "15m")
    assert len(G.faults(bad, today, need_benchmark=True)) == 4
    assert G.faults(G.Request("A", date(2000, 1, 1), date(2024, 1, 1)), today) == []
    assert G.faults(G.Request("A", date(2023, 12, 1), date(2024, 2, 20), "15m"), today) == ["more than 59 days of 15m bars", "15m bars reach back 59 days only"]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("2024-01-01", "1.5", 2)], "Date string, `Adj. Close` string, other int")
    assert G.canonical(df).columns == ["bar_ts", "adj_close", "other"]
    with pytest.raises(ValueError):
        G.canonical(df.withColumn("adjclose", F.lit(1)))
    with pytest.raises(ValueError):
        G.require(df, ["Date", "volume"])
    rows = spark.createDataFrame([("1", "x"), ("nan", "y"), (None, "-inf"), ("1e3", None)], "a string, b string")
    assert [r.a for r in G.numeric(rows, ["a"]).collect()] == [1.0, None, None, 1000.0]
    assert {(r.column, r.valid, r.status) for r in G.numbers_found(rows, ["a", "b"]).collect()} == {("a", 2, "OK"), ("b", 0, "NO VALID NUMBER")}
    assert G.numbers_found(rows.limit(0), ["a"]).count() == 0


def test_golden_counts_cells_that_one_side_lacks(spark):
    kind = "symbol string, bar_ts timestamp_ntz, x double, signal string"
    from datetime import datetime as T

    a = spark.createDataFrame([("s", T(2024, 1, d), float(d), "") for d in range(1, 6)], kind)
    b = spark.createDataFrame([("s", T(2024, 1, d), d + (1e-9 if d < 4 else 0.5), None if d < 5 else "BUY") for d in range(1, 7)], kind)
    found = {r.field: (r.compared, r.mismatches, r.passed) for r in G.golden(a, b, ["x"], ["signal"]).collect()}
    assert found == {"x": (6, 3, False), "signal": (6, 2, False)}


def test_csv_round_trip(spark, tmp_path):
    from datetime import datetime as T

    kind = "symbol string, bar_ts timestamp_ntz, px double, rule string, extra int"
    df = spark.createDataFrame([("a", T(2024, 1, 2), 0.1, "R", 1), ("b", T(2024, 1, 1), None, None, 2), ("a", T(2024, 1, 1), 1e300, "", 3)], kind)
    ledgers.write(df, str(tmp_path / "x"), ledgers.TACTICAL)
    back = ledgers.read(spark, str(tmp_path / "x"), "symbol string, bar_ts timestamp_ntz, px double, rule string")
    assert sorted((r.symbol, r.bar_ts.day, r.px) for r in back.where("px is not null").collect()) == [("a", 1, 1e300), ("a", 2, 0.1)]
    assert back.count() == 3 and ledgers.newest(back, 1).first().bar_ts.day == 2
    assert len(ledgers.TACTICAL) >= 33 and len(ledgers.INTRADAY) >= 31


def test_horizons_refuse_what_is_unknown():
    assert universe.horizon_bars("15m", "64B") == 64 and universe.entry_bars("frequency", "1d", "24M") == 504
    with pytest.raises(ValueError):
        universe.horizon_bars("1d", "1Y")


def test_guards_within_the_plan(spark):
    """They pass sound rows on in the same job, and fail the query where a row is unsound."""
    import datetime as dt

    from pyspark.errors import SparkRuntimeException

    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(s, day(i), 10.0, 12.0, 9.0, 11.0, 10.5, 1.0) for s in "ab" for i in range(30)]
    kind = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"
    bars = spark.createDataFrame(rows, kind)
    right = bars.select("symbol", "bar_ts", (F.col("close") * 2).alias("twice"))
    keys = ["symbol", "bar_ts"]
    joined = G.one_to_one(G.priced(G.ordered(bars)), right, keys)
    sc = spark.sparkContext
    sc.setJobGroup("guarded", "one")
    assert joined.columns == [*bars.columns, "twice"]
    assert joined.count() == 60
    jobs = len(sc.statusTracker().getJobIdsForGroup("guarded"))
    sc.setJobGroup("plain", "other")
    assert bars.join(right, keys, "full").count() == 60
    # At most a job more, for the window's exchange under adaptive execution.
    assert jobs <= len(sc.statusTracker().getJobIdsForGroup("plain")) + 2
    sc._jsc.clearJobGroup()

    def fails(df, text):
        with pytest.raises(SparkRuntimeException, match=text):
            df.collect()

    gap = right.where(~((F.col("symbol") == "a") & (F.col("bar_ts") == day(7))))
    fails(G.one_to_one(bars, gap, keys), "missing on the right side: a, 2024-01-08")
    fails(G.one_to_one(gap, bars, keys), "missing on the left side: a, 2024-01-08")
    fails(G.one_to_one(bars, right.unionByName(right.limit(1)), keys), "repeated on the right side")
    fails(G.one_to_one(bars.unionByName(bars.where("symbol = 'b'").limit(1)), right, keys), "repeated on the left side: b")
    fails(G.ordered(bars.unionByName(bars.limit(1))), "repeated bar")
    fails(G.ordered(bars.withColumn("bar_ts", F.when(F.col("symbol") == "b", F.col("bar_ts")))), "untimed bar: a")
    for column, value in (("close", 0.0), ("adj_close", float("nan")), ("open", None), ("low", 10.8), ("high", float("inf"))):
        faulty = bars.withColumn(column, F.when(F.col("bar_ts") == day(3), F.lit(value)).otherwise(F.col(column)))
        fails(G.priced(faulty), "faulty prices: . 2024-01-04")
    with pytest.raises(ValueError, match="close"):
        G.one_to_one(bars, bars, keys)
    assert G.one_to_one(bars.limit(0), right.limit(0), keys).collect() == []


def test_first_of_each_keeps_k_before_the_exchange(spark):
    from tidelane.operators import checks

    x = spark.range(2000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 2003).alias("v"))
    out = checks.first_of_each(x, ["g"], "v", 5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    want = {g: sorted((i * 7919) % 2003 for i in range(2000) if i % 3 == g) for g in range(3)}
    assert {r.g: (r.n, r["first"]) for r in out.collect()} == {g: (len(v), v[:5]) for g, v in want.items()}
    with pytest.raises(ValueError):
        checks.first_of_each(x, ["g"], "v", 0)
