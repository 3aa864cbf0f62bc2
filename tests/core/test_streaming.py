import datetime as dt

from tidelane.streaming import bars as S


def test_bars_close_with_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i), 1, "view", float(i % 7), "{}") for i in range(120)]
    schema = S.EVENTS
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = S.write(S.closed_bars(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    got = {r.bar_ts: (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The last event is at 119 minutes; bars that end by 99 minutes are closed.
    assert sorted(got) == [start + dt.timedelta(minutes=15 * k) for k in range(6)]
    for at, values in got.items():
        inside = [r[4] for r in rows if at <= r[1] < at + dt.timedelta(minutes=15)]
        assert values == (inside[0], max(inside), min(inside), inside[-1], 15.0)


def test_files_that_overlap_in_time_lose_no_event(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=i), 1, "view", float(i % 7), "{}") for i in range(600)]
    # Each of four files holds events of the whole time.
    for k in range(4):
        spark.createDataFrame(rows[k::4], S.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.bar_ts: (r.open, r.high, r.low, r.close, r.volume) for r in S.replay(spark, str(tmp_path / "events.parquet")).collect()}
    want = {}
    for k in range(38):
        inside = [r[4] for r in rows[15 * k : 15 * k + 15]]
        want[start + dt.timedelta(minutes=15 * k)] = (inside[0], max(inside), min(inside), inside[-1], 15.0)
    # The last event is at 599 minutes; bars that end by 579 minutes are closed.
    assert got == want, f"{sum(got.get(k) == v for k, v in want.items())} of {len(want)} bars right"
