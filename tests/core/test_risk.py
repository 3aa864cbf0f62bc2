import datetime as dt

import numpy as np

from tidelane.operators import risk


def test_bootstrap_draws_as_many_scenarios_as_the_reference(spark):
    assert risk.Risk().scenarios == 25_000
    # Two returns in thirty lose a third; of 5 draws, one or more are such with probability 0.29, two or more 0.039, three 0.003.
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "x", -1 / 3 if i < 2 else 0.001) for i in range(30)]
    series = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, series string, r double")
    out = {r.confidence: r["var"] for r in risk.bootstrap(series).collect()}
    assert abs(out[0.95] - (1 - 2 / 3 * 1.001**4)) < 1e-9 and abs(out[0.99] - (1 - (2 / 3) ** 2 * 1.001**3)) < 1e-9


def test_stretches_of_draws_are_those_of_one_seeded_run():
    """Also where half of the stream's numbers give no draw."""
    for n in (30, 252, 65_535, (1 << 31) + 5, 3_000_000_000, (1 << 30) + 7):
        want = np.random.default_rng(7).integers(0, n, 20_000)
        gone = np.concatenate([risk.rejections(7, n, k, 1000) for k in range(0, 60_000, 1000)])
        got = [risk.draws(7, n, k, min(777, 20_000 - k), gone) for k in range(0, 20_000, 777)]
        assert (np.concatenate(got) == want).all(), n
    assert len(gone)


def test_bootstrap_equals_a_plain_run(spark):
    c = risk.Risk(scenarios=12_345, horizon=3, calibration=100)
    r = np.random.default_rng(1).normal(0, 0.03, (3, 140))
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "x", float(v)) for s, values in zip("abc", r) for i, v in enumerate(values[: 140 if s != "c" else 20])]
    series = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, series string, r double")
    out = {(x.symbol, x.confidence): x["var"] for x in risk.bootstrap(series, c).collect()}
    assert {s for s, _ in out} == {"a", "b"}
    for s, values in zip("ab", r):
        l = np.log1p(values[-100:])  # noqa: E741
        for q in (0.95, 0.99):
            place = np.random.default_rng(c.seed + int(q * 1000)).integers(0, 100, (c.scenarios, c.horizon))
            want = max(0.0, -np.quantile(np.expm1(l[place].sum(axis=1)), 1 - q))
            assert abs(out[s, q] - want) < 1e-12
    table = risk.all_methods(series, c).collect()
    assert {(x.symbol, x.method) for x in table} == {(s, m) for s in "ab" for m in ("Historical", "Parametric Normal", "Monte Carlo Bootstrap")} | {("c", "DATA STOP")}
    assert {(x.symbol, x.confidence): x["var"] for x in table if x.method.startswith("Monte")} == out
