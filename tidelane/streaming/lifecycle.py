"""The position lifecycle on a stream of bars: a keyed state machine that carries all it needs from bar to bar.

Each symbol's state is the recursive means, the last bars that a window looks back on, and the open position: a
fixed number of values, whatever the length of the history. Bars that came early wait in the state until the watermark
has passed them (a timer for each symbol), so that they are taken in order of time however batches mix them; a bar
not after the last one taken is late or repeated and is dropped. What is emitted equals lifecycle.lifecycle() on the
whole history, row by row.

State is kept by RocksDB under the checkpoint, so a restarted query goes on where the last committed batch ended. A
stream that has ended is flushed by a heartbeat: a row without a symbol whose time moves the watermark.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelane.operators.lifecycle import MOVES, Cycle, Macd, Walk
from tidelane.streaming.bars import scratch_folder

BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"
OUT = (
    "symbol string, bar_ts timestamp_ntz, px double, adj_open double, line double, signal double, atr double, buy_score double, sell_score double, "
    "shares double, cash double, portfolio double, first_buy int, first_sell int, reduced int, state string, executed string"
)
_HEARTBEAT = ""
_names = lambda ddl: [f.split()[0] for f in ddl.split(", ")]
_MOVES, BAR_COLUMNS = _names(MOVES), _names(BARS)


class Mean:
    """An exponential mean: null until it has seen `least` values; a missing value ages the mean."""

    def __init__(self, alpha: float, least: int, kept: list | None = None):
        self.alpha, self.least = alpha, least
        self.value, self.n, self.weight = kept or (None, 0, 1.0)

    def add(self, x: float | None) -> float | None:
        if self.value is None:
            if x is not None:
                self.value, self.n, self.weight = x, 1, 1.0
        else:
            self.weight *= 1 - self.alpha
            if x is not None:
                self.value = (self.weight * self.value + self.alpha * x) / (self.weight + self.alpha)
                self.n, self.weight = self.n + 1, 1.0
        return self.value if self.n >= self.least else None

    def kept(self) -> list:
        return [self.value, self.n, self.weight]


class Double:
    """Twice the mean less the mean of the mean."""

    def __init__(self, n: int, one: list | None = None, two: list | None = None):
        self.one, self.two = (Mean(2 / (n + 1), n, k) for k in (one, two))

    def add(self, x: float | None) -> float | None:
        a = self.one.add(x)
        b = self.two.add(a)
        return None if b is None else 2 * a - b


def _less(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else a - b


def _over(a: float | None, b: float | None) -> bool:
    """a > b, false where one is unknown."""
    return a is not None and b is not None and a > b


def _part(a: float | None, b: float | None) -> float | None:
    return None if a is None or not b else a / b


class Follower:
    """Indicator and lifecycle of one symbol, a bar at a time; state() and the constructor carry it between batches."""

    def __init__(self, m: Macd, c: Cycle, state: dict | None = None):
        self.m, self.c, s = m, c, state or {}
        spans = {"fast": m.fast, "slow": m.slow, "signal": m.signal, "trend": m.trend}
        kept = s.get("means", {})
        double = lambda k: Double(spans[k], *kept.get(k, (None, None)))
        self.doubles = {k: double(k) for k in ("fast", "slow", "trend")}
        if m.signal_kind == "dema":
            self.doubles["signal"] = double("signal")
        one = lambda k, alpha, n: Mean(alpha, n, kept.get(k))
        self.means = {k: one(k, 2 / (n + 1), n) for k, n in (("plain_fast", m.plain_fast), ("plain_slow", m.plain_slow), ("plain_signal", m.plain_signal))}
        self.means |= {k: one(k, 1 / m.adx, m.adx) for k in ("tr", "plus", "minus", "adx")}
        if m.signal_kind != "dema":
            self.means["signal"] = one("signal", 2 / (m.signal + 1), m.signal)
        self.last: dict = s.get("last", {})
        sizes = {"low": m.swing, "bull": m.cross_bars, "bear": m.cross_bars, "rising": m.slope_bars, "falling": m.slope_bars}
        sizes |= {"hist_rising": m.histogram_bars, "hist_falling": m.histogram_bars, "buy": c.buy_bars, "sell": c.sell_bars}
        self.seen = {k: deque(s.get("seen", {}).get(k, ()), maxlen=n) for k, n in sizes.items()}
        self.walk = Walk(c, s.get("walk"))

    def state(self) -> dict:
        means = {k: m.kept() for k, m in self.means.items()} | {k: [d.one.kept(), d.two.kept()] for k, d in self.doubles.items()}
        return {"means": means, "last": self.last, "seen": {k: list(v) for k, v in self.seen.items()}, "walk": self.walk.state()}

    def _steady(self, name: str, now: bool) -> bool:
        """Whether the condition has held for as many bars as name looks back on."""
        self.seen[name].append(now)
        return len(self.seen[name]) == self.seen[name].maxlen and all(self.seen[name])

    def _recent(self, name: str, now: bool) -> bool:
        self.seen[name].append(now)
        return any(self.seen[name])

    def add(self, bar: Row) -> dict:
        """The bar's row of lifecycle.lifecycle()."""
        m, c, last = self.m, self.c, self.last
        scale = bar.adj_close / bar.close
        adj_open, high, low, px = bar.open * scale, bar.high * scale, bar.low * scale, bar.close * scale
        before = last.get("px")
        tr = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        up, down = _less(high, last.get("high")), _less(last.get("low"), low)
        mean, double = self.means, self.doubles
        line = _less(double["fast"].add(px), double["slow"].add(px))
        signal = (double if m.signal_kind == "dema" else mean)["signal"].add(line)
        plain = _less(mean["plain_fast"].add(px), mean["plain_slow"].add(px))
        plain_signal = mean["plain_signal"].add(plain)
        base = double["trend"].add(px)
        atr = mean["tr"].add(tr)
        plus = mean["plus"].add(up if _over(up, down) and up > 0 else 0.0)
        minus = mean["minus"].add(down if _over(down, up) and down > 0 else 0.0)
        plus, minus = (_part(None if x is None else 100 * x, atr) for x in (plus, minus))
        strength = None if plus is None or minus is None else _part(100 * abs(plus - minus), plus + minus)
        adx = mean["adx"].add(strength)
        hist, plain_hist = _less(line, signal), _less(plain, plain_signal)
        cross = lambda a, b, c, d: _over(a, b) and None not in (c, d) and c <= d
        bull = self._recent("bull", cross(line, signal, last.get("line"), last.get("signal")))
        bear = self._recent("bear", cross(signal, line, last.get("signal"), last.get("line")))
        slope = lambda k, now: _less(now, last.get(k))
        signal_slope, hist_slope, base_slope = slope("signal", signal), slope("hist", hist), slope("base", base)
        rising, falling = self._steady("rising", _over(signal_slope, 0)), self._steady("falling", _over(0, signal_slope))
        hist_rising, hist_falling = self._steady("hist_rising", _over(hist_slope, 0)), self._steady("hist_falling", _over(0, hist_slope))
        lows = self.seen["low"]
        swing_break = len(lows) == m.swing and px < min(lows)
        lows.append(low)
        strong = adx is not None and adx >= m.adx_least
        extension = _part(_less(px, base), atr)
        buy = [
            (bull, 16),
            (_over(line, signal), 10),
            (rising, 10),
            (_over(hist, 0), 8),
            (hist_rising, 8),
            (_over(px, base), 10),
            (_over(base_slope, 0), 8),
            *[(_over(plain, plain_signal) and plain_hist >= 0, 10)] * m.use_plain,
            *[(strong and _over(plus, minus), 8)] * m.use_adx,
            *[(extension is not None and extension <= m.most_extension, 4)] * m.no_chase,
        ]
        sell = [
            (bear, 16),
            (_over(signal, line), 10),
            (falling, 10),
            (_over(0, hist), 8),
            (hist_falling, 10),
            (_over(base, px), 10),
            (_over(0, base_slope), 8),
            *[(_over(plain_signal, plain) and plain_hist <= 0, 8)] * m.use_plain,
            *[(strong and _over(minus, plus), 6)] * m.use_adx,
            (swing_break, 6),
        ]
        buy_score, sell_score = (100.0 * sum(w for held, w in parts if held) / sum(w for _, w in parts) for parts in (buy, sell))
        candidate = buy_score >= c.buy and (bull or not c.need_bull_cross)
        buy_ok = self._steady("buy", candidate)
        sell_ok = self._steady("sell", sell_score >= c.sell and (bear or not c.need_bear_cross))
        step = dict(zip(_MOVES, self.walk.step(adj_open, px, atr, swing_break, buy_score, sell_score, candidate, buy_ok, sell_ok)))
        self.last = {"px": px, "high": high, "low": low, "line": line, "signal": signal, "hist": hist, "base": base}
        return step | {
            "symbol": bar.symbol,
            "bar_ts": bar.bar_ts,
            "px": px,
            "adj_open": adj_open,
            "line": line,
            "signal": signal,
            "atr": atr,
            "buy_score": buy_score,
            "sell_score": sell_score,
            "portfolio": step["shares"] * px + step["cash"],
        }


class LifecycleProcessor(StatefulProcessor):
    """Bars of a symbol wait until the watermark has passed them, then go through its Follower in order."""

    def __init__(self, m: Macd, c: Cycle):
        self.m, self.c = m, c
        self.columns = _names(OUT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last timestamp_ntz, state string")
        self.waiting = handle.getListState("waiting", BARS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] == _HEARTBEAT:
            return
        last = self.run.get()[0] if self.run.exists() else None
        first = None
        for r in rows:
            if last is None or r.bar_ts > last:
                self.waiting.appendValue(tuple(r[c] for c in BAR_COLUMNS))
                first = r.bar_ts if first is None else min(first, r.bar_ts)
        if first is not None:
            self.handle.registerTimer(_epoch_ms(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import json

        passed = timerValues.getCurrentWatermarkInMs()
        bars = sorted((Row(*BAR_COLUMNS)(*b) for b in self.waiting.get()), key=lambda b: b.bar_ts)
        at = lambda b: _epoch_ms(b.bar_ts)
        ready, later = [b for b in bars if at(b) <= passed], [b for b in bars if at(b) > passed]
        last, state = self.run.get() if self.run.exists() else (None, None)
        follower = Follower(self.m, self.c, json.loads(state) if state else None)
        for b in ready:
            if last is None or b.bar_ts > last:
                out = follower.add(b)
                last = b.bar_ts
                yield Row(*self.columns)(*[out[c] for c in self.columns])
        self.run.update((last, json.dumps(follower.state())))
        if later:
            self.waiting.put([tuple(b) for b in later])
            self.handle.registerTimer(at(later[0]))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _epoch_ms(ts: datetime) -> int:
    return int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)


@contextmanager
def _rocksdb(spark: SparkSession):
    """The state store that such processors need, for queries started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def instant(t: Column) -> Column:
    """The instant of a time without zone as UTC, so that the watermark doesn't depend on the session's zone."""
    return F.timestamp_seconds(F.unix_date(F.to_date(t)).cast("double") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.date_part(F.lit("SECOND"), t))


def follow(stream: DataFrame, m: Macd = Macd(), c: Cycle = Cycle(), delay: str = "0 seconds") -> DataFrame:
    """stream of bars -> rows of the lifecycle (OUT), each once the watermark has passed its bar."""
    timed = stream.withColumn("at", instant(F.col("bar_ts"))).withWatermark("at", delay)
    return timed.groupBy("symbol").transformWithState(LifecycleProcessor(m, c), OUT, outputMode="Append", timeMode="EventTime")


def bar_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(rows: DataFrame, path: str, checkpoint: str):
    """Append rows to path until what is there now has been read; goes on from the checkpoint."""
    with _rocksdb(rows.sparkSession):
        return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def heartbeat(spark: SparkSession, path: str, at: datetime) -> None:
    """A row without a symbol that moves the watermark to its time."""
    spark.createDataFrame([(_HEARTBEAT, at, *[None] * 6)], BARS).coalesce(1).write.mode("append").parquet(path)


def replayed(spark: SparkSession, bars: DataFrame, run: Callable[[DataFrame], DataFrame], kind: str, batches: int = 4) -> DataFrame:
    """bars, written as files of consecutive stretches of time, go through run file by file; the emitted rows (kind)."""
    root = f"{scratch_folder(spark)}/replay-{uuid.uuid4().hex}"
    bars.select(*BAR_COLUMNS).write.parquet(f"{root}/whole")
    bars = spark.read.schema(BARS).parquet(f"{root}/whole")
    first, last = bars.agg(F.min("bar_ts"), F.max("bar_ts")).first()
    edges = [first + (last - first) * k / batches for k in range(1, batches)] if first else []
    low = None
    for high in [*edges, None]:
        some = bars if low is None else bars.where(F.col("bar_ts") >= F.lit(low))
        (some if high is None else some.where(F.col("bar_ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(f"{root}/in")
        low = high
    heartbeat(spark, f"{root}/in", (last or datetime(2000, 1, 1)) + timedelta(days=3))
    start(run(bar_files(spark, f"{root}/in")), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(kind).parquet(f"{root}/out")


def replay(spark: SparkSession, bars: DataFrame, batches: int = 4, m: Macd = Macd(), c: Cycle = Cycle()) -> DataFrame:
    """The rows of follow() over bars that come in so many batches."""
    return replayed(spark, bars, lambda stream: follow(stream, m, c), OUT, batches)
