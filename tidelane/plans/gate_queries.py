"""Gates of the last bar, next targets and true rules: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import gates, tactical
from tidelane.plans import intraday_queries as I
from tidelane.plans import kernel_queries as K
from tidelane.plans.oracle import r, sql
from tidelane.plans.trend_queries import DAILY, path, shown, shown_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
_G = (["symbol", "bar_ts", "place", "gate", "status"], [], ["value"])
_LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1"


def _table(source: str, rows: list[tuple[str, str, str]], *reads: str, recursive: bool = False) -> str:
    parts = [f"SELECT symbol, bar_ts, {i + 1}::INT AS place, '{g}' AS gate, {s} AS status, {r(f'({v})::DOUBLE')} AS value FROM z" for i, (g, s, v) in enumerate(rows)]
    return sql(f", z AS (SELECT * FROM {source} {_LAST})\n" + "\nUNION ALL ".join(parts), *reads, recursive=recursive)


def _set(condition: str, yes: str = "TRIGGERED", no: str = "NOT TRIGGERED") -> str:
    return f"CASE WHEN {condition} THEN '{yes}' ELSE '{no}' END"


_DIRECTION = "CASE WHEN direction > 0 THEN 'BULLISH' WHEN direction < 0 THEN 'BEARISH' ELSE 'FLAT' END"

QUERIES["l05_trend_gates"] = lambda s, d: shown(gates.trend_gates(path(s, d, "atr_1d"), DAILY), *_G)
SQL["l05_trend_gates"] = _table(
    "atr_1d",
    [
        ("breakout", _set("px >= max_price"), "px / max_price - 1"),
        ("stop", _set("px <= atr_stop"), "px / atr_stop - 1"),
        ("position", "CASE WHEN held = 1 THEN 'INVESTED' ELSE 'CASH' END", "held"),
        ("execution", "CASE WHEN px >= max_price AND held = 0 THEN 'BUY' WHEN px <= atr_stop AND px < max_price AND held = 1 THEN 'SELL' WHEN held = 1 THEN 'HOLD' ELSE 'WAIT / CASH' END", "NULL"),
    ],
    "atr_1d",
)
QUERIES["l07_kernel_gate_table"] = lambda s, d: shown(gates.kernel_gates(K.strategy(s, d)), *_G)
SQL["l07_kernel_gate_table"] = _table(
    "nws_1wk",
    [
        ("slope", _DIRECTION, "slope"),
        ("path", "CASE WHEN src > trend THEN 'ABOVE' ELSE 'BELOW / EQUAL' END", "src / trend - 1"),
        ("bullish reversal", _set("bull_reversal"), "NULL"),
        ("bearish reversal", _set("bear_reversal"), "NULL"),
        ("upper band", _set("cross_above_upper"), "NULL"),
        ("lower band", _set("cross_below_lower"), "NULL"),
        ("upward warning", _set("momentum_up"), "accel"),
        ("downward warning", _set("momentum_down"), "accel"),
        ("extension", "CASE WHEN src > upper THEN 'ABOVE UPPER' WHEN src < lower THEN 'BELOW LOWER' ELSE 'INSIDE BAND' END", "(src - trend) / (upper - trend)"),
        ("position", "CASE WHEN held = 1 THEN 'LONG' ELSE 'CASH' END", "held"),
    ],
    "nws_1wk",
)
QUERIES["l08_tactical_gates"] = lambda s, d: shown(gates.tactical_gates(tactical.execution(K.decided(s, d), K.TAC), K.TAC), *_G)
SQL["l08_tactical_gates"] = _table(
    "(SELECT c.*, t.target, t.exposure, t.rule FROM tac_c c JOIN tac t ON c.symbol = t.symbol AND c.i = t.i)",
    [
        ("upper band cross", _set("cross_above_upper", no="NO"), "envelope_z"),
        ("upper band re-entry", _set("reenter_below_upper", no="NO"), "NULL"),
        ("lower band break", _set("cross_below_lower", no="NO"), "NULL"),
        ("slope", _DIRECTION, "norm_slope"),
        (
            "relative drift",
            "CASE WHEN drift_z <= -3 THEN 'EXTREME WEAK' WHEN drift_z <= -2 THEN 'STRONG WEAK' WHEN drift_z <= -1.5 THEN 'WEAK' WHEN drift_z >= 3 THEN 'EXTREME OUTPERFORMANCE' WHEN drift_z >= 2 THEN 'STRONG OUTPERFORMANCE' ELSE 'NORMAL' END",
            "drift_z",
        ),
        ("relative volume", _set("relative_volume >= 1.5", "CLIMAX", "NORMAL / NA"), "relative_volume"),
        ("target exposure", "round(100 * target)::INT || '%'", "target"),
        ("actual exposure", "round(100 * exposure)::INT || '%'", "exposure"),
    ],
    "tac",
    "tac_c",
    recursive=True,
)
_N = (["symbol", "bar_ts", "rule", "action", "why"], ["target", "next_target"])
QUERIES["t12_next_target"] = lambda s, d: shown(gates.tactical_next(K.decided(s, d), K.TAC), *_N)
SQL["t12_next_target"] = sql(
    f"""
, z AS (SELECT c.place, t.* FROM tac_c c JOIN tac t ON c.symbol = t.symbol AND c.i = t.i {_LAST.replace('symbol', 'c.symbol').replace('bar_ts', 'c.bar_ts')}),
y AS (SELECT *, CASE WHEN place BETWEEN 2 AND 4 THEN least(target, 0.0) WHEN place IN (5, 10) THEN least(target, 0.25) WHEN place IN (6, 7, 11) THEN least(target, 0.5)
  WHEN place IN (8, 9, 12) THEN least(target, 0.75) WHEN place = 13 THEN greatest(target, 0.5) WHEN place = 14 THEN greatest(target, 0.75)
  WHEN place = 15 THEN greatest(target, 1.0) ELSE target END::DOUBLE AS next_target FROM z),
x AS (SELECT * EXCLUDE (action), CASE WHEN place BETWEEN 2 AND 12 AND target <= 0 THEN 'WAIT / CASH' WHEN next_target < target AND next_target <= 0 THEN 'SELL'
  WHEN next_target < target THEN 'REDUCE' WHEN next_target > target THEN 'RESTORE' ELSE 'HOLD' END AS action FROM y),
w AS (SELECT *, CASE WHEN action = 'WAIT / CASH' THEN 'a reducing rule holds and nothing is invested' WHEN action <> 'HOLD' THEN 'the rule moves the target'
  WHEN place = 1 THEN 'inputs are warming up' WHEN place <= 12 THEN 'already at or below the level of the rule'
  WHEN place <= 15 THEN 'already at or above the level of the rule' ELSE 'no rule of higher rank holds' END AS why FROM x)
{shown_sql('w', *_N)}""",
    "tac",
    "tac_c",
    recursive=True,
)
QUERIES["t09_rules_held"] = lambda s, d: gates.rules_held(K.decided(s, d), K.TAC).withColumn("rules", F.concat_ws(",", "rules"))
_holds = [
    "trend IS NULL OR drift_z IS NULL",
    "cross_below_lower AND direction < 0",
    "drift_z <= -3",
    "below_path AND bear_reversal AND drift_z <= -2",
    "reenter_below_upper AND (direction < 0 OR bear_reversal) AND drift_z >= 1.5",
    "reenter_below_upper",
    "cross_above_upper AND (drift_z >= 2 OR coalesce(relative_volume >= 1.5, false))",
    "cross_above_upper",
    "drift_z >= 3 AND coalesce(accel < 0, false)",
    "drift_z <= -2",
    "drift_z <= -1.5 AND (below_path OR direction < 0)",
    "bear_reversal",
    "reenter_above_lower AND bull_reversal AND drift_z <= -1.5",
    "bull_reversal AND above_path AND drift_z > -1.5",
    "above_path AND direction > 0 AND drift_z >= 0",
]
_case = ", ".join(f"CASE WHEN {h} THEN '{name}' END" for h, (name, *_) in zip(_holds, tactical.RULES))
_names = "[" + ", ".join(f"'{n}'" for n, *_ in tactical.RULES) + "]"
SQL["t09_rules_held"] = sql(f"\nSELECT symbol, bar_ts, {_names}[place] AS rule, coalesce(nullif(concat_ws(',', {_case}), ''), 'DEFAULT_HOLD') AS rules FROM tac_c", "tac_c")
QUERIES["l09_intraday_gates"] = lambda s, d: shown(gates.intraday_gates(I.confirmed(s, d)), *_G)
SQL["l09_intraday_gates"] = _table(
    "(SELECT s.*, n.direction, q.drift_z FROM lab_state s JOIN nw_15m n ON s.symbol = n.symbol AND s.bar_ts = n.bar_ts JOIN rel_15m q ON s.symbol = q.symbol AND s.bar_ts = q.bar_ts WHERE in_session)",
    [
        ("trend", _DIRECTION, "direction"),
        ("session average price", "CASE WHEN px > vwap THEN 'ABOVE' WHEN vwap IS NOT NULL THEN 'BELOW' ELSE 'NA' END", "vwap_gap"),
        ("opening range", "CASE WHEN or_final THEN 'FINAL' ELSE 'FORMING' END || ' / ' || CASE WHEN or_position > 0 THEN 'ABOVE' WHEN or_position < 0 THEN 'BELOW' ELSE 'INSIDE' END", "or_width"),
        ("slot volume", _set("climax", "CLIMAX", "NORMAL / WARM-UP"), "slot_ratio"),
        ("relative drift", "CASE WHEN drift_z IS NOT NULL THEN 'AVAILABLE' ELSE 'NA / WARM-UP' END", "drift_z"),
        ("session drawdown", "'CURRENT'", "session_drawdown"),
        ("confirmation", "state", "score"),
    ],
    "lab_state",
    "nw_15m",
    "rel_15m",
)
