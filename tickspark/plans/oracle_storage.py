"""DuckDB SQL for the queries that write and read back: they give what was written, less what a sink or source leaves out."""

from __future__ import annotations

from ..schemas import DAY, HOUR
from . import fixture as fx
from .oracle import _OHLC, BARS, CHUNKS, CORE, FAULTY, GAPS, TICKS, UNUSABLE, D, all_sql, inside, quality, rounded, sql, weekday
from .oracle_sequences import sequence_sql
from .oracle_studies import _STUDY
from .storage import FROM, TO

_VALUES = f"symbol, seq, time_ms, {rounded('bid', 'ask')}, flags"
SOUND = "sound AS (SELECT t.* FROM ticks t SEMI JOIN (SELECT symbol FROM q WHERE out_of_order + crossed + nonpositive = 0) g USING (symbol))"
FIRST = f"first_ AS (SELECT symbol, time_ms // {DAY} AS day, min(time_ms) AS time_ms, arg_min(seq, (time_ms, seq)) AS seq FROM ticks GROUP BY ALL)"
METRICS = "metrics AS (SELECT family, policy, scenario, count(*) AS trades, round(avg(net_r), 6) AS net_expectancy_r FROM facts GROUP BY ALL)"
INGEST = f"""
wanted AS (SELECT e.*, coalesce(file_ticks, 0) AS n FROM expected e SEMI JOIN sound USING (symbol) LEFT JOIN counted USING (symbol, chunk_start_ms))"""


FAULTS = f"""
days AS (SELECT symbol, {fx.START} + (i - 7) * {DAY} AS chunk_start_ms FROM (SELECT DISTINCT symbol FROM ticks), range(38) r(i)),
at_day AS (SELECT *, {fx.START} + floor((time_ms - {fx.START}) / {DAY})::BIGINT * {DAY} AS chunk_start_ms FROM faulty WHERE time_ms >= {fx.START - 7 * DAY}),
stepped AS (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY symbol, chunk_start_ms ORDER BY seq) AS step, CASE WHEN bid > 0 AND ask >= bid THEN (ask - bid) / 0.0001{D} END AS spread FROM at_day),
judged AS (SELECT symbol, chunk_start_ms, count(*) AS tick_count, count(*) FILTER (step < 0) AS out_of_order, count(*) FILTER (step = 0) AS equal_times, count(*) - count(DISTINCT (time_ms, bid, ask, flags)) AS duplicates,
  count(*) FILTER (bid > ask) AS crossed, count(*) FILTER (bid <= 0 OR ask <= 0) AS nonpositive, count(*) FILTER (step > {fx.GAP_LIMIT}) AS gaps, quantile_cont(spread, 0.5) AS spread_median FROM stepped GROUP BY ALL)"""
_HARD = "CASE WHEN tick_count IS NULL THEN 'EMPTY' END, CASE WHEN out_of_order > 0 THEN 'OUT_OF_ORDER_TICKS' END, CASE WHEN crossed > 0 THEN 'CROSSED_QUOTES' END, CASE WHEN nonpositive > 0 THEN 'NONPOSITIVE_QUOTES' END"
#: What three runs leave: a day whose last tick stays early is never entered, one with a crossed quote by the last run only, one without ticks by every run that asks for it.
RUNS = f"""
placed AS (SELECT *, {fx.START} + ((time_ms - {fx.START}) // {DAY}) * {DAY} AS chunk_start_ms FROM ticks),
marked AS (SELECT *, seq = max(seq) OVER (PARTITION BY symbol, chunk_start_ms) AS at_end, lag(time_ms) OVER (PARTITION BY symbol, chunk_start_ms ORDER BY seq) AS before FROM placed),
per_day AS (SELECT symbol, chunk_start_ms, count(*) AS n, bool_or(at_end AND (chunk_start_ms - {fx.START}) // {DAY} % 7 = 4 AND before > greatest(chunk_start_ms, time_ms - {HOUR})) AS early FROM marked GROUP BY ALL),
facts AS (SELECT e.*, coalesce(n, 0) AS n, coalesce(early, false) AS early, {inside('chunk_start_ms', 'chunk_end_ms')} AS closed, (chunk_start_ms - {fx.START}) // {DAY} AS day FROM expected e LEFT JOIN per_day USING (symbol, chunk_start_ms)),
entered AS (SELECT *, CASE WHEN early THEN 0 WHEN n > 0 OR closed THEN 1 WHEN day < 15 THEN 3 ELSE 2 END AS entries,
  CASE WHEN early THEN 0 WHEN n > 0 AND day % 7 = 2 OR n = 0 AND NOT closed THEN 3 WHEN day < 15 THEN 1 ELSE 2 END AS last_run FROM facts),
left_over AS (SELECT symbol, chunk_start_ms, CASE WHEN n > 0 AND NOT early THEN n END AS file_ticks, CASE WHEN NOT early THEN n END AS ledger_ticks,
  CASE WHEN early THEN 'MISSING_LEDGER' WHEN closed AND n = 0 THEN 'EXPECTED_MARKET_CLOSED' WHEN closed THEN 'LEDGER_MISMATCH' WHEN n = 0 THEN 'MISSING_HISTORY' ELSE 'COMPLETED' END AS chunk_status, entries, last_run FROM entered)"""


def storage_sql() -> dict[str, str]:
    studied = all_sql()
    return {
        "csv_history": sql(TICKS, "placed AS (SELECT * REPLACE (row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS seq) FROM ticks)", select=f"SELECT {_VALUES} FROM placed"),
        "tick_history": sql(TICKS, quality("ticks"), SOUND, select=f"SELECT {_VALUES} FROM sound WHERE time_ms >= {FROM} AND time_ms < {TO}"),
        "bar_history": sql(TICKS, GAPS, BARS, select=f"SELECT symbol, timeframe, bar_start_ms, bar_end_ms, {rounded(*_OHLC)}, tick_count FROM bars WHERE bar_start_ms >= {FROM} AND bar_start_ms < {TO}"),
        "bar_manifest": sql(
            TICKS, GAPS, BARS,
            select=f"SELECT symbol, timeframe, count(DISTINCT bar_start_ms < {fx.START + 15 * DAY}) AS files, count(*) AS rows, count(*) FILTER ({UNUSABLE}) AS unusable, min(bar_start_ms) AS start_ms, max(bar_end_ms) AS end_ms, true AS sized, 64 AS digest_length FROM bars GROUP BY ALL",
        ),
        "signed_bar_report": f"SELECT *, true AS intact FROM ({studied['bar_report']})",
        "candidate_import": sql(
            *CORE,
            select=f"SELECT candidate_id, symbol, direction, {rounded('entry', 'stop_loss', digits=9)}, available_ms, CASE WHEN long THEN 3600000 ELSE 5400000 END::BIGINT AS max_holding_ms, CASE WHEN long THEN 0.005{D} ELSE 0.01{D} END AS risk_fraction, CASE WHEN regime = 'BULL' THEN symbol ELSE 'EUR_USD' END AS pair, 'BASE' AS timeframe FROM ideas",
        ),
        "calendar_import": sql(
            TICKS, FIRST,
            select=f"""SELECT symbol AS snapshot_id, {fx.START}::BIGINT AS as_of_ms, CASE WHEN {weekday('time_ms')} >= 5 THEN 'weekend' ELSE 'desk' END AS source, seq::VARCHAR AS event_id, symbol AS event_code, symbol || ' ' || day AS name,
  'USD' AS currency, time_ms AS scheduled_ms, CASE WHEN {weekday('time_ms')} >= 5 THEN 'LOW' ELSE 'HIGH' END AS impact FROM first_""",
        ),
        "ledger_import": sql(TICKS, CHUNKS, select="SELECT symbol, chunk_start_ms, ledger_end_ms AS chunk_end_ms, ledger_ticks AS tick_count, ledger_status AS status FROM ledger"),
        "resumed_ingest": sql(
            TICKS, CHUNKS, quality("ticks"), SOUND, INGEST,
            select=f"SELECT symbol, chunk_start_ms, n AS tick_count, CASE WHEN n > 0 THEN 'COMPLETED' WHEN {inside('chunk_start_ms', 'chunk_end_ms')} THEN 'EXPECTED_MARKET_CLOSED' ELSE 'NO_BROKER_HISTORY' END AS status, n AS file_ticks FROM wanted",
        ),
        "chunk_verdicts": sql(
            TICKS, FAULTY, FAULTS,
            select=f"""SELECT symbol, chunk_start_ms, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("tick_count", "out_of_order", "equal_times", "duplicates", "crossed", "nonpositive", "gaps"))}, round(spread_median, 6) AS spread_median,
  array_to_string(list_filter([{_HARD}], lambda x: x IS NOT NULL), ',') AS hard_failures, coalesce(out_of_order + crossed + nonpositive = 0, false) AS valid FROM days LEFT JOIN judged USING (symbol, chunk_start_ms)""",
        ),
        "repeated_ingest": sql(TICKS, CHUNKS, RUNS, select="SELECT * FROM left_over"),
        "ingest_coverage": sql(
            TICKS, CHUNKS, RUNS,
            """s AS (SELECT symbol, count(*) AS expected, count(*) FILTER (chunk_status = 'COMPLETED') AS completed, count(*) FILTER (chunk_status = 'EXPECTED_MARKET_CLOSED') AS closed, count(*) FILTER (chunk_status LIKE 'MISSING%') AS missing,
  count(*) FILTER (chunk_status LIKE '%_MISMATCH') AS mismatches FROM left_over GROUP BY symbol)""",
            select=f"SELECT *, round(100{D} * (completed + closed) / expected, 6) AS percent, CASE WHEN missing + mismatches > 0 THEN 'FAIL' ELSE 'PASS' END AS severity FROM s",
        ),
        "resumed_guard": sequence_sql()["changepoint_guard"],
        "experiment_results": sql(*_STUDY, select="SELECT family, candidate_id, policy, scenario, outcome, round(net_r, 6) AS net_r FROM facts WHERE policy = 'FIXED_RR' AND scenario = 'BASELINE_1X'"),
        "family_summaries": sql(*_STUDY, METRICS, select="SELECT family, policy, scenario, net_expectancy_r, trades FROM metrics"),
        "best_family": sql(*_STUDY, METRICS, select="SELECT family, policy, scenario, net_expectancy_r AS score FROM metrics WHERE policy = 'FIXED_RR' AND scenario = 'BASELINE_1X' ORDER BY score DESC, family LIMIT 1"),
        "nested_study": f"SELECT event, period || ':' || horizon AS slot, n, median_pips FROM ({studied['session_event_study']})",
    }
