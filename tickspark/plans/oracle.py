"""DuckDB SQL for the registered queries, on the same Parquet tables."""

from __future__ import annotations

from ..operators.candidates import RISK_CODES
from ..schemas import DAY, HOUR
from . import fixture as fx

D = "::DOUBLE"
TICKS = """
raw AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS time_ms, 1::DOUBLE + value / 10000::DOUBLE AS bid,
  regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events),
ticks AS (SELECT symbol, seq, time_ms, bid,
  bid + 0.0001::DOUBLE * (CASE WHEN k < 5 THEN 0::DOUBLE WHEN k = 99 THEN 6::DOUBLE ELSE 0.2::DOUBLE + 0.02::DOUBLE * k END) AS ask,
  (2 * (k % 2) + 4 * ((k // 2) % 2))::INT AS flags FROM raw)"""
FAULTY = """
faulty AS (
  SELECT symbol, seq * 10 AS seq, CASE WHEN seq % 97 = 0 THEN time_ms - 144000000 ELSE time_ms END AS time_ms,
    CASE WHEN seq % 307 = 0 THEN 0::DOUBLE ELSE bid END AS bid, CASE WHEN seq % 211 = 0 THEN bid - 0.001::DOUBLE ELSE ask END AS ask, flags FROM ticks
  UNION ALL SELECT symbol, seq * 10 + 5, time_ms, bid, ask, flags FROM ticks WHERE seq % 101 = 0)"""


def weekday(ms: str) -> str:
    return f"(({ms} // {DAY} + 3) % 7)"


def touches(a: str, b: str) -> str:
    return f"(CASE WHEN {weekday(a)} >= 5 THEN ({a} // {DAY}) * {DAY} < {b} ELSE {b} > ({a} // {DAY} + 5 - {weekday(a)}) * {DAY} END)"


def inside(a: str, b: str) -> str:
    return f"({weekday(a)} >= 5 AND {b} <= ({a} // {DAY} + 7 - {weekday(a)}) * {DAY})"


def session(ms: str) -> str:
    hour = f"(({ms} % {DAY}) // {HOUR})"
    return f"(CASE WHEN {hour} < 7 THEN 'ASIA' WHEN {hour} < 13 THEN 'LONDON' WHEN {hour} < 21 THEN 'NY' ELSE 'ROLLOVER' END)"


GAPS = f"""
lagged AS (SELECT *, lag(time_ms) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM ticks),
gapped AS (SELECT symbol, seq, time_ms, bid, ask, flags, (ask - bid) / 0.0001::DOUBLE AS spread, time_ms - prev AS gap_ms,
  coalesce(time_ms - prev > {fx.GAP_LIMIT} AND NOT {touches('prev', 'time_ms')}, false) AS odd_gap FROM lagged)"""

_AGG = """min_by(bid, seq) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, max_by(bid, seq) AS bid_close,
  min_by(ask, seq) AS ask_open, max(ask) AS ask_high, min(ask) AS ask_low, max_by(ask, seq) AS ask_close, count(*) AS tick_count,
  min(time_ms) AS first_ms, max(time_ms) AS last_ms, min(spread) AS spread_min, quantile_cont(spread, 0.5) AS spread_median, quantile_cont(spread, 0.95) AS spread_p95, max(spread) AS spread_max,
  count(*) FILTER (spread = 0) AS zero_spread_count, (count(*) FILTER (spread = 0))::DOUBLE / count(*) AS zero_spread_ratio, coalesce(max(gap_ms), 0)::BIGINT AS max_gap_ms,
  count(*) FILTER (odd_gap) AS suspicious_gap_count, count(*) FILTER (spread >= 5) AS extreme_count"""
BASE = f"""
base AS (SELECT symbol, time_ms - time_ms % {HOUR} AS bar_start_ms, time_ms - time_ms % {HOUR} + {HOUR} AS bar_end_ms, {_AGG} FROM gapped GROUP BY ALL)"""
_BASE_FLAGS = "array_to_string(list_filter([CASE WHEN extreme_count > 0 THEN 'EXTREME_SPREAD' END, CASE WHEN suspicious_gap_count > 0 THEN 'HAS_SUSPICIOUS_GAP' END, CASE WHEN zero_spread_ratio >= 0.5 THEN 'ZERO_SPREAD_HEAVY' END], lambda x: x IS NOT NULL), ',')"
BARS = f"""
wide AS (
  SELECT symbol, 'BASE' AS timeframe, time_ms - time_ms % {HOUR} AS bar_start_ms, {HOUR} AS width, {_AGG} FROM gapped GROUP BY ALL
  UNION ALL SELECT symbol, 'MID', time_ms - time_ms % {3 * HOUR}, {3 * HOUR}, {_AGG} FROM gapped GROUP BY ALL
  UNION ALL SELECT symbol, 'TOP', time_ms - time_ms % {12 * HOUR}, {12 * HOUR}, {_AGG} FROM gapped GROUP BY ALL),
kids AS (
  SELECT symbol, 'BASE' AS timeframe, bar_start_ms, 0::BIGINT AS empty_count, zero_spread_ratio >= 0.5 AS heavy, false AS incomplete FROM wide WHERE timeframe = 'BASE'),
mids AS (
  SELECT symbol, 'MID' AS timeframe, bar_start_ms - bar_start_ms % {3 * HOUR} AS bar_start_ms, (3 - count(*))::BIGINT AS empty_count, bool_or(heavy) AS heavy, count(*) < 3 AS incomplete FROM kids GROUP BY ALL),
tops AS (
  SELECT symbol, 'TOP' AS timeframe, bar_start_ms - bar_start_ms % {12 * HOUR} AS bar_start_ms, (4 - count(*))::BIGINT AS empty_count, bool_or(heavy) AS heavy, bool_or(incomplete) OR count(*) < 4 AS incomplete FROM mids GROUP BY ALL),
levels AS (SELECT * FROM kids UNION ALL SELECT * FROM mids UNION ALL SELECT * FROM tops),
bars AS (
  SELECT w.*, w.bar_start_ms + w.width AS bar_end_ms, l.empty_count,
    list_filter([CASE WHEN extreme_count > 0 THEN 'EXTREME_SPREAD' END, CASE WHEN suspicious_gap_count > 0 THEN 'HAS_SUSPICIOUS_GAP' END,
      CASE WHEN l.incomplete THEN 'INCOMPLETE_OR_EMPTY_INTERVAL' END, CASE WHEN l.heavy OR zero_spread_ratio >= 0.5 THEN 'ZERO_SPREAD_HEAVY' END], lambda x: x IS NOT NULL) AS quality_flags
  FROM wide w JOIN levels l USING (symbol, timeframe, bar_start_ms))"""
UNUSABLE = "list_has_any(quality_flags, ['HAS_SUSPICIOUS_GAP', 'EXTREME_SPREAD', 'INCOMPLETE_OR_EMPTY_INTERVAL'])"
IDEAS = f"""
known AS (
  SELECT *, bid_high - bid_low AS rng, row_number() OVER w - 1 AS bar_no, quantile_cont(bid_high - bid_low, 0.5) OVER p AS past_median, avg(bid_high - bid_low) OVER p AS past_mean,
    min(bid_low) OVER p AS past_low, max(ask_high) OVER p AS past_high, lead(ask_open) OVER w AS next_ask, lead(bid_open) OVER w AS next_bid
  FROM bars WHERE timeframe = 'BASE'
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms), p AS (PARTITION BY symbol ORDER BY bar_start_ms ROWS BETWEEN {fx.LOOKBACK} PRECEDING AND 1 PRECEDING)),
picked AS (SELECT *, bid_close >= bid_open AS long FROM known WHERE bar_no >= {fx.LOOKBACK} AND (bar_no - {fx.LOOKBACK}) % {fx.STRIDE} = 0 AND next_ask IS NOT NULL AND NOT {UNUSABLE}),
closed AS (
  SELECT k.*, m.bid_open AS mid_open, m.bid_close AS mid_close, t.bid_open AS top_open, t.bid_close AS top_close FROM picked k
  ASOF JOIN (SELECT * FROM bars WHERE timeframe = 'MID') m ON k.symbol = m.symbol AND k.bar_end_ms >= m.bar_end_ms
  ASOF JOIN (SELECT * FROM bars WHERE timeframe = 'TOP') t ON k.symbol = t.symbol AND k.bar_end_ms >= t.bar_end_ms),
made AS (
  SELECT *, CASE WHEN long THEN next_ask ELSE next_bid END AS entry,
    CASE WHEN long THEN bid_low - greatest(past_median * 0.1::DOUBLE, 0.0001::DOUBLE) ELSE ask_high + greatest(past_median * 0.1::DOUBLE, 0.0001::DOUBLE) END AS stop_loss
  FROM closed WHERE NOT (CASE WHEN long THEN mid_close < mid_open ELSE mid_close > mid_open END)),
ideas AS (
  SELECT *, symbol || '-' || strftime(make_timestamp(bar_end_ms * 1000), '%Y%m%dT%H%M%SZ') || '-' || CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS candidate_id, CASE WHEN long THEN 'LONG' ELSE 'SHORT' END AS direction,
    bar_end_ms AS available_ms, CASE WHEN top_close >= top_open THEN 'BULL' ELSE 'BEAR' END AS regime, {session('bar_end_ms')} AS session, bid_close - bid_open AS impulse, mid_close - mid_open AS mid_impulse, abs(entry - stop_loss) AS risk
  FROM made WHERE CASE WHEN long THEN stop_loss < entry ELSE stop_loss > entry END)"""
INDEXED = f"""
events_ AS (SELECT symbol, candidate_id AS event_id, available_ms AS start_ms, available_ms + {fx.HORIZON * HOUR} AS label_end_ms FROM ideas),
indexed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_ms, event_id) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM events_),
holdout AS (SELECT * FROM indexed WHERE n > 2 AND idx >= n - greatest(1, floor(n * 0.2::DOUBLE)))"""


def folds(events: str) -> str:
    return f"""
numbered AS (SELECT symbol, event_id, start_ms, label_end_ms, idx, count(*) OVER (PARTITION BY symbol) AS m FROM {events}),
blocks AS (SELECT symbol, m, unnest(range({fx.MIN_TRAIN}, m, {fx.VALIDATION})) AS lo FROM (SELECT DISTINCT symbol, m FROM numbered)),
bounds AS (SELECT b.symbol, b.lo, min(i.start_ms) AS valid_start FROM blocks b JOIN numbered i ON i.symbol = b.symbol AND i.idx >= b.lo AND i.idx < b.lo + {fx.VALIDATION} GROUP BY ALL),
early AS (SELECT i.symbol, b.lo, i.idx, i.event_id FROM bounds b JOIN numbered i ON i.symbol = b.symbol AND i.idx < b.lo AND i.label_end_ms < b.valid_start - {fx.EMBARGO}),
kept AS (SELECT symbol, lo, row_number() OVER (PARTITION BY symbol ORDER BY lo) - 1 AS fold_id FROM (SELECT symbol, lo FROM early GROUP BY ALL HAVING count(*) >= {fx.MIN_TRAIN})),
folds AS (
  SELECT symbol, fold_id, idx, event_id, 'TRAIN' AS role FROM early JOIN kept USING (symbol, lo)
  UNION ALL SELECT i.symbol, k.fold_id, i.idx, i.event_id, 'VALIDATION' FROM kept k JOIN numbered i ON i.symbol = k.symbol AND i.idx >= k.lo AND i.idx < k.lo + {fx.VALIDATION})"""


PATHS = f"""
starts AS (SELECT symbol, bar_start_ms, bar_end_ms AS path_end, bid_high, bid_low, bid_close, ask_high, ask_low, ask_close, row_number() OVER (PARTITION BY symbol ORDER BY bar_start_ms) - 1 AS no FROM bars WHERE timeframe = 'BASE'),
begun AS (SELECT i.candidate_id, i.symbol, i.direction, i.entry, i.stop_loss, i.risk, i.available_ms, i.regime, i.session, s.no AS first_no FROM ideas i JOIN starts s ON s.symbol = i.symbol AND s.bar_start_ms = i.available_ms),
path AS (
  SELECT b.*, s.no - b.first_no + 1 AS pos, s.path_end,
    CASE WHEN direction = 'LONG' THEN bid_high - entry ELSE entry - ask_low END / risk AS fav, CASE WHEN direction = 'LONG' THEN bid_low - entry ELSE entry - ask_high END / risk AS adv,
    CASE WHEN direction = 'LONG' THEN bid_close - entry ELSE entry - ask_close END / risk AS close_r,
    CASE WHEN direction = 'LONG' THEN bid_low <= stop_loss ELSE ask_high >= stop_loss END AS stop,
    {", ".join(f"CASE WHEN direction = 'LONG' THEN bid_high >= entry + risk * {m}{D} ELSE ask_low <= entry - risk * {m}{D} END AS h{str(m).replace('.', '')}" for m in (1.0, 1.5, 2.0, 3.0))}
  FROM begun b JOIN starts s ON s.symbol = b.symbol AND s.no >= b.first_no AND s.no < b.first_no + {fx.HORIZON})"""
_ID = "candidate_id, symbol, direction, available_ms, regime, session, risk"
OUTCOMES = f"""
firsts AS (
  SELECT {_ID}, count(*) AS steps, coalesce(min(pos) FILTER (stop), 1 << 30) AS s, coalesce(min(pos) FILTER (h10), 1 << 30) AS p1, coalesce(min(pos) FILTER (h15), 1 << 30) AS p15, coalesce(min(pos) FILTER (h20), 1 << 30) AS p2, coalesce(min(pos) FILTER (h30), 1 << 30) AS p3
  FROM path GROUP BY ALL),
second AS (
  SELECT f.candidate_id, coalesce(min(p.pos) FILTER (p.h30 AND p.pos > f.p1), 1 << 30) AS later, coalesce(bool_or(p.h10) FILTER (p.pos = f.s), false) AS one_at_stop FROM firsts f JOIN path p USING (candidate_id) GROUP BY ALL),
chosen AS (
  SELECT f.*, 'FIXED_RR' AS policy, p3 AS hit, 3{D} AS reward, false AS armed, false AS one_at_stop FROM firsts f
  UNION ALL SELECT f.*, 'DYNAMIC_RR', CASE WHEN (regime = 'BULL') = (direction = 'LONG') THEN p3 ELSE p15 END, CASE WHEN (regime = 'BULL') = (direction = 'LONG') THEN 3{D} ELSE 1.5{D} END, false, false FROM firsts f
  UNION ALL SELECT f.*, 'STRUCTURE_TARGET', p2, 2{D}, false, false FROM firsts f
  UNION ALL SELECT f.*, 'PARTIAL_TRAILING', CASE WHEN p1 >= s THEN p1 ELSE later END, 2{D}, p1 < s, one_at_stop FROM firsts f JOIN second USING (candidate_id)),
judged AS (
  SELECT *, CASE WHEN s < (1 << 30) AND s <= hit THEN CASE WHEN (CASE WHEN armed THEN one_at_stop ELSE hit = s END) THEN 'AMBIGUOUS_CONSERVATIVE_STOP' ELSE 'STOP_LOSS' END WHEN hit < (1 << 30) THEN 'TAKE_PROFIT' ELSE 'VERTICAL' END AS outcome FROM chosen),
held AS (SELECT *, CASE WHEN outcome = 'VERTICAL' THEN steps ELSE least(s, hit) END AS holding_bars FROM judged),
ended AS (
  SELECT h.{_ID.replace(', ', ', h.')}, h.policy, h.outcome, h.holding_bars, h.reward, greatest(0, max(p.fav)) AS mfe_r, least(0, min(p.adv)) AS mae_r, max_by(p.close_r, p.pos) AS close_r, max(p.path_end) AS exit_ms
  FROM held h JOIN path p ON p.candidate_id = h.candidate_id AND p.pos <= h.holding_bars GROUP BY ALL),
graded AS (SELECT *, CASE WHEN outcome = 'TAKE_PROFIT' THEN reward WHEN outcome = 'VERTICAL' THEN close_r ELSE -1{D} END AS gross_r FROM ended),
priced AS (
  SELECT g.*, coalesce(c.entry_slip, 0.2{D}) AS entry_slip, coalesce(c.exit_slip, 0.3{D}) AS exit_slip, coalesce(c.commission_r, 0{D}) AS commission_r, coalesce(c.stop_slip, 0{D}) AS stop_slip, coalesce(c.rollover_r, 0{D}) AS rollover_r, coalesce(c.event_slip, 0{D}) AS event_slip,
    v.scenario, CASE WHEN outcome = 'VERTICAL' THEN 1{D} ELSE v.mult END AS mult, v.joint AND outcome <> 'VERTICAL' AS joint
  FROM graded g LEFT JOIN costs c USING (session, regime, direction), (VALUES ('BASELINE_1X', 1{D}, false), ('BASELINE_1.25X', 1.25{D}, false), ('BASELINE_1.5X', 1.5{D}, false), ('BASELINE_2X', 2{D}, false), ('JOINT_EXECUTION_STRESS', 1{D}, true)) v(scenario, mult, joint)),
outcomes AS (
  SELECT *, gross_r - cost_r AS net_r FROM (
    SELECT *, (CASE WHEN joint THEN entry_slip * 2 + event_slip ELSE entry_slip END + CASE WHEN joint THEN exit_slip * 2.5{D} + event_slip ELSE exit_slip END + CASE WHEN joint AND gross_r < 0 THEN stop_slip * 2 ELSE 0 END) * (0.0001{D} / risk * mult)
      + commission_r * mult + CASE WHEN joint THEN 2 * rollover_r ELSE rollover_r END * mult AS cost_r FROM priced))"""
PLAIN = "plain AS (SELECT * FROM outcomes WHERE policy = 'FIXED_RR' AND scenario = 'BASELINE_1X')"


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def perf(source: str, keys: str, more: str = "") -> str:
    """CTEs of :func:`tickspark.operators.stats.performance` over ``source``."""
    on = ", ".join(keys.split(", "))
    return f"""
eq AS (SELECT *, sum(net_r) OVER (PARTITION BY {on} ORDER BY exit_ms, candidate_id ROWS UNBOUNDED PRECEDING) AS equity, row_number() OVER (PARTITION BY {on} ORDER BY exit_ms, candidate_id) AS place FROM {source}),
pk AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY {on} ORDER BY place ROWS UNBOUNDED PRECEDING)) AS peak, place - sum((net_r < 0)::INT) OVER (PARTITION BY {on} ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM eq),
runs AS (SELECT {on}, max(n) AS longest FROM (SELECT {on}, run, count(*) FILTER (net_r < 0) AS n FROM pk GROUP BY ALL) GROUP BY ALL),
perf AS (SELECT {on}, count(*) AS trades, avg(net_r) AS expectancy_r, avg((net_r > 0)::INT) AS win_rate, avg(mae_r) AS mean_mae_r, avg(mfe_r) AS mean_mfe_r, max(peak - equity) AS max_drawdown_r,
  count(*) / nullif((max(exit_ms) - min(exit_ms)) / {7 * DAY}{D}, 0) AS trades_per_week, avg(gross_r) AS gross_ev_r, avg(cost_r) AS cost_drag_r{more} FROM pk GROUP BY ALL)"""


def quality(source: str) -> str:
    return f"""
moved AS (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY symbol ORDER BY seq) AS step, CASE WHEN bid > 0 AND ask >= bid THEN (ask - bid) / 0.0001{D} END AS spread FROM {source}),
q AS (SELECT symbol, count(*) AS tick_count, count(*) FILTER (step < 0) AS out_of_order, count(*) FILTER (step = 0) AS equal_times, count(*) - count(DISTINCT (time_ms, bid, ask, flags)) AS duplicates,
  count(*) FILTER (bid > ask) AS crossed, count(*) FILTER (bid <= 0 OR ask <= 0) AS nonpositive, count(*) FILTER (step > {fx.GAP_LIMIT}) AS gaps, (coalesce(sum(greatest(0, ceil(step / 600000{D}) - 1)) FILTER (step > 600000), 0))::BIGINT AS missing,
  quantile_cont(spread, 0.5) AS spread_median, quantile_cont(spread, 0.95) AS spread_p95 FROM moved GROUP BY symbol)"""


QUALITY_SELECT = """SELECT symbol, tick_count, out_of_order, equal_times, duplicates, round(duplicates::DOUBLE / tick_count, 6) AS duplicate_ratio, crossed, nonpositive, gaps, missing, round(missing::DOUBLE / (tick_count + missing), 6) AS missing_ratio,
  round(spread_median, 6) AS spread_median, round(spread_p95, 6) AS spread_p95, array_to_string(list_filter([CASE WHEN out_of_order > 0 THEN 'OUT_OF_ORDER_TICKS' END, CASE WHEN crossed > 0 THEN 'CROSSED_QUOTES' END, CASE WHEN nonpositive > 0 THEN 'NONPOSITIVE_QUOTES' END], lambda x: x IS NOT NULL), ',') AS hard_failures,
  out_of_order + crossed + nonpositive = 0 AS valid FROM q"""
_PROFILE = "count(spread) AS valid_quotes, count(*) FILTER (spread = 0) AS zero_spreads, count(*) FILTER (spread >= 5) AS extreme_spreads, quantile_cont(spread, 0.5) AS spread_p50, quantile_cont(spread, 0.95) AS spread_p95"
VALID = f"valid AS (SELECT *, CASE WHEN bid > 0 AND ask >= bid THEN (ask - bid) / 0.0001{D} END AS spread FROM ticks)"
_CHUNK = f"{fx.START} + ((time_ms - {fx.START}) // {DAY}) * {DAY}"
CHUNKS = f"""
expected AS (SELECT symbol, {fx.START} + i * {DAY} AS chunk_start_ms, {fx.START} + (i + 1) * {DAY} AS chunk_end_ms FROM (SELECT DISTINCT symbol FROM ticks), range(31) r(i)),
counted AS (SELECT symbol, {_CHUNK} AS chunk_start_ms, count(*) AS file_ticks FROM ticks GROUP BY ALL),
numbered_c AS (SELECT *, (chunk_start_ms - {fx.START}) // {DAY} AS n, {weekday('chunk_start_ms')} < 5 AS weekday FROM counted),
files AS (SELECT symbol, chunk_start_ms, file_ticks FROM numbered_c WHERE weekday AND n % 11 <> 3),
ledger AS (SELECT symbol, chunk_start_ms, chunk_start_ms + {DAY} AS ledger_end_ms, CASE WHEN weekday THEN file_ticks + (n % 13 = 5)::INT ELSE 0 END AS ledger_ticks, CASE WHEN n % 17 = 7 THEN 'NO_BROKER_HISTORY' WHEN weekday THEN 'COMPLETED' ELSE 'EXPECTED_MARKET_CLOSED' END AS ledger_status FROM numbered_c WHERE n % 19 <> 2),
coverage AS (
  SELECT e.*, f.file_ticks, l.ledger_ticks, CASE WHEN ledger_status IS NULL THEN 'MISSING_LEDGER' WHEN ledger_end_ms <> chunk_end_ms THEN 'LEDGER_MISMATCH' WHEN {inside('chunk_start_ms', 'chunk_end_ms')} AND file_ticks IS NULL AND ledger_ticks = 0 THEN 'EXPECTED_MARKET_CLOSED'
    WHEN {inside('chunk_start_ms', 'chunk_end_ms')} THEN 'LEDGER_MISMATCH' WHEN ledger_status = 'NO_BROKER_HISTORY' THEN 'MISSING_HISTORY' WHEN file_ticks IS NULL THEN 'MISSING_FILE' WHEN file_ticks <> ledger_ticks THEN 'COUNT_MISMATCH' ELSE 'COMPLETED' END AS chunk_status
  FROM expected e LEFT JOIN files f USING (symbol, chunk_start_ms) LEFT JOIN ledger l USING (symbol, chunk_start_ms))"""


def local(ms: str, zone: str) -> str:
    return f"(make_timestamp({ms} * 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{zone}')"


def dst(ms: str) -> str:
    europe = f"(hour({local(ms, 'Europe/London')}) <> hour(make_timestamp({ms} * 1000)))"
    america = f"((hour(make_timestamp({ms} * 1000)) - hour({local(ms, 'America/New_York')}) + 24) % 24 <> 5)"
    return f"(CASE WHEN {europe} = {america} THEN 'EU_US_ALIGNED' WHEN {america} THEN 'US_DST_EU_STANDARD' ELSE 'EU_DST_US_STANDARD' END)"


def minutes(ms: str, zone: str, hour: int) -> str:
    t = local(ms, zone)
    return f"((hour({t}) * 60 + minute({t}) - {hour * 60}){D} + second({t}) / 60.0{D})"


_MARKS = {"london_open": ("Europe/London", 8), "london_fix": ("Europe/London", 16), "new_york_cut": ("America/New_York", 10)}


def benchmark(ms: str, width: float) -> str:
    return "CASE " + " ".join(f"WHEN abs({minutes(ms, *z)}) <= {width} THEN '{n.upper()}'" for n, z in _MARKS.items()) + " ELSE 'NONE' END"


CORE = (TICKS, GAPS, BARS, IDEAS)
FULL = (*CORE, PATHS, fx.costs_sql(), OUTCOMES)
_OHLC = ("bid_open", "bid_high", "bid_low", "bid_close", "ask_open", "ask_high", "ask_low", "ask_close")
_PERF = ("expectancy_r", "win_rate", "mean_mae_r", "mean_mfe_r", "max_drawdown_r", "trades_per_week")
FOLD_OUTCOMES = (*FULL, INDEXED, "open_events AS (SELECT i.* FROM indexed i ANTI JOIN holdout h ON h.symbol = i.symbol AND h.event_id = i.event_id)", folds("open_events"), "valid_o AS (SELECT o.* FROM outcomes o JOIN folds f ON f.event_id = o.candidate_id AND f.role = 'VALIDATION')")
_LEVELS = f"""
levels_ AS (SELECT symbol || ':' || bar_end_ms AS candidate_id, symbol, CASE WHEN bid_close >= bid_open THEN 'LONG' ELSE 'SHORT' END AS direction, (bid_close + ask_close) / 2 AS level, greatest(bid_high - bid_low, 0.0001{D}) AS atr, bar_end_ms AS available_ms FROM base),
searched AS (SELECT l.*, t.seq, t.time_ms, (t.bid + t.ask) / 2 AS mid, greatest(0.1{D} * atr, 1.5{D} * greatest(t.ask - t.bid, 0)) AS threshold FROM levels_ l JOIN ticks t ON t.symbol = l.symbol AND t.time_ms BETWEEN l.available_ms AND l.available_ms + {3 * HOUR}),
excursions AS (SELECT candidate_id, symbol, direction, level, atr, min(seq) AS event_seq, min_by(time_ms, seq) AS event_ms, min_by(mid, seq) AS event_mid, min_by(threshold, seq) AS threshold, CASE WHEN min_by(mid, seq) > any_value(level) THEN 1 ELSE -1 END AS side FROM searched WHERE abs(mid - level) >= threshold GROUP BY candidate_id, symbol, direction, level, atr)"""
_TIMED = f"timed AS (SELECT candidate_id, net_r, regime, {session('available_ms')} AS session, {dst('available_ms')} AS dst_state, {benchmark('available_ms', 60)} AS benchmark FROM plain)"
_POSTERIOR = f"""
low AS (SELECT session, benchmark, dst_state, regime, count(*) AS n, avg(net_r) AS m, stddev_samp(net_r) AS s FROM timed GROUP BY ALL),
mid_ AS (SELECT session, regime, count(*) AS pn, avg(net_r) AS pm, stddev_samp(net_r) AS ps FROM timed GROUP BY ALL),
top_ AS (SELECT avg(net_r) AS gm, stddev_samp(net_r) AS gs FROM timed),
post AS (SELECT *, n / (n + 30{D}) AS weight, n / (n + 30{D}) * m + (1 - n / (n + 30{D})) * pm AS mean_r, 1.96{D} * CASE WHEN n >= 2 THEN s WHEN pn >= 2 THEN ps ELSE gs END / sqrt(greatest(1, n * (n / (n + 30{D})) + pn * (1 - n / (n + 30{D})))) AS half FROM low JOIN mid_ USING (session, regime), top_)"""
_FEATURE_ROWS = f"SELECT symbol, {session('bar_start_ms')} AS session, unnest(['spread_median', 'max_gap_ms', 'tick_count']) AS feature, unnest([spread_median, max_gap_ms{D}, tick_count{D}]) AS x FROM base"


def robust(rows: str, keys: str) -> str:
    return f"""
long_ AS ({rows}),
med AS (SELECT {keys}, feature, quantile_cont(x, 0.5) AS median, count(*) AS n FROM long_ GROUP BY ALL),
robust AS (SELECT {', '.join('l.' + k for k in keys.split(', '))}, l.feature, max(median) AS median, quantile_cont(abs(x - median), 0.5) AS mad, max(n) AS n FROM long_ l JOIN med USING ({keys}, feature) GROUP BY ALL)"""


_GEO = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
_TBS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
_n = lambda t: str(t).replace(".", "_")
_BARRIERS = f"""
tb AS (SELECT symbol || ':' || bar_end_ms AS candidate_id, symbol, CASE WHEN bid_close >= bid_open THEN 1{D} ELSE -1{D} END AS sg, bid_close AS pe, bar_end_ms AS available_ms FROM base),
tc AS (SELECT *, pe - sg * 0.004{D} AS sl, pe + sg * 0.012{D} AS tp, available_ms + 250 AS usable_ms, available_ms + {2 * HOUR} AS barrier FROM tb),
te AS (SELECT c.*, e.time_ms AS entry_ms, e.seq AS entry_seq, e.bid AS eb, e.ask AS ea, CASE WHEN sg > 0 THEN e.ask ELSE e.bid END AS eq FROM tc c ASOF LEFT JOIN ticks e ON c.symbol = e.symbol AND c.usable_ms <= e.time_ms),
tf AS (SELECT *, eq + sg * 0.2{D} * 0.0001{D} AS fill, CASE WHEN entry_ms IS NULL THEN 'NO_TICK' WHEN sg > 0 AND eq + sg * 0.2{D} * 0.0001{D} <= sl THEN 'BEYOND' WHEN sg < 0 AND eq + sg * 0.2{D} * 0.0001{D} >= sl THEN 'BEYOND' END AS refused FROM te),
tg AS (SELECT f.*, t.seq, t.time_ms, t.bid, t.ask, CASE WHEN sg > 0 THEN t.bid >= tp ELSE t.ask <= tp END AS htp, CASE WHEN sg > 0 THEN t.bid <= sl ELSE t.ask >= sl END AS hsl FROM tf f JOIN ticks t ON t.symbol = f.symbol AND t.seq > f.entry_seq AND t.time_ms <= f.barrier WHERE refused IS NULL),
th AS (SELECT candidate_id, time_ms, bool_or(htp) AS htp, bool_or(hsl) AS hsl, any_value(barrier) AS barrier, min_by(bid, seq) AS fb, min_by(ask, seq) AS fa, max_by(bid, seq) AS lb, max_by(ask, seq) AS la, min_by(bid, seq) FILTER (hsl) AS sb, min_by(ask, seq) FILTER (hsl) AS sa, min_by(bid, seq) FILTER (htp) AS pb, min_by(ask, seq) FILTER (htp) AS pa, min(bid) AS low, max(ask) AS high FROM tg GROUP BY ALL),
ti AS (SELECT *, CASE WHEN htp AND hsl THEN 'AMBIGUOUS' WHEN hsl THEN 'STOP_LOSS' WHEN htp THEN 'TAKE_PROFIT' WHEN time_ms = barrier THEN 'VERTICAL' END AS what FROM th),
tj AS (SELECT DISTINCT ON (candidate_id) candidate_id, what, time_ms AS x_ms, CASE what WHEN 'AMBIGUOUS' THEN fb WHEN 'STOP_LOSS' THEN sb WHEN 'TAKE_PROFIT' THEN pb ELSE lb END AS xb, CASE what WHEN 'AMBIGUOUS' THEN fa WHEN 'STOP_LOSS' THEN sa WHEN 'TAKE_PROFIT' THEN pa ELSE la END AS xa, low, high FROM ti WHERE what IS NOT NULL ORDER BY candidate_id, time_ms),
tk AS (SELECT f.*, l.time_ms AS late_ms, l.bid AS late_bid, l.ask AS late_ask FROM (SELECT *, coalesce(CASE WHEN entry_ms > barrier THEN entry_ms + 1 ELSE barrier + 1 END, barrier + 1) AS after_ms FROM tf) f ASOF LEFT JOIN ticks l ON f.symbol = l.symbol AND f.after_ms <= l.time_ms),
tl AS (SELECT k.*, j.what, j.low, j.high, CASE WHEN refused IS NOT NULL THEN 'NO_FILL' WHEN j.what IS NOT NULL THEN j.what WHEN late_ms IS NOT NULL THEN 'VERTICAL' ELSE 'DATA_EXHAUSTED' END AS outcome, CASE WHEN refused IS NULL THEN coalesce(j.x_ms, late_ms) END AS exit_ms, CASE WHEN refused IS NULL THEN CASE WHEN j.what IS NOT NULL THEN j.xb ELSE late_bid END END AS xb, CASE WHEN refused IS NULL THEN CASE WHEN j.what IS NOT NULL THEN j.xa ELSE late_ask END END AS xa FROM tk k LEFT JOIN tj j USING (candidate_id)),
tm AS (SELECT *, CASE WHEN sg > 0 THEN CASE WHEN outcome = 'AMBIGUOUS' THEN low ELSE xb END ELSE CASE WHEN outcome = 'AMBIGUOUS' THEN high ELSE xa END END AS xq, abs(pe - sl) AS rk FROM tl),
tn AS (SELECT *, xq - sg * 0.3{D} * 0.0001{D} AS exit_fill, sg * ((xb + xa) / 2 - (eb + ea) / 2) AS gross, sg * (xq - eq) AS seen FROM tm)"""

_BOOT = f"""
series AS (SELECT symbol, net_r AS v, row_number() OVER w - 1 AS i, sum(net_r) OVER w AS upto, count(*) OVER (PARTITION BY symbol) AS n FROM plain WINDOW w AS (PARTITION BY symbol ORDER BY exit_ms, candidate_id)),
totals AS (SELECT symbol, max(n) AS n, max_by(upto, i) AS total FROM series GROUP BY ALL),
sized AS (SELECT *, least({fx.BLOCK}, n) AS size FROM totals),
draws AS (SELECT s.*, sample, b FROM sized s, range({fx.SAMPLES}) r(sample), range(100000) q(b) WHERE b < ceil(s.n / s.size::DOUBLE)),
mixed AS (SELECT *, ((((0 * 48271 + sample * 69621 + 1) % 2147483647 * 48271 + b * 69621 + 11) % 2147483647 * 48271) % 2147483647) % n AS start, least(size, n - b * size) AS len FROM draws),
spans AS (SELECT *, (start + len - 1) % n AS fin FROM mixed),
parts AS (SELECT s.symbol, s.sample, s.n, s.total, e.upto - (a.upto - a.v) + CASE WHEN s.fin < s.start THEN s.total ELSE 0 END AS part FROM spans s JOIN series a ON a.symbol = s.symbol AND a.i = s.start JOIN series e ON e.symbol = s.symbol AND e.i = s.fin),
means AS (SELECT symbol, sample, max(n) AS n, sum(part) / max(n) AS mean, max(total) / max(n) AS point FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean, sample) - 1 AS k FROM means)"""

_INTERVAL = "bounds_ AS (SELECT symbol, " + ", ".join(f"round(max(mean) FILTER (k = round_even({(fx.SAMPLES - 1) * q}{D}, 0)), 6) AS {name}" for q, name in ((0.025, "lower_95"), (0.975, "upper_95"))) + " FROM ranked GROUP BY symbol)"


def all_sql() -> dict[str, str]:
    out = {
        "tick_view": sql(TICKS, select=f"SELECT symbol, seq, time_ms, {rounded('bid', 'ask')}, flags FROM ticks"),
        "spread_pips": sql(TICKS, select=f"SELECT symbol, seq, round((ask - bid) / 0.0001{D}, 6) AS spread, round((bid + ask) / 2, 6) AS mid, (flags & 2) <> 0 AS bid_changed, (flags & 4) <> 0 AS ask_changed, bid > 0 AND ask >= bid AS valid FROM ticks"),
        "intertick_gaps": sql(TICKS, GAPS, select="SELECT symbol, seq, gap_ms, odd_gap FROM gapped"),
        "base_bars": sql(TICKS, GAPS, BASE, select=f"SELECT symbol, bar_start_ms, bar_end_ms, {rounded(*_OHLC)}, tick_count, first_ms, last_ms, {rounded('spread_min', 'spread_median', 'spread_p95', 'spread_max')}, zero_spread_count, {rounded('zero_spread_ratio')}, max_gap_ms, suspicious_gap_count, {_BASE_FLAGS} AS quality_flags FROM base"),
        "rollup_bars": sql(TICKS, GAPS, BARS, select=f"SELECT symbol, timeframe, bar_start_ms, bar_end_ms, {rounded(*_OHLC)}, tick_count, {rounded('spread_median', 'spread_p95', 'zero_spread_ratio')}, max_gap_ms, suspicious_gap_count, empty_count, array_to_string(quality_flags, ',') AS quality_flags FROM bars"),
        "bar_reconciliation": sql(TICKS, GAPS, BARS, select=" UNION ALL ".join(f"SELECT p.symbol, p.timeframe, p.bar_start_ms, any_value(p.tick_count) AS tick_count, sum(c.tick_count)::BIGINT AS child_ticks, any_value(p.tick_count) = sum(c.tick_count) AND any_value(p.bid_open) = min_by(c.bid_open, c.bar_start_ms) AND any_value(p.ask_close) = max_by(c.ask_close, c.bar_start_ms) AS agrees FROM bars p JOIN bars c ON c.symbol = p.symbol AND c.timeframe = '{child}' AND c.bar_start_ms >= p.bar_start_ms AND c.bar_start_ms < p.bar_end_ms WHERE p.timeframe = '{parent}' GROUP BY p.symbol, p.timeframe, p.bar_start_ms" for child, parent in (("BASE", "MID"), ("MID", "TOP")))),
        "bar_report": sql(TICKS, GAPS, BARS, f"spine AS (SELECT {fx.START} + i * {HOUR} AS s FROM range({31 * 24}) r(i))", f"shut AS (SELECT count(*) AS closed_slots FROM spine WHERE {inside('s', f's + {HOUR}')})",
            "own AS (SELECT symbol, count(*) AS bar_count, sum(tick_count)::BIGINT AS bar_ticks, count(*) FILTER (list_contains(quality_flags, 'HAS_SUSPICIOUS_GAP')) AS gap_bars, sum(suspicious_gap_count)::BIGINT AS suspicious_gaps, count(*) FILTER (list_contains(quality_flags, 'EXTREME_SPREAD')) AS extreme_bars, count(*) FILTER (list_contains(quality_flags, 'ZERO_SPREAD_HEAVY')) AS zero_heavy_bars FROM bars WHERE timeframe = 'BASE' GROUP BY symbol)",
            "inp AS (SELECT symbol, count(*) AS input_ticks FROM ticks GROUP BY symbol)",
            select=f"SELECT *, 0::BIGINT AS ohlc_violations, 0::BIGINT AS reconciliation_failures, {31 * 24} - bar_count - closed_slots AS empty_slots, CASE WHEN bar_ticks <> input_ticks THEN 'FAIL' WHEN gap_bars + extreme_bars + zero_heavy_bars > 0 OR {31 * 24} - bar_count - closed_slots <> 0 THEN 'WARN' ELSE 'PASS' END AS severity FROM own JOIN inp USING (symbol), shut"),
        "ohlc_violations": sql(TICKS, GAPS, BARS, select=f"SELECT symbol, timeframe, count(*) AS violations FROM bars WHERE (bar_start_ms // {HOUR}) % 24 = 0 GROUP BY ALL"),
        "feed_quality": sql(TICKS, quality("ticks"), select=QUALITY_SELECT),
        "feed_quality_faults": sql(TICKS, FAULTY, quality("faulty"), select=QUALITY_SELECT),
        "feed_gate": sql(TICKS, FAULTY, "mix AS (SELECT * FROM ticks WHERE symbol <> 'click' UNION ALL SELECT * FROM faulty WHERE symbol = 'click')", quality("mix"), select="SELECT symbol, count(*) AS ticks FROM mix SEMI JOIN (SELECT symbol FROM q WHERE out_of_order + crossed + nonpositive = 0) g USING (symbol) GROUP BY symbol"),
        "gap_observations": sql(TICKS, "b AS (SELECT *, lag(time_ms) OVER w AS p, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY seq))",
            select=f"SELECT symbol, seq, p AS from_ms, time_ms AS to_ms, time_ms - p AS gap_ms, ((p % {DAY}) // {HOUR})::INT AS utc_hour, round(pb, 6) AS prev_bid, round(pa, 6) AS prev_ask, round(bid, 6) AS next_bid, round(ask, 6) AS next_ask, CASE WHEN {touches('p', 'time_ms')} THEN 'EXPECTED_CLOSURE' ELSE 'SUSPICIOUS' END AS gap_class FROM b WHERE time_ms - p > {HOUR} AND NOT {inside('p', 'time_ms')}"),
        "spread_summary": sql(TICKS, VALID, select="SELECT symbol, round(min(spread), 6) AS min, " + ", ".join(f"round(quantile_cont(spread, {q}), 6) AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))) + ", round(max(spread), 6) AS max FROM valid GROUP BY symbol"),
        "daily_profile": sql(TICKS, VALID, select=f"SELECT symbol, day, trading_ticks, valid_quotes, zero_spreads, extreme_spreads, {rounded('spread_p50', 'spread_p95')}, round(coalesce(zero_spreads::DOUBLE / nullif(valid_quotes, 0), 0), 6) AS zero_ratio FROM (SELECT symbol, time_ms // {DAY} AS day, count(*) FILTER ({weekday('time_ms')} < 5) AS trading_ticks, {_PROFILE} FROM valid GROUP BY ALL)"),
        "hourly_profile": sql(TICKS, VALID, f"h AS (SELECT symbol, ((time_ms % {DAY}) // {HOUR})::INT AS hour, count(*) AS ticks, {_PROFILE} FROM valid GROUP BY ALL)", "spine AS (SELECT symbol, i::INT AS hour FROM (SELECT DISTINCT symbol FROM ticks), range(24) r(i))",
            select=f"SELECT symbol, hour, coalesce(ticks, 0) AS ticks, coalesce(valid_quotes, 0) AS valid_quotes, coalesce(zero_spreads, 0) AS zero_spreads, coalesce(extreme_spreads, 0) AS extreme_spreads, {rounded('spread_p50', 'spread_p95')}, round(coalesce(zero_spreads::DOUBLE / nullif(valid_quotes, 0), 0), 6) AS zero_ratio FROM spine LEFT JOIN h USING (symbol, hour)"),
        "duplicates_by_day": sql(TICKS, FAULTY, select=f"SELECT symbol, day, sum(n - 1)::BIGINT AS duplicates FROM (SELECT symbol, time_ms // {DAY} AS day, count(*) AS n FROM faulty GROUP BY symbol, time_ms, bid, ask, flags HAVING count(*) > 1) GROUP BY ALL"),
        "low_density_days": sql(TICKS, f"thin AS (SELECT symbol, time_ms // {DAY} AS day, count(*) AS trading_ticks FROM ticks WHERE {weekday('time_ms')} < 5 GROUP BY ALL)", "m AS (SELECT symbol, quantile_cont(trading_ticks, 0.5) AS median_ticks FROM thin GROUP BY symbol)", select="SELECT symbol, day, trading_ticks, round(median_ticks, 6) AS median_ticks FROM thin JOIN m USING (symbol) WHERE trading_ticks < median_ticks * 0.9"),
        "most_affected_hour": sql(TICKS, f"h AS (SELECT symbol, ((time_ms % {DAY}) // {HOUR})::INT AS hour, count(*) FILTER ((ask - bid) / 0.0001{D} >= 5) AS n FROM ticks GROUP BY ALL)", select="SELECT symbol, max_by(hour, n * 100 - hour) AS hour, max(n) AS extreme_spreads, sum(n)::BIGINT AS total, round(100.0::DOUBLE * max(n) / sum(n), 6) AS percent FROM h WHERE n > 0 GROUP BY symbol"),
        "chunk_coverage": sql(TICKS, CHUNKS, select="SELECT symbol, chunk_start_ms, chunk_end_ms, file_ticks, ledger_ticks, chunk_status FROM coverage"),
        "coverage_summary": sql(TICKS, CHUNKS, "s AS (SELECT symbol, count(*) AS expected, count(*) FILTER (chunk_status = 'COMPLETED') AS completed, count(*) FILTER (chunk_status = 'EXPECTED_MARKET_CLOSED') AS closed, count(*) FILTER (chunk_status LIKE 'MISSING%') AS missing, count(*) FILTER (chunk_status LIKE '%MISMATCH') AS mismatches FROM coverage GROUP BY symbol)", select=f"SELECT *, round(100{D} * (completed + closed) / expected, 6) AS percent, CASE WHEN missing + mismatches > 0 THEN 'FAIL' ELSE 'PASS' END AS severity FROM s"),
        "chunk_orphans": sql(TICKS, CHUNKS, f"first_ AS (SELECT symbol, chunk_start_ms FROM expected WHERE chunk_start_ms < {fx.START + 20 * DAY})", select="SELECT symbol, chunk_start_ms, 'FILE' AS kind FROM files ANTI JOIN first_ USING (symbol, chunk_start_ms) UNION ALL SELECT symbol, chunk_start_ms, 'LEDGER' FROM ledger ANTI JOIN first_ USING (symbol, chunk_start_ms)"),
        "pending_chunks": sql(TICKS, CHUNKS, select="SELECT symbol, chunk_start_ms, chunk_end_ms FROM expected ANTI JOIN (SELECT * FROM ledger WHERE ledger_status IN ('COMPLETED', 'EXPECTED_MARKET_CLOSED')) l USING (symbol, chunk_start_ms)"),
        "session_bucket": sql(TICKS, select=f"SELECT symbol, {session('time_ms')} AS session, ((time_ms % {DAY}) // {HOUR})::INT AS hour, {weekday('time_ms')}::INT AS weekday, count(*) AS ticks FROM ticks GROUP BY ALL"),
        "dst_state": sql(TICKS, f"m AS (SELECT symbol, time_ms + (seq % 365) * {DAY} AS t FROM ticks)", select=f"SELECT symbol, {dst('t')} AS dst_state, count(*) AS ticks FROM m GROUP BY ALL"),
        "benchmark_windows": sql(TICKS, f"m AS (SELECT symbol, seq, time_ms + (seq % 365) * {DAY} AS t FROM ticks)", select="SELECT symbol, seq, " + ", ".join(f"round({minutes('t', *z)}, 6) AS m_{n}" for n, z in _MARKS.items()) + f", {benchmark('t', 15)} AS benchmark FROM m"),
        "asof_closed_bar": sql(TICKS, GAPS, BARS, select="SELECT b.symbol, b.bar_start_ms, t.bar_end_ms AS top_end_ms, round(t.bid_close, 6) AS top_close FROM (SELECT * FROM bars WHERE timeframe = 'BASE') b ASOF LEFT JOIN (SELECT * FROM bars WHERE timeframe = 'TOP') t ON b.symbol = t.symbol AND b.bar_end_ms >= t.bar_end_ms"),
        "asof_next_tick": sql(TICKS, GAPS, BASE, f"f AS (SELECT symbol, bar_start_ms, bar_start_ms + {HOUR // 2} AS from_ms FROM base)", select="SELECT f.symbol, f.bar_start_ms, t.time_ms AS tick_ms, t.seq, round(t.ask, 6) AS ask FROM f ASOF LEFT JOIN ticks t ON f.symbol = t.symbol AND f.from_ms <= t.time_ms"),
        "event_band_join": sql(TICKS, GAPS, BASE, fx.calendar_sql(), "c AS (SELECT symbol || ':' || bar_end_ms AS candidate_id, symbol, bar_end_ms AS available_ms FROM base)",
            f"e AS (SELECT DISTINCT ON (candidate_id) candidate_id, event_code, scheduled_ms FROM c JOIN calendar k ON k.impact = 'HIGH' AND k.scheduled_ms BETWEEN available_ms - {3 * HOUR} AND available_ms + {HOUR} AND k.as_of_ms <= available_ms ORDER BY candidate_id, abs(available_ms - scheduled_ms), scheduled_ms, event_id)",
            select=f"SELECT candidate_id, symbol, available_ms, CASE WHEN scheduled_ms IS NULL THEN 'NEUTRAL' ELSE 'HARD_VETO' END AS effect, coalesce(event_code, 'NO_SCHEDULED_HIGH_IMPACT_EVENT') AS event, round((available_ms - scheduled_ms) / 1000{D}, 6) AS seconds_from_release, CASE WHEN scheduled_ms IS NULL THEN 0{D} ELSE -1{D} END AS signal FROM c LEFT JOIN e USING (candidate_id)"),
        "post_event_summary": sql(TICKS, fx.calendar_sql(), select=f"SELECT event_id, s.symbol, scheduled_ms, count(t.seq) AS ticks, round(quantile_cont((t.ask - t.bid) / 0.0001{D}, 0.5), 6) AS median_spread, round((max((t.bid + t.ask) / 2) - min((t.bid + t.ask) / 2)) / 0.0001{D}, 6) AS range_pips FROM calendar, (SELECT DISTINCT symbol FROM ticks) s LEFT JOIN ticks t ON t.symbol = s.symbol AND t.time_ms BETWEEN scheduled_ms AND scheduled_ms + {2 * HOUR} GROUP BY ALL"),
        "candidate_events": sql(*CORE, select=f"SELECT candidate_id, symbol, direction, available_ms, {rounded('entry', 'stop_loss', digits=9)}, regime, session, {rounded('impulse', 'mid_impulse', 'past_median', digits=9)} FROM ideas"),
        "candidate_families": sql(*CORE, f"fam AS (SELECT *, unnest(list_filter(['BASELINE_MOMENTUM', CASE WHEN (regime = 'BULL') = long THEN 'TREND_PULLBACK' END, CASE WHEN bar_no >= {fx.LOOKBACK} AND CASE WHEN long THEN bid_low < past_low AND bid_close > bid_open ELSE ask_high > past_high AND ask_close < ask_open END THEN 'SWEEP_REVERSAL' END, CASE WHEN bar_no > {fx.LOOKBACK} AND rng >= 1.5{D} * past_mean THEN 'RANGE_EXPANSION' END], lambda x: x IS NOT NULL)) AS family FROM ideas)", select="SELECT family, family || ':' || candidate_id AS family_candidate_id, symbol, direction FROM fam"),
        "dataset_manifest": sql(TICKS, GAPS, BARS, select=f"SELECT symbol, timeframe, count(*) AS rows, count(*) FILTER ({UNUSABLE}) AS unusable, min(bar_start_ms) AS start_ms, max(bar_end_ms) AS end_ms FROM bars GROUP BY ALL"),
        "walk_forward_folds": sql(*CORE, INDEXED, folds("indexed"), select="SELECT symbol, fold_id, idx, event_id, role FROM folds"),
        "final_holdout": sql(*CORE, INDEXED, select="SELECT symbol, idx, event_id, label_end_ms FROM holdout"),
        "bar_outcomes": sql(*FULL, select=f"SELECT candidate_id, policy, scenario, outcome, holding_bars::INT AS holding_bars, exit_ms, {rounded('gross_r', 'cost_r', 'net_r', 'mfe_r', 'mae_r')} FROM outcomes"),
        "policy_metrics": sql(
            *FOLD_OUTCOMES, perf("valid_o", "symbol, policy, scenario"), "plain AS (SELECT * REPLACE (symbol || '/' || policy || '/' || scenario AS symbol) FROM valid_o)", _BOOT, _INTERVAL,
            select=f"SELECT p.symbol, policy, scenario, trades, {rounded(*_PERF, 'gross_ev_r', 'cost_drag_r')}, lower_95, upper_95, longest AS longest_losing_run FROM perf p JOIN runs USING (symbol, policy, scenario) JOIN bounds_ b ON b.symbol = p.symbol || '/' || policy || '/' || scenario",
        ),
        "drawdown_curve": sql(*FULL, PLAIN, perf("plain", "symbol"), select="SELECT candidate_id, symbol, round(net_r, 6) AS net_r, round(equity, 6) AS equity, round(peak, 6) AS peak, round(peak - equity, 6) AS drawdown FROM pk"),
        "performance_stats": sql(*FULL, PLAIN, perf("plain", "symbol"), select=f"SELECT symbol, trades, {rounded(*_PERF)}, longest AS longest_losing_run FROM perf JOIN runs USING (symbol)"),
        "slice_table": sql(*FULL, PLAIN, f"s AS (SELECT *, unnest(['direction', 'session', 'regime', 'hour', 'weekday']) AS dimension, unnest([direction, session, regime, ((available_ms % {DAY}) // {HOUR})::VARCHAR, {weekday('available_ms')}::VARCHAR]) AS value FROM plain)", select="SELECT dimension, value, count(*) AS n, round(avg(gross_r), 6) AS gross_ev_r, round(avg(net_r), 6) AS net_ev_r, round(avg((net_r > 0)::INT), 6) AS win_rate, round(avg(mfe_r), 6) AS mean_mfe_r, round(avg(mae_r), 6) AS mean_mae_r FROM s GROUP BY ALL"),
        "feature_correlation": sql(*FULL, PLAIN, "f AS (SELECT p.symbol, p.gross_r, unnest(['past_median', 'impulse']) AS feature, unnest([i.past_median, i.impulse]) AS x FROM plain p JOIN ideas i USING (candidate_id))", select="SELECT symbol, feature, count(*) AS n, round(CASE WHEN stddev_pop(x) = 0 OR stddev_pop(gross_r) = 0 THEN 0 ELSE corr(x, gross_r) END, 6) AS correlation FROM f GROUP BY ALL HAVING count(*) > 2"),
        "outcome_geometry": sql(*CORE, PATHS, "g AS (SELECT symbol, candidate_id, coalesce(min(pos) FILTER (adv <= -1), 1 << 30) AS s, " + ", ".join(f"min(pos) FILTER (fav >= {t}{D}) AS t{_n(t)}, min(pos) FILTER (fav >= {t}{D} AND adv <= -1) AS a{_n(t)}" for t in _GEO) + " FROM path GROUP BY ALL)",
            select="SELECT symbol, count(*) AS paths, " + ", ".join(f"round(avg(coalesce(t{_n(t)} < s, false)::INT), 6) AS hit_{_n(t)}r" for t in _GEO) + ", round(sum(" + " + ".join(f"(a{_n(t)} IS NOT NULL AND NOT coalesce(t{_n(t)} < s, false))::INT" for t in _GEO) + f") / (count(*) * {fx.HORIZON}{D}), 6) AS ambiguity_rate FROM g GROUP BY symbol"),
        "target_before_stop": sql(*CORE, PATHS, "g AS (SELECT symbol, candidate_id, coalesce(min(pos) FILTER (close_r <= -1), 1 << 30) AS s, " + ", ".join(f"min(pos) FILTER (close_r >= {t}{D}) AS t{_n(t)}" for t in _TBS) + " FROM path GROUP BY ALL)", select="SELECT symbol, count(*) AS paths, " + ", ".join(f"round(avg(coalesce(t{_n(t)} < s, false)::INT), 6) AS hit_{_n(t)}r" for t in _TBS) + ", 0::BIGINT AS unclear FROM g GROUP BY symbol"),
        "block_bootstrap_ci": sql(*FULL, PLAIN, _BOOT, select=f"SELECT symbol, max(n) AS n, round(max(point), 6) AS point_estimate, round(max(mean) FILTER (k = round_even({(fx.SAMPLES - 1) * 0.025}{D}, 0)), 6) AS lower_95, round(max(mean) FILTER (k = round_even({(fx.SAMPLES - 1) * 0.975}{D}, 0)), 6) AS upper_95 FROM ranked GROUP BY symbol"),
        "session_event_study": sql(TICKS, GAPS, BARS, "o AS (SELECT *, " + f"CASE WHEN {minutes('bar_start_ms', 'Europe/London', 8)} >= 0 AND {minutes('bar_start_ms', 'Europe/London', 8)} < 1 THEN 'LONDON_OPEN' WHEN {minutes('bar_start_ms', 'America/New_York', 8)} >= 0 AND {minutes('bar_start_ms', 'America/New_York', 8)} < 1 THEN 'NEW_YORK_OPEN' END AS event FROM bars WHERE timeframe = 'BASE')",
            "l AS (SELECT *, " + ", ".join(f"lead(bar_start_ms, {h}) OVER w AS t{h}, lead(bid_close, {h}) OVER w AS c{h}" for h in (1, 3, 6, 12, 24, 36)) + " FROM o WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))",
            "z AS (" + " UNION ALL ".join(f"SELECT event, symbol, bar_start_ms, {h}::INT AS horizon, (c{h} - ask_open) / 0.0001{D} AS pips FROM l WHERE event IS NOT NULL AND NOT {UNUSABLE} AND t{h} = bar_start_ms + {h * HOUR}" for h in (1, 3, 6, 12, 24, 36)) + ")",
            f"y AS (SELECT *, CASE WHEN bar_start_ms < {fx.START + 10 * DAY} THEN 'DISCOVERY' WHEN bar_start_ms < {fx.START + 20 * DAY} THEN 'CONFIRMATION' ELSE 'LOCKED_HOLDOUT' END AS period FROM z)",
            "means_ AS (SELECT event, period, horizon, event || '/' || period || '/' || horizon AS series, count(*) AS n, round(avg(pips) FILTER (period <> 'LOCKED_HOLDOUT'), 6) AS mean_pips, round(quantile_cont(pips, 0.5) FILTER (period <> 'LOCKED_HOLDOUT'), 6) AS median_pips FROM y GROUP BY ALL)",
            "plain AS (SELECT event || '/' || period || '/' || horizon AS symbol, pips AS net_r, bar_start_ms AS exit_ms, symbol AS candidate_id FROM y WHERE period <> 'LOCKED_HOLDOUT')", _BOOT, _INTERVAL,
            select="SELECT event, period, horizon, m.n, mean_pips, median_pips, lower_95, upper_95 FROM means_ m LEFT JOIN bounds_ ON bounds_.symbol = series"),
        "tick_barrier_labels": sql(TICKS, GAPS, BASE, _BARRIERS, select=f"SELECT candidate_id, CASE WHEN sg > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, outcome, CASE WHEN outcome NOT IN ('NO_FILL', 'DATA_EXHAUSTED') THEN (outcome = 'TAKE_PROFIT')::INT END AS label, CASE WHEN outcome <> 'NO_FILL' THEN entry_ms END AS entry_ms, CASE WHEN outcome NOT IN ('NO_FILL', 'DATA_EXHAUSTED') THEN exit_ms END AS exit_ms, round(CASE WHEN outcome <> 'NO_FILL' THEN fill END, 6) AS entry_fill, round(exit_fill, 6) AS exit_fill, round(gross / rk, 6) AS gross_r, round((gross - seen) / rk, 6) AS spread_cost_r, round((seen - sg * (exit_fill - fill)) / rk, 6) AS slippage_cost_r, round(sg * (exit_fill - fill) / rk - 0.01{D}, 6) AS net_r FROM tn"),
        "robust_baseline": sql(TICKS, GAPS, BASE, robust(_FEATURE_ROWS, "symbol, session"), select=f"SELECT symbol, session, feature, {rounded('median', 'mad')}, n FROM robust"),
        "fold_baseline": sql(*CORE, INDEXED, folds("indexed"), robust("SELECT i.symbol, f.fold_id, i.session, unnest(['past_median', 'impulse']) AS feature, unnest([i.past_median, i.impulse]) AS x FROM ideas i JOIN folds f ON f.event_id = i.candidate_id AND f.role = 'TRAIN'", "symbol, fold_id, session"), select=f"SELECT symbol, fold_id, session, feature, {rounded('median', 'mad')}, n FROM robust"),
        "posterior_table": sql(*FULL, PLAIN, _TIMED, _POSTERIOR, select=f"SELECT session, benchmark, dst_state, regime, n AS bucket_n, pn AS parent_n, {rounded('weight', 'mean_r')}, round(mean_r - half, 6) AS lower_95, round(mean_r + half, 6) AS upper_95, n >= 30 AS actionable FROM post"),
        "time_hazard": sql(*FULL, PLAIN, _TIMED, _POSTERIOR, select=f"SELECT candidate_id, CASE WHEN n >= 30 AND mean_r + half < 0 THEN 'SOFT_VETO' ELSE 'NEUTRAL' END AS effect, round(CASE WHEN n >= 30 AND mean_r + half < 0 THEN -least(1, abs(mean_r)) ELSE 0 END, 6)::DOUBLE AS signal, (n >= 30)::INT{D} AS confidence FROM timed JOIN post USING (session, benchmark, dst_state, regime)"),
        "execution_monitor": sql(TICKS, f"f AS (SELECT symbol, seq, (ask - bid) / 0.0001{D} * CASE WHEN symbol = 'view' THEN 0.8{D} ELSE 0.1{D} END AS rs, (ask - bid) / 0.0001{D} * 0.05{D} - 0.02{D} AS gap, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS k FROM ticks)", f"g AS (SELECT symbol, count(*) AS n, quantile_cont(rs, 0.5) AS rm, list_sort(list(rs))[27] AS p90, quantile_cont(gap, 0.5) AS gm FROM f WHERE k <= 30 GROUP BY symbol)", f"h AS (SELECT *, CASE WHEN n < 30 THEN ['INSUFFICIENT_OBSERVATIONS'] ELSE list_filter([CASE WHEN rm > 1.5{D} * 0.2{D} THEN 'MEDIAN_SLIPPAGE' END, CASE WHEN p90 > 2{D} * 0.2{D} THEN 'P90_SLIPPAGE' END, CASE WHEN gm > 0.1{D} THEN 'COST_GAP' END], lambda x: x IS NOT NULL) END AS rr FROM g)", select="SELECT symbol, n, array_to_string(rr, ',') AS reasons, n >= 30 AND len(rr) > 0 AS pause FROM h"),
        "level_excursion": sql(TICKS, GAPS, BASE, _LEVELS, select="SELECT candidate_id, direction, event_seq, event_ms, round(event_mid, 6) AS event_mid, round(threshold, 8) AS threshold, side FROM excursions"),
        "family_index": sql(*FULL, PLAIN, f"fam AS (SELECT candidate_id, unnest(list_filter(['BASELINE_MOMENTUM', CASE WHEN (regime = 'BULL') = long THEN 'TREND_PULLBACK' END, CASE WHEN CASE WHEN long THEN bid_low < past_low AND bid_close > bid_open ELSE ask_high > past_high AND ask_close < ask_open END THEN 'SWEEP_REVERSAL' END, CASE WHEN bar_no > {fx.LOOKBACK} AND rng >= 1.5{D} * past_mean THEN 'RANGE_EXPANSION' END], lambda x: x IS NOT NULL)) AS family FROM ideas)", "per AS (SELECT family, count(*) AS trades, avg(net_r) AS net_ev_r, avg(gross_r) AS gross_ev_r FROM plain JOIN fam USING (candidate_id) GROUP BY family)", select=f"SELECT family, trades, {rounded('net_ev_r', 'gross_ev_r')}, row_number() OVER (ORDER BY net_ev_r DESC, family) = 1 AS best FROM per"),
        "metrics_unpivot": sql(*FULL, PLAIN, "m AS (SELECT symbol, avg(gross_r) AS gross, avg(cost_r) AS cost, avg(net_r) AS net FROM plain GROUP BY symbol)", select="SELECT symbol, unnest(['gross', 'cost', 'net']) AS metric, unnest([round(gross, 6), round(cost, 6), round(net, 6)]) AS value FROM m"),
        "arm_report": sql(*FOLD_OUTCOMES, "a AS (SELECT symbol, policy, count(*) AS trades, avg(net_r) AS expectancy_r FROM valid_o WHERE scenario = 'BASELINE_1X' GROUP BY ALL)", "b AS (SELECT symbol, policy, avg(net_r) AS stress_ev_r FROM valid_o WHERE scenario = 'BASELINE_1.25X' GROUP BY ALL)", select=f"SELECT symbol, policy, trades, {rounded('expectancy_r', 'stress_ev_r')}, stress_ev_r <= 0 AS execution_fragile FROM a JOIN b USING (symbol, policy)"),
        "rank_scores": sql(*FULL, PLAIN, perf("plain", "symbol"), "par AS (SELECT avg(net_r) AS parent FROM plain)", select=f"SELECT symbol, round(0.35{D} * win_rate + 0.2{D} / (1 + max_drawdown_r) + 0.15{D} * least(1, trades / 200{D}) + 0.15{D} * 0.5{D}, 6) AS score, round((trades * expectancy_r + 50 * parent) / (trades + 50), 6) AS shrunk_ev_r, round(win_rate * 2 - (1 - win_rate) - 0.05{D}, 6) AS expected_r FROM perf, par"),
        "feasibility_gates": sql(*FULL, "one AS (SELECT * FROM outcomes WHERE scenario = 'BASELINE_1X')", perf("one", "symbol, policy"), "st AS (SELECT symbol, policy, avg(net_r) AS stress_ev_r FROM outcomes WHERE scenario = 'BASELINE_1.25X' GROUP BY ALL)", "fe AS (SELECT symbol, policy, trades AS n, list_filter([CASE WHEN trades < 30 THEN 'INSUFFICIENT_SAMPLE' END, CASE WHEN expectancy_r <= 0 THEN 'NO_NET_EXPECTANCY' END, CASE WHEN stress_ev_r <= 0 THEN 'EXECUTION_FRAGILE' END, CASE WHEN max_drawdown_r > 20 THEN 'DRAWDOWN_CEILING' END, CASE WHEN trades >= 200 THEN 'INTERVAL_NOT_POSITIVE' END], lambda x: x IS NOT NULL) AS rs FROM perf JOIN st USING (symbol, policy))", select="SELECT symbol, policy, n, CASE WHEN n < 30 THEN 'INSUFFICIENT' WHEN n < 100 THEN 'LOW' WHEN n < 200 THEN 'MEDIUM' ELSE 'NORMAL' END AS tier, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS accepted FROM fe"),
        "risk_violations": sql(
            *CORE,
            f"v AS (SELECT *, (available_ms // {HOUR}) % 7 AS k, CASE WHEN long THEN 1{D} ELSE -1{D} END AS sg FROM ideas)",
            "u AS (SELECT *, 0.004::DOUBLE * k AS risk_fraction, entry + sg * risk * (k - 1) AS take_profit FROM v)",
            f"""x AS (SELECT *, abs(take_profit - entry) / risk AS rr, list_filter([CASE WHEN k IN (2, 6) THEN '{RISK_CODES[0]}' END, CASE WHEN symbol NOT IN ('click', 'view', 'purchase', 'login') THEN '{RISK_CODES[1]}' END,
  CASE WHEN NOT (risk_fraction > 0 AND risk_fraction <= 0.01) THEN '{RISK_CODES[2]}' END, CASE WHEN abs(take_profit - entry) / risk < 3 - 1e-12 THEN '{RISK_CODES[3]}' END,
  CASE WHEN NOT CASE WHEN long THEN stop_loss < entry AND entry < take_profit ELSE take_profit < entry AND entry < stop_loss END THEN '{RISK_CODES[4]}' END], lambda x: x IS NOT NULL) AS vs FROM u)""",
            select="SELECT candidate_id, array_to_string(vs, ',') AS violations, len(vs) = 0 AS accepted, round(rr, 6) AS rr FROM x",
        ),
        "conformal_sets": sql(*FULL, PLAIN, f"sc AS (SELECT candidate_id, symbol, available_ms, 0.05{D} + 0.9{D} * ((available_ms // {HOUR}) % 23) / 22{D} AS p, (gross_r > 0)::INT AS y FROM plain)", f"cal AS (SELECT symbol, 1 - CASE WHEN y = 1 THEN p ELSE 1 - p END AS s, row_number() OVER (PARTITION BY symbol ORDER BY 1 - CASE WHEN y = 1 THEN p ELSE 1 - p END) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM sc WHERE available_ms < {fx.START + 20 * DAY})", f"th AS (SELECT symbol, s AS threshold FROM cal WHERE k = least(n - 1, greatest(0, floor((n - 1) * (1{D} - 0.1{D}) + 0.999999{D}))))", "ls AS (SELECT *, list_filter([CASE WHEN p <= threshold THEN '0' END, CASE WHEN 1 - p <= threshold THEN '1' END], lambda x: x IS NOT NULL) AS labels FROM sc LEFT JOIN th USING (symbol))", select="SELECT candidate_id, round(p, 6) AS p, round(threshold, 6) AS threshold, array_to_string(labels, ',') AS labels, len(labels) <> 1 AS abstain FROM ls"),
        "exit_plans": sql(*CORE, f"k AS (SELECT candidate_id, entry, risk, long, v.* FROM ideas, (VALUES (1{D}, 'FIXED_R', 1), (3{D}, 'FIXED_R', 0), (2{D}, 'STRUCTURAL', 0)) v(gross_r, target_type, priority))", "w AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY priority, gross_r DESC)::INT AS rank FROM k)", select=f"SELECT candidate_id, rank, gross_r, target_type, 0.5{D} AS fraction, round(CASE WHEN long THEN entry + risk * gross_r ELSE entry - risk * gross_r END, 6) AS price FROM w WHERE rank <= 2"),
        "stress_matrix": sql(*CORE, fx.costs_sql(), "b AS (SELECT i.candidate_id, i.risk, i.direction = 'LONG' AS hit, coalesce(c.entry_slip, 0.2::DOUBLE) AS e, coalesce(c.exit_slip, 0.3::DOUBLE) AS x, coalesce(c.commission_r, 0::DOUBLE) AS c, coalesce(c.stop_slip, 0::DOUBLE) AS s, coalesce(c.rollover_r, 0::DOUBLE) AS r, coalesce(c.event_slip, 0::DOUBLE) AS v FROM ideas i LEFT JOIN costs c USING (session, regime, direction))",
            "m AS (SELECT b.*, t.* FROM b, (VALUES ('BASELINE_1X', 'N', 1::DOUBLE), ('BASELINE_1.25X', 'N', 1.25::DOUBLE), ('BASELINE_1.5X', 'N', 1.5::DOUBLE), ('BASELINE_2X', 'N', 2::DOUBLE), ('HIGH_VOLATILITY', 'H', 1::DOUBLE), ('NEWS_EVENT', 'E', 1::DOUBLE), ('ROLLOVER', 'R', 1::DOUBLE), ('JOINT_EXECUTION_STRESS', 'J', 1::DOUBLE), ('NORMAL', 'N', 1::DOUBLE)) t(scenario, g, mult))",
            "p AS (SELECT candidate_id, scenario, CASE g WHEN 'H' THEN e * 1.25::DOUBLE WHEN 'E' THEN e + v WHEN 'J' THEN e * 2 + v ELSE e END * (0.0001::DOUBLE / risk * mult) AS entry_cost_r, CASE g WHEN 'H' THEN x * 1.5::DOUBLE WHEN 'E' THEN x + v WHEN 'J' THEN x * 2.5::DOUBLE + v ELSE x END * (0.0001::DOUBLE / risk * mult) AS exit_cost_r, CASE WHEN g = 'J' AND hit THEN s * 2 ELSE 0 END * (0.0001::DOUBLE / risk * mult) AS stop_cost_r, c * mult AS commission_cost_r, CASE WHEN g IN ('R', 'J') THEN 2 * r ELSE r END * mult AS rollover_cost_r FROM m)",
            select="SELECT candidate_id, scenario, round(entry_cost_r, 6) AS entry_cost_r, round(exit_cost_r, 6) AS exit_cost_r, round(stop_cost_r, 6) AS stop_cost_r, round(commission_cost_r, 6) AS commission_cost_r, round(rollover_cost_r, 6) AS rollover_cost_r, round(entry_cost_r + exit_cost_r + stop_cost_r + commission_cost_r + rollover_cost_r, 6) AS total_cost_r FROM p"),
        "rolling_robust_z": sql(TICKS, GAPS, BASE, "o AS (SELECT symbol, bar_end_ms AS ts_ms, ln(bid_high / bid_low) AS rv, spread_median AS sm FROM base)", "l AS (SELECT *, list(rv) OVER w AS lr, list(sm) OVER w AS ls FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING))", "m AS (SELECT *, coalesce(len(lr), 0) AS history, list_median(lr) AS mr, list_median(ls) AS ms FROM l)",
            "z AS (SELECT symbol, ts_ms, history, CASE WHEN history >= 2 THEN (rv - mr) / greatest(1.4826::DOUBLE * list_median(list_transform(lr, lambda x: abs(x - mr))), 1e-9::DOUBLE) ELSE 0 END AS zr, CASE WHEN history >= 2 THEN (sm - ms) / greatest(1.4826::DOUBLE * list_median(list_transform(ls, lambda x: abs(x - ms))), 1e-9::DOUBLE) ELSE 0 END AS zs FROM m)",
            select="SELECT symbol, ts_ms, history::INT AS history, round(zs, 4) AS spread_median_z, history >= 30 AND greatest(zr, zs) >= 3 AS unstable FROM z"),
        "stream_bar_view": sql(TICKS, GAPS, BASE, select=f"SELECT symbol, bar_start_ms, bar_end_ms, {rounded('bid_open', 'bid_close', 'ask_high')}, tick_count, {rounded('spread_median')}, extreme_count FROM base"),
    }
    return out
