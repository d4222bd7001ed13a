"""DuckDB SQL for the study of candidate families and for verdicts on feeds and observations."""

from __future__ import annotations

from ..operators.labels import POLICIES
from ..schemas import HOUR
from . import fixture as fx
from .oracle import _BOOT, _GEO, _PERF, BASE, FULL, GAPS, INDEXED, TICKS, D, _n, folds, perf, quality, rounded, sql, weekday
from .oracle_sequences import OBSERVED

FAMILIES = f"""
tests AS (
  SELECT *, list_filter([
    'BASELINE_MOMENTUM',
    CASE WHEN (regime = 'BULL') = long THEN 'TREND_PULLBACK' END,
    CASE WHEN CASE WHEN long THEN bid_low < past_low AND bid_close > bid_open ELSE ask_high > past_high AND ask_close < ask_open END THEN 'SWEEP_REVERSAL' END,
    CASE WHEN bar_no > {fx.LOOKBACK} AND rng >= 1.5{D} * past_mean THEN 'RANGE_EXPANSION' END], lambda x: x IS NOT NULL) AS named FROM ideas),
members AS (SELECT *, unnest(named) AS family FROM tests)"""
#: Events of a family and symbol are numbered on their own, so both are the name of the series.
EVENTS = f"events_ AS (SELECT family || '/' || symbol AS symbol, family || ':' || candidate_id AS event_id, available_ms AS start_ms, available_ms + {fx.HORIZON * HOUR} AS label_end_ms FROM members)"
FACTS = f"""
validated AS (SELECT m.family, m.candidate_id, f.event_id FROM folds f JOIN members m ON f.event_id = m.family || ':' || m.candidate_id AND f.role = 'VALIDATION'),
facts AS (SELECT o.* EXCLUDE (candidate_id, symbol), c.event_id AS candidate_id, c.family FROM validated c JOIN outcomes o USING (candidate_id)),
plain AS (SELECT *, family || '/' || policy || '/' || scenario AS symbol FROM facts),
pathless AS (SELECT family, count(*) AS no_path FROM validated WHERE event_id NOT IN (SELECT candidate_id FROM facts) GROUP BY family)"""
_STUDY = (*FULL, FAMILIES, EVENTS, INDEXED[INDEXED.index("indexed AS") :], "open_events AS (SELECT i.* FROM indexed i ANTI JOIN holdout h ON h.symbol = i.symbol AND h.event_id = i.event_id)", folds("open_events"), FACTS)
_ARM = "split_part(symbol, '/', 1) AS family, split_part(symbol, '/', 2) AS policy, split_part(symbol, '/', 3) AS scenario"
_BOUNDS = ", ".join(f"max(mean) FILTER (k = round_even({(fx.SAMPLES - 1) * q}{D}, 0)) AS {name}" for q, name in ((0.025, "lower_95"), (0.975, "upper_95")))
_DIMENSIONS = {"direction": "direction", "session": "session", "regime": "regime", "hour": f"(available_ms // {HOUR} % 24)::VARCHAR", "weekday": f"{weekday('available_ms')}::VARCHAR"}
_SLICES = " UNION ALL ".join(
    f"SELECT family, '{name}' AS dimension, {value} AS value, count(*) AS n, avg(gross_r) AS gross_ev_r, avg(net_r) AS net_ev_r, avg((net_r > 0)::INT) AS win_rate FROM one GROUP BY ALL" for name, value in _DIMENSIONS.items()
)
FAULTS = f"""
broken AS (
  SELECT symbol, rv_short, rv_long, spread_median, CASE WHEN ts_ms // {HOUR} % 5 = 1 THEN -1{D} ELSE spread_p95 END AS spread_p95, CASE WHEN ts_ms // {HOUR} % 5 = 2 THEN 'nan'{D} ELSE intensity END AS intensity, abs_return,
    CASE WHEN ts_ms // {HOUR} % 10 = 1 THEN 1.5{D} ELSE 0 END AS missing_ratio FROM observed),
marked AS (
  SELECT symbol, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) OR {c} < 0 THEN '{c.upper()}' END" for c in ("rv_short", "rv_long", "spread_median", "spread_p95", "intensity", "abs_return"))},
    CASE WHEN missing_ratio NOT BETWEEN 0 AND 1 THEN 'MISSING_RATIO' END], lambda x: x IS NOT NULL), ',') AS faults FROM broken)"""
VERDICTS = f"""
wanted AS (SELECT DISTINCT symbol FROM ticks UNION ALL SELECT 'absent'),
verdicts AS (SELECT w.symbol, coalesce(tick_count, 0) AS tick_count, coalesce(duplicates, 0) AS duplicates, coalesce(gaps, 0) AS gaps, list_filter([
  CASE WHEN tick_count IS NULL THEN 'EMPTY' END, CASE WHEN out_of_order > 0 THEN 'OUT_OF_ORDER_TICKS' END, CASE WHEN crossed > 0 THEN 'CROSSED_QUOTES' END, CASE WHEN nonpositive > 0 THEN 'NONPOSITIVE_QUOTES' END], lambda x: x IS NOT NULL) AS fs
  FROM wanted w LEFT JOIN q USING (symbol))"""


ONE = "one AS (SELECT * FROM facts WHERE policy = 'FIXED_RR' AND scenario = 'BASELINE_1X')"
CORRELATED = """
explained AS (SELECT o.family, o.gross_r, unnest(['past_median', 'impulse']) AS feature, unnest([i.past_median, i.impulse]) AS x FROM one o JOIN validated v ON v.event_id = o.candidate_id JOIN ideas i ON i.candidate_id = v.candidate_id),
correlated AS (SELECT family, feature, count(*) AS n, round(CASE WHEN stddev_pop(x) = 0 OR stddev_pop(gross_r) = 0 THEN 0 ELSE corr(x, gross_r) END, 6) AS correlation FROM explained GROUP BY ALL HAVING count(*) > 2)"""
_FIRSTS = ", ".join(f"min(pos) FILTER (fav >= {t}{D}) AS t{_n(t)}, min(pos) FILTER (fav >= {t}{D} AND adv <= -1) AS a{_n(t)}" for t in _GEO)
_HITS = ", ".join(f"round(avg(coalesce(t{_n(t)} < s, false)::INT), 6) AS hit_{_n(t)}r" for t in _GEO)
_UNCLEAR = " + ".join(f"(a{_n(t)} IS NOT NULL AND NOT coalesce(t{_n(t)} < s, false))::INT" for t in _GEO)
GEOMETRY = f"""
family_firsts AS (SELECT v.family, v.event_id, coalesce(min(pos) FILTER (adv <= -1), 1 << 30) AS s, {_FIRSTS} FROM path JOIN validated v USING (candidate_id) GROUP BY ALL),
shapes AS (SELECT family, count(*) AS paths, {_HITS}, round(sum({_UNCLEAR}) / (count(*) * {fx.HORIZON}{D}), 6) AS ambiguity_rate FROM family_firsts GROUP BY family)"""


SELECTED = f"""
policy_rows AS (SELECT *, list_position({list(POLICIES)}, policy) AS place FROM outcomes WHERE scenario = 'BASELINE_1X'),
in_training AS (SELECT f.symbol, f.fold_id, policy, place, count(*) AS train_n, avg(net_r) AS train_ev_r FROM folds f JOIN policy_rows o ON o.candidate_id = f.event_id AND f.role = 'TRAIN' GROUP BY ALL),
favoured AS (SELECT * FROM in_training QUALIFY row_number() OVER (PARTITION BY symbol, fold_id ORDER BY round(train_ev_r, 9) DESC, place) = 1),
out_of_sample AS (SELECT o.* EXCLUDE (place), f.fold_id FROM folds f JOIN favoured c ON c.symbol = f.symbol AND c.fold_id = f.fold_id AND f.role = 'VALIDATION' JOIN policy_rows o ON o.candidate_id = f.event_id AND o.policy = c.policy)"""
_OPEN = (*FULL, INDEXED, "open_events AS (SELECT i.* FROM indexed i ANTI JOIN holdout h ON h.symbol = i.symbol AND h.event_id = i.event_id)", folds("open_events"), SELECTED)


def study_sql() -> dict[str, str]:
    return {
        "family_study": sql(
            *_STUDY, perf("plain", "symbol"), _BOOT, f"bounds_ AS (SELECT symbol, {_BOUNDS} FROM ranked GROUP BY symbol)", f"arms AS (SELECT *, {_ARM} FROM perf)",
            select=f"SELECT family, policy, scenario, trades, coalesce(no_path, 0) AS no_path, {rounded('expectancy_r', 'win_rate', 'max_drawdown_r', 'gross_ev_r', 'cost_drag_r', 'lower_95', 'upper_95')}, longest AS longest_losing_run FROM arms JOIN runs USING (symbol) JOIN bounds_ USING (symbol) LEFT JOIN pathless USING (family)",
        ),
        "failure_slices": sql(
            *_STUDY, "one AS (SELECT * FROM facts WHERE policy = 'FIXED_RR' AND scenario = 'BASELINE_1X')", f"cut AS ({_SLICES})",
            select=f"SELECT family, dimension, value, n, {rounded('gross_ev_r', 'net_ev_r', 'win_rate')} FROM cut",
        ),
        "failure_correlations": sql(*_STUDY, ONE, CORRELATED, select="SELECT family, feature, n, correlation FROM correlated"),
        "failure_geometry": sql(*_STUDY, GEOMETRY, select="SELECT * FROM shapes"),
        "failure_report": sql(
            *_STUDY, ONE, CORRELATED, GEOMETRY, f"cut AS ({_SLICES})",
            select="""SELECT family, oos_trades, paths, hit_1_0r AS hit_1r, ambiguity_rate, correlation AS impulse_correlation, slices
  FROM (SELECT family, count(*) AS oos_trades FROM one GROUP BY family) JOIN shapes USING (family) LEFT JOIN (SELECT * FROM correlated WHERE feature = 'impulse') USING (family) LEFT JOIN (SELECT family, count(*) AS slices FROM cut GROUP BY family) USING (family)""",
        ),
        "research_report": sql(
            *_STUDY, perf("plain", "symbol"), _BOOT, f"bounds_ AS (SELECT symbol, {_BOUNDS} FROM ranked GROUP BY symbol)", f"arms AS (SELECT *, {_ARM} FROM perf)",
            "stressed AS (SELECT family, policy, scenario, avg(net_r) AS stress_ev_r FROM facts WHERE scenario <> 'BASELINE_1X' GROUP BY ALL)",
            "fragile AS (SELECT family, policy, stress_ev_r <= 0 AS execution_fragile FROM stressed WHERE scenario = 'BASELINE_1.25X')",
            select=f"""SELECT family, policy, trades, {rounded('expectancy_r', 'lower_95', 'upper_95', 'gross_ev_r', 'win_rate', 'max_drawdown_r', 'trades_per_week')}, longest AS longest_losing_run, execution_fragile, s.scenario, round(stress_ev_r, 6) AS stress_ev_r
  FROM (SELECT * EXCLUDE (scenario) FROM arms WHERE scenario = 'BASELINE_1X') JOIN runs USING (symbol) JOIN bounds_ USING (symbol) JOIN stressed s USING (family, policy) JOIN fragile USING (family, policy)""",
        ),
        "selected_policies": sql(
            *_OPEN,
            select=f"SELECT c.symbol, c.fold_id, c.policy, train_n, {rounded('train_ev_r')}, coalesce(valid_n, 0) AS valid_n, round(valid_ev_r, 6) AS valid_ev_r FROM favoured c LEFT JOIN (SELECT symbol, fold_id, count(*) AS valid_n, avg(net_r) AS valid_ev_r FROM out_of_sample GROUP BY ALL) v ON v.symbol = c.symbol AND v.fold_id = c.fold_id",
        ),
        "selected_arm": sql(*_OPEN, perf("out_of_sample", "symbol"), select=f"SELECT symbol, trades, {rounded(*_PERF)}, longest AS longest_losing_run FROM perf JOIN runs USING (symbol)"),
        "hypothesis_registry": sql(*_STUDY, select=f"SELECT family, sha256('{fx.STUDY}') AS config_sha256, 'REJECTED' AS status FROM facts GROUP BY family"),
        "observation_quarantine": sql(TICKS, GAPS, BASE, OBSERVED, FAULTS, select="SELECT symbol, faults, count(*) AS rows FROM marked GROUP BY ALL"),
        "feed_verdicts": sql(TICKS, quality("ticks"), VERDICTS, select="SELECT symbol, tick_count, duplicates, gaps, array_to_string(fs, ',') AS hard_failures, len(fs) = 0 AS valid FROM verdicts"),
    }
