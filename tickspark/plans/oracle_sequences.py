"""DuckDB SQL for queries over sequences: regimes, burst intensity, change points and what quotes do around a level.

Each is written from its definition, not from the way the Spark operator computes it: regimes as a recursion row by row, burst intensity
as sums over all earlier jumps, change points over sums of log densities of all stretches that end at a row.
"""

from __future__ import annotations

import math

from ..operators.sequence import CHUNK
from ..schemas import DAY, HOUR
from .oracle import _LEVELS, BASE, GAPS, TICKS, D, robust, rounded, session, sql

OBSERVED = f"""
observed AS (
  SELECT symbol, bar_end_ms AS ts_ms, row_number() OVER w - 1 AS i, ln(bid_high / bid_low) AS rv_short, avg(ln(bid_high / bid_low)) OVER (w ROWS 5 PRECEDING) AS rv_long,
    spread_median, spread_p95, tick_count / 60{D} AS intensity, abs((bid_close - bid_open) / 0.0001{D}) AS abs_return
  FROM base WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ms))"""


def _z(x: str) -> str:
    away = f"list_median(list_transform(l_{x}, lambda v: abs(v - m_{x})))"
    return f"CASE WHEN i >= 2 THEN ({x} - m_{x}) / greatest(1.4826{D} * {away}, 1e-9{D}) ELSE 0 END AS z_{x}"


REGIMES = f"""
listed AS (SELECT *, list(rv_short) OVER w AS l_rv_short, list(spread_median) OVER w AS l_spread_median FROM observed WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)),
middles AS (SELECT *, list_median(l_rv_short) AS m_rv_short, list_median(l_spread_median) AS m_spread_median FROM listed),
scores AS (SELECT symbol, ts_ms, i, {_z("rv_short")}, {_z("spread_median")} FROM middles),
proposals AS (SELECT *, CASE WHEN greatest(z_rv_short, z_spread_median) >= 2.5 THEN 'HIGH_STRESS' WHEN z_rv_short <= -1.5 THEN 'LOW_VOL' ELSE 'NORMAL' END AS p FROM scores),
stepped AS (
  SELECT DISTINCT symbol, -1::BIGINT AS i, NULL::BIGINT AS ts_ms, 'NORMAL' AS regime, 0 AS duration, NULL::VARCHAR AS pending, 0 AS seen FROM proposals
  UNION ALL
  SELECT n.symbol, n.i, n.ts_ms, CASE WHEN turns THEN p ELSE regime END, CASE WHEN turns THEN again ELSE duration + 1 END, CASE WHEN p = regime OR turns THEN NULL ELSE p END, CASE WHEN p = regime OR turns THEN 0 ELSE again END
  FROM (
    SELECT p.symbol, p.i, p.ts_ms, p.p, s.regime, s.duration, CASE WHEN s.pending = p.p THEN s.seen + 1 ELSE 1 END AS again,
      p.p <> s.regime AND CASE WHEN s.pending = p.p THEN s.seen + 1 ELSE 1 END >= 3 AS turns
    FROM stepped s JOIN proposals p ON p.symbol = s.symbol AND p.i = s.i + 1) n)"""

#: Parameters of the query: mu 0.25, alpha 1, beta 0.002 a second, at least 20 earlier ticks.
BURSTS = f"""
quotes AS (
  SELECT symbol, seq, time_ms, mid, time_ms // {DAY} AS day, seq // {CHUNK} AS run, coalesce(mid > lag(mid) OVER w, false)::INT AS rose, coalesce(mid < lag(mid) OVER w, false)::INT AS fell
  FROM (SELECT *, (bid + ask) / 2 AS mid FROM ticks) WINDOW w AS (PARTITION BY symbol, time_ms // {DAY}, seq // {CHUNK} ORDER BY seq)),
summed AS (
  SELECT q.symbol, q.seq, q.day, q.run, 0.25{D} + sum(j.rose * exp(-0.002{D} * (q.time_ms - j.time_ms) / 1000)) AS up, 0.25{D} + sum(j.fell * exp(-0.002{D} * (q.time_ms - j.time_ms) / 1000)) AS down
  FROM quotes q JOIN quotes j ON j.symbol = q.symbol AND j.day = q.day AND j.run = q.run AND j.seq <= q.seq GROUP BY ALL),
listed AS (SELECT *, up + down AS total, list(up + down) OVER (PARTITION BY symbol, day, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM summed),
earlier AS (SELECT *, list_median(l) AS m FROM listed),
bursts AS (
  SELECT symbol, seq, up, down, total, (up - down) / greatest(total, 1e-12{D}) AS directional,
    CASE WHEN len(l) >= 20 THEN (total - m) / greatest(1.4826{D} * list_median(list_transform(l, lambda v: abs(v - m))), 1e-9{D}) END AS surprise
  FROM earlier)"""

_READY, _HISTORY, _LONGEST, _STAY = 30, 2016, 288, math.log(1 - 1 / 144)
_MEASURES = ("rv_short", "rv_long", "spread_median", "spread_p95", "intensity", "abs_return")


def _density(spread: str, k: str) -> str:
    df = f"greatest(4, 3 + {k})"
    return f"lgamma(({df} + 1) / 2.0{D}) - lgamma({df} / 2.0{D}) - 0.5{D} * ln({df} * pi()) - ln({spread}) - ({df} + 1) / 2.0{D} * ln(1 + (x / {spread}) ** 2 / {df})"


# a stretch that begins at a row holds that row, so the fit of place j is one of j + 1 rows; only the first stretch began empty
POINTS = f"""
logs AS (SELECT symbol, i, unnest({list(range(len(_MEASURES)))}) AS dim, unnest([{", ".join(f"ln({m} + 1e-12{D})" for m in _MEASURES)}]) AS v FROM observed),
past AS (SELECT *, list(v) OVER (PARTITION BY symbol, dim ORDER BY i ROWS BETWEEN {_HISTORY} PRECEDING AND 1 PRECEDING) AS l FROM logs),
centred AS (SELECT symbol, i, dim, v, l, list_median(l) AS m FROM past WHERE i >= {_READY}),
scaled AS MATERIALIZED (SELECT symbol, i, dim, (v - m) / greatest(1.4826{D} * list_median(list_transform(l, lambda u: abs(u - m))), 1e-6{D}) AS z FROM centred),
nearest AS (SELECT *, lag(z) OVER (PARTITION BY symbol, dim ORDER BY i) AS near FROM scaled),
sums AS (
  SELECT a.symbol, a.i, a.dim, a.z, a.near, a.i - b.i AS k, sum(b.z - a.near) OVER w AS s1, sum((b.z - a.near) ** 2) OVER w AS s2
  FROM nearest a JOIN scaled b ON b.symbol = a.symbol AND b.dim = a.dim AND b.i >= a.i - {_LONGEST} AND b.i < a.i WINDOW w AS (PARTITION BY a.symbol, a.dim, a.i ORDER BY b.i DESC)),
stretches AS (SELECT symbol, i, dim, z, k, near + s1 / k AS mean, greatest(0, s2 - s1 * s1 / k) / nullif(k - 1, 0) AS var FROM sums),
shaped AS (
  SELECT symbol, i, 0::BIGINT AS k, z AS x, 2.5{D} AS spread FROM scaled
  UNION ALL SELECT symbol, i, k, z - mean, CASE WHEN k > 1 THEN greatest(sqrt(var), 0.25{D}) ELSE 2.5{D} END FROM stretches),
fits AS MATERIALIZED (SELECT symbol, i, k, sum({_density("spread", "k")}) AS fit FROM shaped GROUP BY ALL),
placed AS (
  SELECT symbol, i, k - 1 AS j, fit FROM fits WHERE k > 0
  UNION ALL SELECT symbol, i, k, fit FROM fits WHERE k = i - {_READY}),
grown AS (SELECT symbol, i, j + 1 AS k, sum(fit + {_STAY!r}{D}) OVER (PARTITION BY symbol, i - j ORDER BY j) AS g FROM placed WHERE j < {_LONGEST}),
ways AS MATERIALIZED (SELECT symbol, i, k, g FROM grown UNION ALL SELECT symbol, i, 0, 0{D} FROM fits WHERE k = 0),
lists AS MATERIALIZED (SELECT symbol, i, list(g ORDER BY k) AS g FROM ways GROUP BY ALL),
fresh AS MATERIALIZED (SELECT symbol, i, fit FROM fits WHERE k = 0),
changes AS (
  SELECT DISTINCT symbol, {_READY - 1}::BIGINT AS i, [0{D}] AS c FROM fresh
  UNION ALL
  SELECT symbol, i + 1, list_append(c, ln(1 / 144{D}) + fit + top + ln(list_sum(list_transform(v, lambda x: exp(x - top))))) FROM (
    SELECT *, list_max(v) AS top FROM (
      SELECT c.symbol, c.i, c.c, f.fit, list_transform(list_zip(list_reverse(c.c)[1:len(coalesce(l.g, [0.0]))], coalesce(l.g, [0.0])), lambda p: p[1] + p[2]) AS v
      FROM changes c JOIN fresh f ON f.symbol = c.symbol AND f.i = c.i + 1 LEFT JOIN lists l ON l.symbol = c.symbol AND l.i = c.i))),
masses AS (SELECT c.symbol, c.i, unnest(list_zip(range({_LONGEST + 2}), list_reverse(c.c)[1:{_LONGEST + 1}])) AS m FROM changes c WHERE c.i >= {_READY}),
weights AS (SELECT m.symbol, m.i, w.k, m.m[2] + w.g AS lw FROM masses m JOIN ways w ON w.symbol = m.symbol AND w.i = m.i AND w.k = m.m[1]),
tops AS (SELECT symbol, i, max(lw) AS top FROM weights GROUP BY ALL),
points AS (
  SELECT w.symbol, w.i, sum(exp(lw - top)) FILTER (k = 0) / sum(exp(lw - top)) AS p, sum(k * exp(lw - top)) / sum(exp(lw - top)) AS run, 1 / sum(exp(lw - top)) AS peak
  FROM weights w JOIN tops t ON t.symbol = w.symbol AND t.i = w.i GROUP BY ALL)"""

_IDENT = "candidate_id, symbol, direction, level, atr, event_ms, side, sign"
def _features(keys: str) -> str:
    """CTEs of the fourteen numbers; ``robust`` has a baseline by ``keys``, which ``wholes`` is given too."""
    return FEATURES.replace("FROM robust GROUP BY symbol)", f"FROM robust GROUP BY {keys})").replace("SELECT symbol, max(median)", f"SELECT {keys}, min(n) AS known, max(median)").replace("LEFT JOIN based b USING (symbol)", f"LEFT JOIN based b USING ({keys})").replace("SELECT w.*, b.im", "SELECT w.*, b.known, b.im")


FEATURES = f"""
marked AS (SELECT *, CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END AS sign FROM excursions),
around AS (
  SELECT m.*, t.seq, t.time_ms, t.flags, (t.bid + t.ask) / 2 AS mid, (t.ask - t.bid) / 0.0001{D} AS spread,
    CASE WHEN t.seq < m.event_seq THEN 'pre' WHEN t.time_ms <= m.event_ms + {HOUR // 2} THEN 'exc' ELSE 'post' END AS seg
  FROM marked m JOIN ticks t ON t.symbol = m.symbol AND t.time_ms BETWEEN m.event_ms - {HOUR} AND m.event_ms + {2 * HOUR}),
moving AS (SELECT *, sign(mid - lag(mid) OVER (PARTITION BY candidate_id, seg ORDER BY seq)) AS step FROM around),
parts AS (
  SELECT {_IDENT}, seg, count(*) AS n, min(time_ms) AS t0, max(time_ms) AS t1, sum(step) AS total, count(*) FILTER (step <> 0) AS active, count(*) FILTER (step = sign) AS agree,
    quantile_cont(spread, 0.5) AS spread, min_by(mid, seq) AS first, max_by(mid, seq) AS last FROM moving GROUP BY ALL),
wholes AS (
  SELECT {_IDENT}, max(spread) AS peak, max(side * (mid - level)) FILTER (seg = 'exc') AS deepest, count(*) FILTER ((flags & 2) <> 0) AS bids, count(*) FILTER ((flags & 4) <> 0) AS asks FROM moving GROUP BY ALL),
based AS (
  SELECT symbol, max(median) FILTER (feature = 'tick_intensity') AS im, max(mad) FILTER (feature = 'tick_intensity') AS ia, max(median) FILTER (feature = 'spread_pips') AS sm, max(mad) FILTER (feature = 'spread_pips') AS sa
  FROM robust GROUP BY symbol),
joined AS (
  SELECT w.*, b.im, b.ia, b.sm, b.sa, pre.n AS pre_n, pre.total AS pre_total, pre.active AS pre_active, exc.n AS exc_n, exc.first AS exc_first, exc.last AS exc_last,
    coalesce(post.n, exc.n) AS n, coalesce(post.t0, exc.t0) AS t0, coalesce(post.t1, exc.t1) AS t1, CASE WHEN post.n > 0 THEN post.total ELSE exc.total END AS total,
    coalesce(post.active, exc.active) AS active, coalesce(post.agree, exc.agree) AS agree, coalesce(post.spread, exc.spread) AS spread, coalesce(post.last, exc.last) AS last
  FROM wholes w LEFT JOIN based b USING (symbol)
    LEFT JOIN (SELECT * FROM parts WHERE seg = 'pre') pre ON pre.candidate_id = w.candidate_id
    LEFT JOIN (SELECT * FROM parts WHERE seg = 'exc') exc ON exc.candidate_id = w.candidate_id
    LEFT JOIN (SELECT * FROM parts WHERE seg = 'post') post ON post.candidate_id = w.candidate_id),
raw_features AS (
  SELECT *, CASE WHEN n < 2 THEN 0 ELSE (n - 1) / greatest((t1 - t0) / 1000{D}, 1e-3{D}) END AS tick_intensity, greatest(deepest, 1e-12{D}) AS deep, side * (last - level) AS final, greatest(spread, 1e-9{D}) AS floor_spread FROM joined),
features AS (
  SELECT candidate_id, event_ms, tick_intensity, coalesce((tick_intensity - im) / greatest(1.4826{D} * ia, 1e-9{D}), 0) AS tick_intensity_z,
    coalesce(pre_total / nullif(pre_active, 0), 0){D} * sign AS imbalance_pre, coalesce(total / nullif(active, 0), 0){D} * sign AS imbalance_post, coalesce(agree / nullif(active, 0), 0.5){D} AS persistence,
    peak AS spread_peak, coalesce((peak - sm) / greatest(1.4826{D} * sa, 1e-9{D}), 0) AS spread_peak_z, least(1, greatest(0, coalesce(nullif(sm, 0), floor_spread) / floor_spread)) AS spread_normalization,
    deepest / atr AS penetration, least(1, greatest(0, (deepest - final) / deep)) AS rejection, least(1, greatest(0, final / deep)) AS close_location,
    abs(exc_last - exc_first) / 0.0001{D} / greatest(1, exc_n - 1) AS impact_per_tick, coalesce((bids - asks) / nullif(bids + asks, 0), 0){D} * sign AS quote_asymmetry, (side * sign){D} AS alignment
  FROM raw_features)"""
_NAMES = (
    "tick_intensity", "tick_intensity_z", "imbalance_pre", "imbalance_post", "persistence", "spread_peak", "spread_peak_z", "spread_normalization", "penetration", "rejection",
    "close_location", "impact_per_tick", "quote_asymmetry", "alignment",
)


def _clip(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


STATES = f"""
scored_states AS (
  SELECT candidate_id,
    {_clip(f"0.25{D} * persistence + 0.2{D} * spread_normalization + 0.2{D} * close_location + 0.2{D} * {_clip('(tick_intensity_z + 1) / 4')} + 0.15{D} * {_clip('(quote_asymmetry + 1) / 2')}")} * {_clip("(alignment + 1) / 2")} AS a,
    {_clip(f"0.45{D} * rejection + 0.2{D} * spread_normalization + 0.2{D} * {_clip('-imbalance_pre * imbalance_post')} + 0.15{D} * (1 - close_location)")} * {_clip("(1 - alignment) / 2")} AS b,
    {_clip(f"0.65{D} * {_clip('spread_peak_z / 4')} + 0.35{D} * (1 - spread_normalization)")} AS c, 0.35{D} AS d
  FROM features),
shares AS (
  SELECT candidate_id, place, name, exp(4 * score) / sum(exp(4 * score)) OVER (PARTITION BY candidate_id) AS p
  FROM (SELECT candidate_id, unnest([1, 2, 3, 4]) AS place, unnest(['DIRECTIONAL_BREAKOUT', 'SWEEP_RETURN', 'SPREAD_SPIKE', 'UNRESOLVED']) AS name, unnest([a, b, c, d]) AS score FROM scored_states)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY p DESC, place) AS k FROM shares),
best AS (SELECT candidate_id, max(name) FILTER (k = 1) AS state, max(p) FILTER (k = 1) AS probability, max(p) FILTER (k = 1) - max(p) FILTER (k = 2) AS margin FROM ranks GROUP BY ALL),
annotated AS (
  SELECT *, CASE WHEN state IN ('DIRECTIONAL_BREAKOUT', 'SWEEP_RETURN') THEN probability WHEN state = 'SPREAD_SPIKE' THEN -probability ELSE 0 END AS signal, {_clip(f"{_clip(f'0.35{D} + 1.5{D} * margin')} * 0.8{D}")} AS confidence FROM best)"""

_BASELINE = robust(f"SELECT symbol, unnest(['tick_intensity', 'spread_pips']) AS feature, unnest([tick_count / 3600{D}, spread_median]) AS x FROM base", "symbol")
_FEATURE_CTES = (TICKS, GAPS, BASE, _LEVELS, _BASELINE, FEATURES)
_SESSIONS = robust(f"SELECT symbol, {session('bar_start_ms')} AS session, unnest(['tick_intensity', 'spread_pips']) AS feature, unnest([tick_count / 3600{D}, spread_median]) AS x FROM base", "symbol, session")
_BY_SESSION = (
    TICKS, GAPS, BASE, _LEVELS, _SESSIONS,
    _features("symbol, session").replace(f"SELECT {_IDENT}, max(spread) AS peak", f"SELECT {_IDENT}, {session('event_ms')} AS session, max(spread) AS peak").replace("SELECT candidate_id, event_ms, tick_intensity, coalesce(", "SELECT candidate_id, coalesce(known, 0) AS baseline_n, event_ms, tick_intensity, coalesce("),
    STATES.replace(" * 0.8::DOUBLE", f" * CASE WHEN baseline_n > 0 THEN least(1, baseline_n / 100{D}) ELSE 0.5{D} END").replace("FROM best)", "FROM best JOIN features USING (candidate_id))"),
)


def sequence_sql() -> dict[str, str]:
    recursive = lambda *parts, select: sql(*parts, select=select).replace("WITH", "WITH RECURSIVE", 1)
    known = lambda c: f"coalesce({c}, 0)"
    return {
        "regime_filter": recursive(TICKS, GAPS, BASE, OBSERVED, REGIMES, select="SELECT symbol, ts_ms, regime, duration, round(least(1, duration / 6.0), 6) AS confidence FROM stepped WHERE i >= 0"),
        "burst_intensity": sql(TICKS, BURSTS, select=f"SELECT symbol, seq, {rounded('up', 'down', 'total', 'directional')}, round(surprise, 4) AS surprise FROM bursts"),
        "changepoint_guard": recursive(
            TICKS, GAPS, BASE, OBSERVED, POINTS,
            select=f"""SELECT o.symbol, o.ts_ms, CASE WHEN p.p IS NULL THEN 'WARMUP' WHEN p.p >= 0.55 THEN 'VOLATILITY_LIQUIDITY_CHANGEPOINT' ELSE 'REGIME_STABLE' END AS event, true AS valid,
              round({known("1 - 2 * p.p")}, 5) AS signal, round({known("p.peak")}, 5) AS confidence, round({known("p.p")}, 5) AS change_probability, round({known("p.run")}, 5) AS expected_run,
              CASE WHEN p.p >= 0.55 THEN 0.5 ELSE 1.0 END{D} AS suggested_multiplier, 1{D} AS applied_multiplier
              FROM observed o LEFT JOIN points p ON p.symbol = o.symbol AND p.i = o.i""",
        ),
        "window_features": sql(*_FEATURE_CTES, select=f"SELECT candidate_id, event_ms, {rounded(*_NAMES, digits=5)} FROM features"),
        "session_tick_state": sql(
            *_BY_SESSION,
            select=f"SELECT candidate_id, state, baseline_n, {rounded('probability', 'margin', 'signal', 'confidence', digits=4)}, CASE WHEN signal > 0.15 THEN 'SUPPORT' WHEN signal < -0.15 THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS effect FROM annotated",
        ),
        "tick_state": sql(
            *_FEATURE_CTES, STATES,
            select=f"SELECT candidate_id, state, {rounded('probability', 'margin', 'signal', 'confidence', digits=4)}, CASE WHEN signal > 0.15 THEN 'SUPPORT' WHEN signal < -0.15 THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS effect FROM annotated",
        ),
    }
