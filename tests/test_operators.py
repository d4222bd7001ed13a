"""Small cases with values worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.functions import clock, costs, prices
from tickspark.operators import bars, candidates, context, labels, model, quality, regime, sequence, splits, stats
from tickspark.plans.studies import arms, exit_ablation, failure_diagnostics, registry
from tickspark.schemas import CALENDAR, COST, DAY, HOUR, TICK

MONDAY = 1_704_067_200_000  # 1 January 2024
MINUTE = 60_000


def ticks(spark, rows, symbol="S"):
    return spark.createDataFrame([(symbol, i, t, float(b), float(a), f) for i, (t, b, a, f) in enumerate(rows)], TICK)


def quotes(spark, *rows):
    return ticks(spark, [(MONDAY + t, b, a, 6) for t, b, a in rows])


def one(df):
    (row,) = df.collect()
    return row


def test_bucket_edges_and_gap_across_bars(spark):
    t = quotes(spark, (0, 1.0, 1.0001), (5 * MINUTE - 1, 1.1, 1.1001), (5 * MINUTE, 1.2, 1.2), (9 * MINUTE, 0.9, 0.9006))
    out = {r.bar_start_ms - MONDAY: r for r in bars.base_bars(bars.with_gaps(t, MINUTE), 5 * MINUTE).collect()}
    first, second = out[0], out[5 * MINUTE]
    assert (first.tick_count, first.bid_open, first.bid_close, first.max_gap_ms) == (2, 1.0, 1.1, 5 * MINUTE - 1)
    assert first.quality_flags == ["HAS_SUSPICIOUS_GAP"] and first.suspicious_gap_count == 1
    assert (second.max_gap_ms, second.zero_spread_count) == (4 * MINUTE, 1)
    assert second.quality_flags == ["EXTREME_SPREAD", "HAS_SUSPICIOUS_GAP", "ZERO_SPREAD_HEAVY"]


def test_chunked_lag_equals_plain_lag(spark):
    t = quotes(spark, *((i * 1000, 1, 1.1) for i in range(23)))
    rows = sequence.with_previous(t, ["time_ms"], chunk=5).orderBy("seq").collect()
    assert [r.prev_time_ms for r in rows] == [None, *(MONDAY + i * 1000 for i in range(22))]


def test_weekend_gap_is_no_suspicion_and_no_bar_is_made(spark):
    friday, monday = MONDAY + 4 * DAY + 23 * HOUR, MONDAY + 7 * DAY + HOUR
    t = ticks(spark, [(friday, 1, 1.1, 0), (monday, 1, 1.1, 0)])
    gapped = bars.with_gaps(t, MINUTE)
    assert [r.odd_gap for r in gapped.orderBy("seq").collect()] == [False, False]
    assert bars.base_bars(gapped).count() == 2
    assert [r.gap_class for r in quality.gap_observations(t, MINUTE).collect()] == ["EXPECTED_CLOSURE"]


def test_rollup_hands_flags_up_and_reconciles(spark):
    t = quotes(spark, (0, 1, 1), (HOUR, 1, 1.0002), (HOUR + 1, 1, 1.0002), (HOUR + 2, 1, 1.0002), (2 * HOUR, 1, 1.0002), (3 * HOUR, 1, 1.0002))
    b = bars.rollup_bars(bars.with_gaps(t, DAY))
    out = {(r.timeframe, (r.bar_start_ms - MONDAY) // HOUR): r for r in b.collect()}
    assert out["MID", 0].quality_flags == ["ZERO_SPREAD_HEAVY"] and out["MID", 0].empty_count == 0
    assert out["MID", 3].empty_count == 2 and out["TOP", 0].empty_count == 2
    assert out["TOP", 0].quality_flags == ["INCOMPLETE_OR_EMPTY_INTERVAL", "ZERO_SPREAD_HEAVY"]
    pairs = bars.reconcile(b)
    assert all(r.agrees for r in pairs.collect())
    report = one(bars.build_report(b, t, pairs, MONDAY, MONDAY + 7 * DAY))
    assert (report.closed_slots, report.bar_count, report.empty_slots, report.severity) == (48, 4, 7 * 24 - 48 - 4, "WARN")


def test_feed_quality_counts_and_gate(spark):
    good = quotes(spark, (0, 1, 1.0001), (1000, 1, 1.0001), (1000, 1, 1.0001), (5000, 1, 1.0003))
    q = one(quality.feed_quality(good, expected_interval=1000, gap_threshold=3000))
    assert (q.tick_count, q.equal_times, q.duplicates, q.gaps, q.missing, q.valid) == (4, 1, 1, 1, 3, True)
    assert abs(q.missing_ratio - 3 / 7) < 1e-12 and abs(q.spread_median - 1) < 1e-6
    bad = ticks(spark, [(MONDAY + 5, 1, 0.9, 0), (MONDAY, 0, 1, 0)], "BAD")
    both = good.unionByName(bad)
    report = quality.feed_quality(both)
    fail = one(report.where("symbol = 'BAD'"))
    assert fail.hard_failures == ["OUT_OF_ORDER_TICKS", "CROSSED_QUOTES", "NONPOSITIVE_QUOTES"] and not fail.valid
    assert {r.symbol for r in quality.gate(both, report).collect()} == {"S"}
    with pytest.raises(Exception, match="feed refused"):
        quality.gate(both, report, strict=True).count()


def test_coverage_and_orphans(spark):
    key = "symbol string, chunk_start_ms long"
    day = lambda n: MONDAY + n * DAY
    expected = spark.createDataFrame([("S", day(n), day(n + 1)) for n in range(7)], key + ", chunk_end_ms long")
    files = spark.createDataFrame([("S", day(0), 5), ("S", day(1), 5), ("S", day(9), 1)], key + ", file_ticks long")
    ledger = spark.createDataFrame([("S", day(0), day(1), 5, "COMPLETED"), ("S", day(1), day(2), 6, "COMPLETED"), ("S", day(2), day(3), 0, "NO_BROKER_HISTORY"), ("S", day(4), day(5), 3, "COMPLETED"), ("S", day(5), day(6), 0, "EXPECTED_MARKET_CLOSED"), ("S", day(6), day(7), 2, "COMPLETED")], key + ", chunk_end_ms long, tick_count long, status string")
    cover = quality.chunk_coverage(expected, files, ledger)
    got = [r.chunk_status for r in cover.orderBy("chunk_start_ms").collect()]
    assert got == ["COMPLETED", "COUNT_MISMATCH", "MISSING_HISTORY", "MISSING_LEDGER", "MISSING_FILE", "EXPECTED_MARKET_CLOSED", "LEDGER_MISMATCH"]
    s = one(quality.coverage_summary(cover))
    assert (s.completed, s.closed, s.missing, s.mismatches, s.severity) == (1, 1, 3, 2, "FAIL")
    assert [(r.kind, r.chunk_start_ms) for r in quality.orphans(expected, files, ledger).collect()] == [("FILE", day(9))]


def test_clocks(spark):
    cases = [("2024-01-15 08:00:00", "EU_US_ALIGNED", "LONDON_OPEN"), ("2024-03-15 12:00:30", "US_DST_EU_STANDARD", "NEW_YORK_OPEN"), ("2024-07-01 07:00:00", "EU_US_ALIGNED", "LONDON_OPEN"), ("2024-10-29 12:00:00", "US_DST_EU_STANDARD", "NEW_YORK_OPEN"), ("2024-01-13 22:00:00", "EU_US_ALIGNED", None)]
    df = spark.createDataFrame(cases, "at string, dst string, open string").withColumn("ms", F.unix_millis(F.col("at").cast("timestamp")))
    for r in df.select("*", clock.dst_state(F.col("ms")).alias("d"), clock.session_open(F.col("ms")).alias("o")).collect():
        assert (r.d, r.o) == (r.dst, r.open)
    weekend = df.where("at like '2024-01-13%'").select(clock.inside_weekend(F.col("ms"), F.col("ms") + 26 * HOUR).alias("a"), clock.inside_weekend(F.col("ms"), F.col("ms") + 26 * HOUR + 1).alias("b"), clock.session(F.col("ms")).alias("s"))
    assert tuple(one(weekend)) == (True, False, "ROLLOVER")


@pytest.mark.parametrize("bucket", [None, 10])
def test_as_of_matches_equal_times_and_far_rows(spark, bucket):
    left = spark.createDataFrame([("S", t) for t in (5, 10, 11, 100)] + [("X", 10)], "symbol string, t long")
    right = spark.createDataFrame([("S", 10, 1), ("S", 10, 2), ("S", 40, 3)], "symbol string, rt long, v int")
    back = sequence.as_of(left, right, "t", "rt", "m", ["v"], bucket_ms=bucket, order="v")
    assert sorted((r.symbol, r.t, r.m and r.m.v) for r in back.collect()) == [("S", 5, None), ("S", 10, 2), ("S", 11, 2), ("S", 100, 3), ("X", 10, None)]
    ahead = sequence.as_of(left, right, "t", "rt", "m", ["v"], backward=False, bucket_ms=bucket, order="v")
    assert sorted((r.symbol, r.t, r.m and r.m.v) for r in ahead.collect() if r.symbol == "S") == [("S", 5, 1), ("S", 10, 1), ("S", 11, 3), ("S", 100, None)]


def idea(spark, direction="LONG", entry=1.0, stop=0.99, target=1.03, at=0, hold=60_000):
    return spark.createDataFrame([("c", "S", direction, entry, stop, target, MONDAY + at, hold)], "candidate_id string, symbol string, direction string, entry double, stop_loss double, take_profit double, available_ms long, max_holding_ms long")


BARRIER_CASES = [
        ("LONG", 0.99, 1.03, [(0, 0.999, 1.0), (10, 1.03, 1.031)], "TAKE_PROFIT", 3.0),
        ("SHORT", 1.01, 0.97, [(0, 1.0, 1.001), (10, 0.969, 0.97)], "TAKE_PROFIT", 3.0),
        ("LONG", 0.99, 1.03, [(0, 0.999, 1.0), (10, 0.985, 0.986)], "STOP_LOSS", -1.5),
        ("LONG", 0.99, 1.03, [(0, 0.999, 1.0), (10, 1.03, 1.031), (10, 0.98, 0.981)], "AMBIGUOUS", -2.0),
        ("LONG", 0.99, 1.03, [(0, 0.999, 1.0), (60_000, 1.001, 1.002), (60_000, 1.002, 1.003)], "VERTICAL", 0.2),
        ("LONG", 0.99, 1.03, [(0, 0.999, 1.0), (90_000, 1.005, 1.006)], "VERTICAL", 0.5),
        ("LONG", 0.99, 1.03, [(70_000, 0.999, 1.0), (90_000, 1.005, 1.006)], "VERTICAL", 0.5),
        ("LONG", 0.99, 1.03, [(0, 0.999, 1.0)], "DATA_EXHAUSTED", None),
        ("LONG", 0.99, 1.03, [(0, 0.98, 0.985)], "NO_FILL", None),
        ("LONG", 0.99, 1.03, [(-5, 0.98, 0.985)], "NO_FILL", None),
    ]


def test_tick_barriers(spark):
    made = feed = None
    for k, (direction, stop, target, rows, _, _) in enumerate(BARRIER_CASES):
        own = idea(spark, direction, 1.0, stop, target).withColumn("symbol", F.lit(f"S{k}")).withColumn("candidate_id", F.lit(f"{k}"))
        seen = ticks(spark, [(MONDAY + t, b, a, 6) for t, b, a in rows], f"S{k}")
        made, feed = (own, seen) if made is None else (made.unionByName(own), feed.unionByName(seen))
    out = {int(r.candidate_id): r for r in labels.tick_barriers(made, feed).collect()}
    for k, (*_, outcome, net) in enumerate(BARRIER_CASES):
        r = out[k]
        assert r.outcome == outcome, k
        assert (r.net_r is None) == (net is None) and (net is None or abs(r.net_r - net) < 1e-9), k
        if net is not None:
            assert abs(r.gross_r - r.spread_cost_r - r.slippage_cost_r - r.commission_cost_r - r.net_r) < 1e-12
            assert r.label == (outcome == "TAKE_PROFIT")


def path_bars(spark, lows_highs):
    rows = [("S", "BASE", MONDAY + i * HOUR, MONDAY + (i + 1) * HOUR, 1.0, h, lo, (h + lo) / 2, 1.0, h, lo, (h + lo) / 2) for i, (lo, h) in enumerate(lows_highs)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, bar_start_ms long, bar_end_ms long, bid_open double, bid_high double, bid_low double, bid_close double, ask_open double, ask_high double, ask_low double, ask_close double")


PATH_CASES = [
        ([(0.999, 1.031)], ("TAKE_PROFIT", 3.0), ("VERTICAL", 1.5)),
        ([(0.98, 1.031)], ("AMBIGUOUS_CONSERVATIVE_STOP", -1.0), ("AMBIGUOUS_CONSERVATIVE_STOP", -1.0)),
        ([(1.0, 1.011), (0.98, 1.0)], ("STOP_LOSS", -1.0), ("STOP_LOSS", -1.0)),
        ([(1.0, 1.011), (0.98, 1.012)], ("STOP_LOSS", -1.0), ("AMBIGUOUS_CONSERVATIVE_STOP", -1.0)),
        ([(1.0, 1.011), (1.0, 1.035)], ("TAKE_PROFIT", 3.0), ("TAKE_PROFIT", 2.0)),
        ([(0.98, 1.0)], ("STOP_LOSS", -1.0), ("STOP_LOSS", -1.0)),
        ([(1.0, 1.004)] * 3, ("VERTICAL", 0.2), ("VERTICAL", 0.2)),
    ]


def test_bar_outcomes(spark):
    made = paths = None
    for k, (bars_, _, _) in enumerate(PATH_CASES):
        own = idea(spark).withColumn("regime", F.lit("BULL")).withColumn("session", F.lit("ASIA")).withColumn("symbol", F.lit(f"S{k}")).withColumn("candidate_id", F.lit(f"{k}"))
        path = path_bars(spark, bars_).withColumn("symbol", F.lit(f"S{k}"))
        made, paths = (own, path) if made is None else (made.unionByName(own), paths.unionByName(path))
    out = {(int(r.candidate_id), r.policy): r for r in labels.bar_outcomes(made, paths, spark.createDataFrame([], COST), 3).where("scenario = 'BASELINE_2X'").collect()}
    for k, (_, fixed, partial) in enumerate(PATH_CASES):
        for name, (outcome, gross) in (("FIXED_RR", fixed), ("PARTIAL_TRAILING", partial)):
            r = out[k, name]
            assert (r.outcome, round(r.gross_r, 9)) == (outcome, gross), k
            # the fallback costs half a pip on a risk of a hundred pips; a timed-out exit pays it once
            assert abs(r.cost_r - 0.005 * (1 if outcome == "VERTICAL" else 2)) < 1e-9


def test_joint_stress_is_no_multiple(spark):
    trades = spark.createDataFrame([("t", "asia", "bull", "long", 0.01)], "id string, session string, regime string, direction string, risk double")
    bucket = spark.createDataFrame([("ASIA", "BULL", "LONG", 1.0, 2.0, 10.0, 0.1, 3.0, 0.01, 0.5)], COST)
    got = {r.scenario: r for r in costs.stress_matrix(trades, bucket, F.lit(True)).collect()}
    assert len(got) == 9
    assert abs(got["NORMAL"].total_cost_r - (0.03 + 0.1 + 0.01)) < 1e-12 and abs(got["BASELINE_2X"].total_cost_r - 0.28) < 1e-12
    assert abs(got["JOINT_EXECUTION_STRESS"].total_cost_r - ((2.5 + 5.5 + 6) * 0.01 + 0.1 + 0.02)) < 1e-12


def test_walk_forward_purges_and_holdout(spark):
    events = spark.createDataFrame([("S", f"e{i}", i * 10, i * 10 + 25) for i in range(12)], "symbol string, event_id string, start_ms long, label_end_ms long")
    indexed = splits.numbered(events)
    rows = splits.walk_forward(indexed, 3, 3, 5).collect()
    folds = {}
    for r in rows:
        folds.setdefault(r.fold_id, {"TRAIN": set(), "VALIDATION": set()})[r.role].add(r.idx)
    # a label ends 25 after its start, so with the embargo of 5 the last three events before a block are purged
    assert folds == {0: {"TRAIN": {0, 1, 2}, "VALIDATION": {6, 7, 8}}, 1: {"TRAIN": set(range(6)), "VALIDATION": {9, 10, 11}}}
    assert sorted(r.idx for r in splits.final_holdout(indexed).collect()) == [10, 11]


def trades(spark, values):
    return spark.createDataFrame([("S", MONDAY + i * DAY, float(v), -0.5, 0.5, float(v)) for i, v in enumerate(values)], "symbol string, ts_ms long, net_r double, mae_r double, mfe_r double, gross_r double")


def test_performance(spark):
    p = one(stats.performance(trades(spark, [1, -1, -2, 0, -1, 3, -1, -1]), ["symbol"], ["ts_ms"]))
    assert (p.trades, p.max_drawdown_r, p.longest_losing_run, p.win_rate) == (8, 4.0, 2, 0.25)
    assert abs(p.trades_per_week - 8) < 1e-9
    alone = one(stats.performance(trades(spark, [-1]), ["symbol"], ["ts_ms"]))
    assert alone.trades_per_week is None and alone.max_drawdown_r == 1.0


def test_bootstrap_equals_a_plain_loop(spark):
    values = [0.5, -1.0, 2.0, 0.1, -0.7, 1.3, -0.2]
    n, size, samples = len(values), 3, 40
    means = []
    for s in range(samples):
        drawn = []
        for b in range(-(-n // size)):
            x = (s * 69621 + 1) % stats.MODULUS
            x = (x * stats.MULTIPLIER + b * 69621 + 11) % stats.MODULUS
            start = (x * stats.MULTIPLIER) % stats.MODULUS % n
            drawn += [values[(start + k) % n] for k in range(size)]
        means.append(sum(drawn[:n]) / n)
    means.sort()
    r = one(stats.block_bootstrap(trades(spark, values), ["symbol"], ["ts_ms"], block=size, samples=samples))
    assert abs(r.point_estimate - sum(values) / n) < 1e-12
    assert abs(r.lower_95 - means[round(39 * 0.025)]) < 1e-12 and abs(r.upper_95 - means[round(39 * 0.975)]) < 1e-12


def test_targets_before_the_stop(spark):
    paths = spark.createDataFrame([("S", [0.6, 1.2, -1.0, 3.0]), ("S", [-1.0, 2.0]), ("S", [])], "symbol string, path array<double>")
    r = one(stats.target_before_stop(paths))
    assert (r.paths, r.unclear) == (3, 1) and abs(r.hit_0_5r - 1 / 3) < 1e-12 and r.hit_2_0r == 0


def test_posterior_shrinks_to_the_parent(spark):
    rows = [("A", "x", "d", "R", 1.0)] * 2 + [("A", "y", "d", "R", -1.0)] * 30
    bucket = ["session", "benchmark", "dst_state", "regime"]
    df = spark.createDataFrame(rows, "session string, benchmark string, dst_state string, regime string, net_r double")
    out = {r.benchmark: r for r in stats.posterior_table(df, bucket, ["session", "regime"]).collect()}
    parent = (2 - 30) / 32
    assert abs(out["x"].mean_r - (2 / 32 * 1 + 30 / 32 * parent)) < 1e-12 and not out["x"].actionable
    assert out["y"].actionable and out["y"].lower_95 == out["y"].upper_95


def test_risk_policy_and_gates(spark):
    rows = [("LONG", 1.0, 0.99, 1.03, 0.005, "P"), ("LONG", 1.0, 0.99, 1.02, 0.02, "Q"), ("SHORT", 1.0, 0.99, 1.03, 0.005, "P"), ("LONG", 1.0, 1.0, 1.03, 0.005, "P")]
    df = spark.createDataFrame(rows, "direction string, entry double, stop_loss double, take_profit double, risk_fraction double, pair string")
    got = [r.violations for r in candidates.risk_violations(df, ["P"]).collect()]
    assert got == [[], ["PAIR_NOT_ALLOWED", "RISK_OUT_OF_BOUNDS", "REWARD_TOO_SMALL"], ["PRICES_OUT_OF_ORDER"], ["PRICES_OUT_OF_ORDER"]]
    flagged = df.limit(1).withColumn("candidate", F.explode(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))))
    assert [r.violations for r in candidates.risk_violations(flagged, ["P"]).collect()] == [[], ["NOT_A_CANDIDATE"], ["NOT_A_CANDIDATE"]]
    g = spark.createDataFrame([(True, True, 0.005, 250, 0.1, -0.01, 5.0, 4.0, None), (True, True, 0.005, 50, 0.1, None, 1.0, 4.0, None)], "valid_data boolean, sound_stop boolean, risk_fraction double, n long, net_ev_r double, stress_ev_r double, max_drawdown_r double, drawdown_ceiling_r double, lower_95 double")
    assert [r.reasons for r in stats.feasibility(g, strict=True).collect()] == [["EXECUTION_FRAGILE", "DRAWDOWN_CEILING", "INTERVAL_NOT_POSITIVE"], []]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(2.0, 0.0, 0.0, 0.0, 0.0)], " double, ".join(stats.RANK_WEIGHTS) + " double").select(stats.rank_score()).collect()


def test_execution_monitor(spark):
    fills = lambda n, real: spark.createDataFrame([("S", i, real, 0.2, 0.3, 0.1) for i in range(n)], "symbol string, seq long, real_slip double, expected_slip double, real_cost_r double, estimated_cost_r double")
    bad = one(stats.execution_monitor(fills(40, 0.5), ["symbol"], "seq"))
    assert (bad.n, bad.reasons, bad.pause) == (30, ["MEDIAN_SLIPPAGE", "P90_SLIPPAGE", "COST_GAP"], True)
    few = one(stats.execution_monitor(fills(29, 0.5), ["symbol"], "seq"))
    assert (few.reasons, few.pause) == (["INSUFFICIENT_OBSERVATIONS"], False)


def test_event_guard(spark):
    made = spark.createDataFrame([(f"c{m}", "S", MONDAY + m * MINUTE) for m in (0, 6, 24, 27, 60)], "candidate_id string, symbol string, available_ms long")
    events = [("s", MONDAY, "x", "a", "A", "A", "USD", MONDAY + 10 * MINUTE, "HIGH"), ("s", MONDAY, "x", "b", "B", "B", "EUR", MONDAY + 58 * MINUTE, "MEDIUM"), ("t", MONDAY + DAY, "x", "c", "C", "C", "EUR", MONDAY + 28 * MINUTE, "HIGH")]
    calendar = spark.createDataFrame(events, CALENDAR)
    got = {r.candidate_id: (r.effect, r.event) for r in context.event_guard(made, calendar).collect()}
    none = ("NEUTRAL", "NO_SCHEDULED_HIGH_IMPACT_EVENT")
    assert got == {"c0": none, "c6": ("HARD_VETO", "A"), "c24": ("HARD_VETO", "A"), "c27": none, "c60": none}
    with pytest.raises(Exception, match="younger than the candidate"):
        context.event_guard(made, calendar, strict=True).collect()


def test_states_follow_their_features(spark):
    f = dict(tick_intensity=5.0, tick_intensity_z=3.0, imbalance_pre=1.0, imbalance_post=1.0, persistence=1.0, spread_peak=1.0, spread_peak_z=0.0, spread_normalization=1.0, penetration=1.0, rejection=0.0, close_location=1.0, impact_per_tick=1.0, quote_asymmetry=1.0, alignment=1.0)
    sweep = f | dict(alignment=-1.0, rejection=1.0, close_location=0.0, imbalance_pre=-1.0)
    spike = f | dict(spread_peak_z=9.0, spread_normalization=0.0, alignment=-1.0, rejection=0.0)
    df = spark.createDataFrame([(n, *x.values()) for n, x in (("b", f), ("s", sweep), ("w", spike))], "candidate_id string, " + " double, ".join(f) + " double")
    got = {r.candidate_id: (r.state, r.effect) for r in context.classify_states(df).collect()}
    assert got == {"b": ("DIRECTIONAL_BREAKOUT", "SUPPORT"), "s": ("SWEEP_RETURN", "SUPPORT"), "w": ("SPREAD_SPIKE", "CONTRADICT")}


def test_regimes(spark):
    z = spark.createDataFrame([("S", i, float(v), 0.0) for i, v in enumerate([0, 3, 3, 3, 0, 3, -2, -2, -2])], "symbol string, ts_ms long, volatility_z double, spread_z double")
    got = [(r.regime, r.duration) for r in regime.duration_filter(z, ["symbol"], "ts_ms").orderBy("ts_ms").collect()]
    assert got == [("NORMAL", 1), ("NORMAL", 2), ("NORMAL", 3), ("HIGH_STRESS", 3), ("HIGH_STRESS", 4), ("HIGH_STRESS", 5), ("HIGH_STRESS", 6), ("HIGH_STRESS", 7), ("LOW_VOL", 3)]
    level = lambda i: 1.0 + 0.01 * (i % 3) if i < 80 else 10.0
    obs = spark.createDataFrame([("S", i, *[level(i)] * 6, 0.5 if i == 70 else 0.0) for i in range(90)], "symbol string, ts_ms long, " + ", ".join(f"{c} double" for c in regime.OBSERVATION) + ", missing_ratio double")
    rows = regime.regime_guard(obs).orderBy("ts_ms").collect()
    assert [r.event for r in rows[:30]] == ["WARMUP"] * 30 and rows[70].event == "DATA_QUALITY_INVALID" and rows[70].applied_multiplier == 0
    assert max(r.change_probability for r in rows[80:84]) > max(r.change_probability for r in rows[60:70])
    t = regime.burst_intensity(quotes(spark, (0, 1, 1.1), (500, 1.1, 1.2), (1000, 1.0, 1.1))).orderBy("seq").collect()
    decay = 2.718281828459045**-1
    assert abs(t[1].up - 1.25) < 1e-12 and abs(t[2].up - (0.25 + decay)) < 1e-9 and abs(t[2].down - 1.25) < 1e-12


def test_conformal_sets(spark):
    cal = spark.createDataFrame([(0.05 * i, 1) for i in range(1, 20)], "p double, y int")
    th = one(model.conformal_threshold(cal, alpha=0.1))
    assert abs(th.threshold - 0.90) < 1e-9  # the 18th of 19 scores, by the upper index
    out = model.with_prediction_sets(spark.createDataFrame([(0.95,), (0.5,), (0.02,)], "p double"), model.conformal_threshold(cal))
    assert [(r.labels, r.abstain) for r in out.orderBy("p").collect()] == [([0], False), ([0, 1], True), ([1], False)]
    with pytest.raises(ValueError, match="needed"):
        model.meta_label(cal, cal, cal, ["p"])


def test_price_helpers(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.3, 0), (1.0, 0.9, 1.3, 6)], "entry double, stop_loss double, take_profit double, flags int")
    got = df.select(prices.planned_rr().alias("rr"), prices.bid_changed().alias("b"), prices.ask_changed().alias("a")).collect()
    assert got[0].rr == float("inf") and abs(got[1].rr - 3) < 1e-9 and (got[0].b, got[1].b, got[1].a) == (False, True, True)
    assert one(spark.range(1).select(prices.shrunk_mean(F.lit(1.0), F.lit(50), F.lit(0.0)).alias("m"))).m == 0.5


def test_no_look_ahead(spark, sf_dir):
    """Candidates made from ticks up to a time are those made from all ticks, but for the last bars."""
    from tickspark.plans import fixture as fx

    cut = fx.START + 15 * DAY
    make = lambda t: candidates.generate(bars.rollup_bars(bars.with_gaps(t, fx.GAP_LIMIT)), lookback=12, stride=3)
    early = {r.candidate_id: (r.entry, r.stop_loss) for r in make(fx.ticks(spark, sf_dir).where(F.col("time_ms") < cut)).collect()}
    whole = {r.candidate_id: (r.entry, r.stop_loss) for r in fx.ideas(spark, sf_dir).where(F.col("available_ms") < cut - 13 * HOUR).collect()}
    assert whole.items() <= early.items()


def test_ablation_study(spark, sf_dir):
    from tickspark.plans import fixture as fx

    facts, metrics = exit_ablation(fx.all_bars(spark, sf_dir), fx.cost_buckets(spark), 12, 3, 6, HOUR, 2, 2, 0, samples=10)
    facts = facts.persist()
    per = facts.groupBy("candidate_id").count().collect()
    assert per and {r["count"] for r in per} == {20}  # four policies by five scenarios
    assert metrics.where("scenario = 'BASELINE_2X'").count() == facts.select("family", "policy").distinct().count()
    slices, correlations = failure_diagnostics(facts, candidates.families(fx.ideas(spark, sf_dir)).withColumn("candidate_id", F.col("family_candidate_id")))
    assert {r.dimension for r in slices.collect()} == {"direction", "session", "regime", "hour", "weekday"} and correlations.columns[-1] == "correlation"
    assert registry(metrics, json.dumps({"a": 1})).count() == facts.select("family").distinct().count() and arms(spark).count() == 16


def test_arms(spark):
    rows = {r.arm: (r.kind, r.parts) for r in arms(spark).collect()}
    assert rows["C_STRUCTURE_LIQUIDITY"] == ("EXIT", ["STRUCTURE_TARGET"]) and rows["BASELINE"] == ("MODULE", []) and rows["FULL"] == ("MODULE", ["TICK", "TIME", "REGIME"])
    modules = [sorted(parts) for kind, parts in rows.values() if kind == "MODULE"]
    assert len(modules) == 11 and sum(len(m) == 1 for m in modules) == 3 and sum(len(m) == 2 for m in modules) == 6


def test_fingerprint_is_of_the_set_of_rows(spark):
    rows = [(f"c{i}", i % 3) for i in range(50)]
    one = lambda rows, parts: {r.k: tuple(v for c, v in r.asDict().items() if c != "k") for r in candidates.fingerprint(spark.createDataFrame(rows, "id string, k int").repartition(parts), ["id"], ["k"]).collect()}
    whole = one(rows, 1)
    assert whole == one(rows[::-1], 5) and len(whole) == 3
    changed = one([*rows[:-1], ("c49x", rows[-1][1])], 2)
    assert {k for k in whole if whole[k] != changed[k]} == {rows[-1][1]}
    assert one(rows + rows[:1], 1)[0] != whole[0]  # repeats count


def test_meta_label_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2)) * (1.0, 30.0) + (0.0, 7.0)
    y = (rng.random(900) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.02 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "i int, a double, b double, y int")
    out = sorted(model.meta_label(df.where("i < 500"), df.where("i >= 500 AND i < 800"), df.where("i >= 800"), ["a", "b"], min_rows=800).collect())
    middle = np.median(x[:500], axis=0)
    z = (x - middle) / (1.4826 * np.median(np.abs(x[:500] - middle), axis=0))
    w = np.zeros(3)
    for _ in range(50):  # Newton's method on the mean loss with half of 0.01 times the squared weights
        full = np.hstack([z[:500], np.ones((500, 1))])
        p = 1 / (1 + np.exp(-full @ w))
        penalty = np.diag([0.01, 0.01, 0.0])
        w -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / 500 + penalty, full.T @ (p - y[:500]) / 500 + penalty @ w)
    p = 1 / (1 + np.exp(-np.hstack([z, np.ones((900, 1))]) @ w))
    assert max(abs(r.p - q) for r, q in zip(out, p[800:])) < 1e-3
    wrong = np.sort(1 - np.where(y[500:800] == 1, p[500:800], 1 - p[500:800]))
    threshold = wrong[int(299 * 0.9 + 0.999999)]
    assert all(r.labels == [k for k, q in ((0, r.p), (1, 1 - r.p)) if q <= threshold] for r in out if min(abs(r.p - threshold), abs(1 - r.p - threshold)) > 2e-3)
    assert all(r.abstain == (len(r.labels) != 1) for r in out)


def test_expanding_median_and_deviation():
    rng = np.random.default_rng(6)
    for values in (rng.normal(size=60), np.repeat([1.0, 2.0, 2.0, 5.0], 7), np.zeros(9), rng.integers(0, 4, 50).astype(float)):
        seen = regime.Expanding()
        for i, v in enumerate(values.tolist(), 1):
            seen.add(v)
            middle = float(np.median(values[:i]))
            assert seen.median() == middle and abs(seen.deviation(middle) - np.median(np.abs(values[:i] - middle))) < 1e-12


def test_percentiles_by_counts_equal_plain_ones(spark):
    rng = np.random.default_rng(7)
    values = {"a": rng.integers(0, 5, 101).astype(float), "b": rng.normal(size=8), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("a", None), ("d", None)], "k string, v double")
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in quality.exact_percentiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == values.keys()
    assert all(abs(got[k][name] - np.percentile(own, 100 * q)) < 1e-12 for k, own in values.items() for name, q in shares.items())


def test_empty_feeds_and_quarantine(spark):
    q = {r.symbol: r for r in quality.feed_quality(quotes(spark, (0, 1, 1.0001)), expected=spark.createDataFrame([("S",), ("GONE",)], "symbol string")).collect()}
    assert q["GONE"].hard_failures == ["EMPTY"] and not q["GONE"].valid and q["GONE"].tick_count == 0 and q["S"].valid
    rows = [("S", 1, *[1.0] * 6, 0.0), ("S", 2, *[-1.0] * 6, 0.0), ("S", 3, 1.0, None, *[1.0] * 4, 2.0), ("S", 4, float("nan"), *[1.0] * 5, 0.0)]
    obs = spark.createDataFrame(rows, "symbol string, ts_ms long, " + ", ".join(f"{c} double" for c in regime.OBSERVATION) + ", missing_ratio double")
    sound, others = regime.quarantine(obs)
    assert [r.ts_ms for r in sound.collect()] == [1] and sound.columns == obs.columns
    assert {r.ts_ms: len(r.faults) for r in others.collect()} == {2: 6, 3: 2, 4: 1}
