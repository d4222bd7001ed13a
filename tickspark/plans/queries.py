"""Registered queries over the ``events`` ticks. Doubles are rounded for comparison with the SQL in :mod:`tickspark.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, costs, prices
from ..operators import bars, candidates, context, labels, model, quality, regime, sequence, splits, stats
from ..schemas import DAY, HOUR
from ..streaming.bars import stream_bars
from . import fixture as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    """Register a query; local hours are read from timestamps, so the session has to be in UTC."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def r(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name or c) if name or isinstance(c, str) else out


def flags(c: str = "quality_flags") -> Column:
    return F.array_join(c, ",").alias(c)


def base(spark, sf_dir, **options) -> DataFrame:
    return bars.base_bars(bars.with_gaps(fx.ticks(spark, sf_dir), fx.GAP_LIMIT), **options)


_BAR = ["bid_open", "bid_high", "bid_low", "bid_close", "ask_open", "ask_high", "ask_low", "ask_close"]


@query
def base_bars(spark, sf_dir):
    b = base(spark, sf_dir)
    return b.select("symbol", "bar_start_ms", "bar_end_ms", *map(r, _BAR), "tick_count", "first_ms", "last_ms", *map(r, ("spread_min", "spread_median", "spread_p95", "spread_max")), "zero_spread_count", r("zero_spread_ratio"), "max_gap_ms", "suspicious_gap_count", flags())


@query
def tick_view(spark, sf_dir):
    return fx.ticks(spark, sf_dir).select("symbol", "seq", "time_ms", r("bid"), r("ask"), "flags")


@query
def spread_pips(spark, sf_dir):
    t = fx.ticks(spark, sf_dir)
    return t.select("symbol", "seq", r(prices.spread_pips(), "spread"), r(prices.mid(), "mid"), prices.bid_changed().alias("bid_changed"), prices.ask_changed().alias("ask_changed"), prices.valid_quote().alias("valid"))


@query
def intertick_gaps(spark, sf_dir):
    return bars.with_gaps(fx.ticks(spark, sf_dir), fx.GAP_LIMIT).select("symbol", "seq", "gap_ms", "odd_gap")


@query
def rollup_bars(spark, sf_dir):
    return fx.all_bars(spark, sf_dir).select("symbol", "timeframe", "bar_start_ms", "bar_end_ms", *map(r, _BAR), "tick_count", *map(r, ("spread_median", "spread_p95")), r("zero_spread_ratio"), "max_gap_ms", "suspicious_gap_count", "empty_count", flags())


@query
def bar_reconciliation(spark, sf_dir):
    return bars.reconcile(fx.all_bars(spark, sf_dir))


@query
def bar_report(spark, sf_dir):
    b = fx.all_bars(spark, sf_dir)
    return bars.build_report(b, fx.ticks(spark, sf_dir), bars.reconcile(b), fx.START, fx.END)


@query
def ohlc_violations(spark, sf_dir):
    """Bars beside a copy with broken prices, of which every broken one must be found."""
    b = fx.all_bars(spark, sf_dir)
    broken = b.where(F.pmod(F.floor(F.col("bar_start_ms") / HOUR), F.lit(24)) == 0).withColumn("bid_high", F.col("bid_low") - 0.001)
    return bars.ohlc_violations(b.unionByName(broken)).groupBy("symbol", "timeframe").agg(F.count("*").alias("violations"))


def _faulty(spark, sf_dir) -> DataFrame:
    """Ticks with faults: some repeated, some crossed, some late, some without a price."""
    t = fx.ticks(spark, sf_dir)
    twice = t.where("seq % 101 = 0")
    bad = t.withColumn("ask", F.when(F.col("seq") % 211 == 0, F.col("bid") - 0.001).otherwise(F.col("ask"))).withColumn("bid", F.when(F.col("seq") % 307 == 0, 0.0).otherwise(F.col("bid")))
    bad = bad.withColumn("time_ms", F.when(F.col("seq") % 97 == 0, F.col("time_ms") - 40 * HOUR).otherwise(F.col("time_ms")))
    again = twice.withColumn("seq", F.col("seq") * 10 + 5)
    return bad.withColumn("seq", F.col("seq") * 10).unionByName(again)


def _quality(q: DataFrame) -> DataFrame:
    return q.select("symbol", "tick_count", "out_of_order", "equal_times", "duplicates", r("duplicate_ratio"), "crossed", "nonpositive", "gaps", "missing", r("missing_ratio"), r("spread_median"), r("spread_p95"), flags("hard_failures"), "valid")


@query
def feed_quality(spark, sf_dir):
    return _quality(quality.feed_quality(fx.ticks(spark, sf_dir), expected_interval=600_000, gap_threshold=fx.GAP_LIMIT))


@query
def feed_quality_faults(spark, sf_dir):
    return _quality(quality.feed_quality(_faulty(spark, sf_dir), expected_interval=600_000, gap_threshold=fx.GAP_LIMIT))


@query
def feed_gate(spark, sf_dir):
    t = fx.ticks(spark, sf_dir)
    mixed = t.where("symbol <> 'click'").unionByName(_faulty(spark, sf_dir).where("symbol = 'click'"))
    return quality.gate(mixed, quality.feed_quality(mixed)).groupBy("symbol").agg(F.count("*").alias("ticks"))


@query
def gap_observations(spark, sf_dir):
    g = quality.gap_observations(fx.ticks(spark, sf_dir), HOUR)
    return g.select("symbol", "seq", "from_ms", "to_ms", "gap_ms", "utc_hour", r("prev_bid"), r("prev_ask"), r("next_bid"), r("next_ask"), "gap_class")


@query
def spread_summary(spark, sf_dir):
    return quality.spread_summary(fx.ticks(spark, sf_dir), ["symbol"]).select("symbol", *map(r, ("min", "p25", "p50", "p75", "p95", "p99", "max")))


@query
def daily_profile(spark, sf_dir):
    d = quality.daily_profile(fx.ticks(spark, sf_dir))
    return d.select("symbol", "day", "trading_ticks", "valid_quotes", "zero_spreads", "extreme_spreads", r("spread_p50"), r("spread_p95"), r("zero_ratio"))


@query
def hourly_profile(spark, sf_dir):
    h = quality.hourly_profile(fx.ticks(spark, sf_dir))
    return h.select("symbol", "hour", "ticks", "valid_quotes", "zero_spreads", "extreme_spreads", r("spread_p50"), r("spread_p95"), r("zero_ratio"))


@query
def duplicates_by_day(spark, sf_dir):
    return quality.duplicates_by_day(_faulty(spark, sf_dir))


@query
def low_density_days(spark, sf_dir):
    return quality.low_density_days(quality.daily_profile(fx.ticks(spark, sf_dir)), 0.9).select("symbol", "day", "trading_ticks", r("median_ticks"))


@query
def most_affected_hour(spark, sf_dir):
    return quality.most_affected_hour(quality.hourly_profile(fx.ticks(spark, sf_dir))).select("symbol", "hour", "extreme_spreads", "total", r("percent"))


def _chunks(spark, sf_dir):
    """Daily chunks of each symbol; files and ledger with some entries left out or changed."""
    t = fx.ticks(spark, sf_dir)
    expected = t.select("symbol").distinct().crossJoin(quality.chunk_calendar(spark, fx.START, fx.END, DAY))
    start = fx.START + F.floor((F.col("time_ms") - fx.START) / DAY) * DAY
    n = F.floor((F.col("chunk_start_ms") - fx.START) / DAY)
    counted = t.groupBy("symbol", start.cast("long").alias("chunk_start_ms")).agg(F.count("*").alias("file_ticks"))
    weekday = clock.weekday(F.col("chunk_start_ms")) < 5
    files = counted.where(weekday & (n % 11 != 3))
    entries = counted.select("symbol", "chunk_start_ms", (F.col("chunk_start_ms") + DAY).alias("chunk_end_ms"), F.when(weekday, F.col("file_ticks") + F.when(n % 13 == 5, 1).otherwise(0)).otherwise(0).alias("tick_count"), F.when(n % 17 == 7, "NO_BROKER_HISTORY").when(weekday, "COMPLETED").otherwise("EXPECTED_MARKET_CLOSED").alias("status"))
    ledger = entries.where(n % 19 != 2)
    return expected, files, ledger


@query
def chunk_coverage(spark, sf_dir):
    return quality.chunk_coverage(*_chunks(spark, sf_dir)).select("symbol", "chunk_start_ms", "chunk_end_ms", "file_ticks", "ledger_ticks", "chunk_status")


@query
def coverage_summary(spark, sf_dir):
    s = quality.coverage_summary(quality.chunk_coverage(*_chunks(spark, sf_dir)))
    return s.select("symbol", "expected", "completed", "closed", "missing", "mismatches", r("percent"), "severity")


@query
def chunk_orphans(spark, sf_dir):
    expected, files, ledger = _chunks(spark, sf_dir)
    return quality.orphans(expected.where(F.col("chunk_start_ms") < fx.START + 20 * DAY), files, ledger)


@query
def pending_chunks(spark, sf_dir):
    from ..streaming.ingest import pending_chunks as pending

    expected, _, ledger = _chunks(spark, sf_dir)
    return pending(expected, ledger)


@query
def session_bucket(spark, sf_dir):
    t = F.col("time_ms")
    return fx.ticks(spark, sf_dir).groupBy("symbol", clock.session(t).alias("session"), clock.utc_hour(t).alias("hour"), clock.weekday(t).cast("int").alias("weekday")).agg(F.count("*").alias("ticks"))


@query
def dst_state(spark, sf_dir):
    """Ticks moved over the year, so that all three states occur."""
    moved = F.col("time_ms") + (F.col("seq") % 365) * DAY
    return fx.ticks(spark, sf_dir).groupBy("symbol", clock.dst_state(moved).alias("dst_state")).agg(F.count("*").alias("ticks"))


@query
def benchmark_windows(spark, sf_dir):
    moved = F.col("time_ms") + (F.col("seq") % 365) * DAY
    t = fx.ticks(spark, sf_dir).withColumn("moved_ms", moved)
    names = list(clock.BENCHMARKS)
    near = context.time_context(t, "moved_ms")
    return near.select("symbol", "seq", *(r(clock.benchmark_minutes(F.col("moved_ms"), n), f"m_{n.lower()}") for n in names), "benchmark")


@query
def asof_closed_bar(spark, sf_dir):
    b = fx.all_bars(spark, sf_dir)
    out = candidates.closed_bars(b.where("timeframe = 'BASE'").select("symbol", "bar_start_ms", "bar_end_ms"), b.where("timeframe = 'TOP'"), "top")
    return out.select("symbol", "bar_start_ms", F.col("top.bar_end_ms").alias("top_end_ms"), r("top.bid_close", "top_close"))


@query
def asof_next_tick(spark, sf_dir):
    b = base(spark, sf_dir).select("symbol", "bar_start_ms", (F.col("bar_start_ms") + HOUR // 2).alias("from_ms"))
    out = sequence.as_of(b, fx.ticks(spark, sf_dir), "from_ms", "time_ms", "t", ["time_ms", "seq", "ask"], backward=False, bucket_ms=6 * HOUR, order="seq")
    return out.select("symbol", "bar_start_ms", F.col("t.time_ms").alias("tick_ms"), F.col("t.seq").alias("seq"), r("t.ask", "ask"))


@query
def event_band_join(spark, sf_dir):
    ideas = base(spark, sf_dir).select(F.concat_ws(":", "symbol", "bar_end_ms").alias("candidate_id"), "symbol", F.col("bar_end_ms").alias("available_ms"))
    return context.event_guard(ideas, fx.calendar(spark), HOUR, 3 * HOUR).select("candidate_id", "symbol", "available_ms", "effect", "event", r("seconds_from_release"), "signal")


@query
def post_event_summary(spark, sf_dir):
    return context.post_release(fx.calendar(spark), fx.ticks(spark, sf_dir), 2 * HOUR).select("event_id", "symbol", "scheduled_ms", "ticks", r("median_spread"), r("range_pips"))


def _candidate_columns(c: DataFrame) -> DataFrame:
    return c.select("candidate_id", "symbol", "direction", "available_ms", r("entry", None, 9), r("stop_loss", None, 9), "regime", "session", r("impulse", None, 9), r("mid_impulse", None, 9), r("past_median", None, 9))


@query
def candidate_events(spark, sf_dir):
    return _candidate_columns(fx.ideas(spark, sf_dir))


@query
def candidate_families(spark, sf_dir):
    return candidates.families(fx.ideas(spark, sf_dir), fx.LOOKBACK).select("family", "family_candidate_id", "symbol", "direction")


@query
def dataset_manifest(spark, sf_dir):
    return candidates.dataset_manifest(fx.all_bars(spark, sf_dir))


@query
def universe_fingerprint(spark, sf_dir):
    return candidates.fingerprint(fx.ideas(spark, sf_dir), ["candidate_id"], ["symbol"])


@query
def walk_forward_folds(spark, sf_dir):
    return splits.walk_forward(fx.indexed(spark, sf_dir), fx.MIN_TRAIN, fx.VALIDATION, fx.EMBARGO)


@query
def final_holdout(spark, sf_dir):
    return splits.final_holdout(fx.indexed(spark, sf_dir)).select("symbol", "idx", "event_id", "label_end_ms")


@query
def bar_outcomes(spark, sf_dir):
    return fx.outcomes(spark, sf_dir).select("candidate_id", "policy", "scenario", "outcome", "holding_bars", "exit_ms", *map(r, ("gross_r", "cost_r", "net_r", "mfe_r", "mae_r")))


@query
def stress_matrix(spark, sf_dir):
    ideas = fx.ideas(spark, sf_dir).withColumn("risk", prices.planned_risk()).select("candidate_id", "session", "regime", "direction", "risk")
    m = costs.stress_matrix(ideas, fx.cost_buckets(spark), F.col("direction") == "LONG")
    return m.select("candidate_id", "scenario", *(r(c) for c in ("entry_cost_r", "exit_cost_r", "stop_cost_r", "commission_cost_r", "rollover_cost_r", "total_cost_r")))


@fx.shared
def _fold_outcomes(spark, sf_dir) -> DataFrame:
    """Outcomes of the validation events of the folds before the locked holdout: what the policy tables are made of."""
    indexed = fx.indexed(spark, sf_dir)
    held = splits.final_holdout(indexed).select("symbol", "event_id")
    open_events = indexed.join(held, ["symbol", "event_id"], "left_anti")
    folds = splits.walk_forward(open_events, fx.MIN_TRAIN, fx.VALIDATION, fx.EMBARGO, roles=("VALIDATION",)).select(F.col("event_id").alias("candidate_id"), "fold_id")
    return fx.outcomes(spark, sf_dir).join(folds, "candidate_id")


@query
def policy_metrics(spark, sf_dir):
    o = _fold_outcomes(spark, sf_dir)
    keys = ["symbol", "policy", "scenario"]
    perf = stats.performance(o, keys, ["exit_ms", "candidate_id"], "exit_ms")
    more = o.groupBy(*keys).agg(F.avg("gross_r").alias("gross_ev_r"), F.avg("cost_r").alias("cost_drag_r"))
    interval = stats.block_bootstrap(o, keys, ["exit_ms", "candidate_id"], block=fx.BLOCK, samples=fx.SAMPLES).drop("n")
    both = perf.join(more, keys).join(interval, keys)
    return both.select(*keys, "trades", *(r(c) for c in ("expectancy_r", "win_rate", "mean_mae_r", "mean_mfe_r", "max_drawdown_r", "trades_per_week", "gross_ev_r", "cost_drag_r", "lower_95", "upper_95")), "longest_losing_run")


def _plain(spark, sf_dir) -> DataFrame:
    return fx.outcomes(spark, sf_dir).where("policy = 'FIXED_RR' AND scenario = 'BASELINE_1X'")


@query
def drawdown_curve(spark, sf_dir):
    c = stats.equity_curve(_plain(spark, sf_dir), ["symbol"], ["exit_ms", "candidate_id"])
    return c.select("candidate_id", "symbol", *(r(x) for x in ("net_r", "equity", "peak", "drawdown")))


@query
def performance_stats(spark, sf_dir):
    p = stats.performance(_plain(spark, sf_dir), ["symbol"], ["exit_ms", "candidate_id"], "exit_ms")
    return p.select("symbol", "trades", *(r(c) for c in ("expectancy_r", "win_rate", "mean_mae_r", "mean_mfe_r", "max_drawdown_r", "trades_per_week")), "longest_losing_run")


@query
def slice_table(spark, sf_dir):
    t = _plain(spark, sf_dir).withColumn("hour", clock.utc_hour(F.col("available_ms"))).withColumn("weekday", clock.weekday(F.col("available_ms")))
    return stats.slices(t, ["direction", "session", "regime", "hour", "weekday"]).select("dimension", "value", "n", *(r(c) for c in ("gross_ev_r", "net_ev_r", "win_rate", "mean_mfe_r", "mean_mae_r")))


@query
def feature_correlation(spark, sf_dir):
    ideas = fx.ideas(spark, sf_dir).select("candidate_id", "past_median", "impulse")
    return stats.correlations(_plain(spark, sf_dir).join(ideas, "candidate_id"), ["past_median", "impulse"], "gross_r", ["symbol"]).select("symbol", "feature", "n", r("correlation"))


@query
def outcome_geometry(spark, sf_dir):
    g = labels.outcome_geometry(fx.ideas(spark, sf_dir), fx.all_bars(spark, sf_dir).where("timeframe = 'BASE'"), fx.HORIZON)
    return g.select("symbol", "paths", *(r(c) for c in g.columns if c.startswith("hit_")), r("ambiguity_rate"))


def _excursions(spark, sf_dir) -> DataFrame:
    """Ordered excursions of each candidate: the closes of its path in R."""
    path = labels.bar_paths(fx.ideas(spark, sf_dir), fx.all_bars(spark, sf_dir).where("timeframe = 'BASE'"), fx.HORIZON)
    return path.groupBy("symbol", "candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "close_r"))), lambda s: s["close_r"]).alias("path"))


@query
def target_before_stop(spark, sf_dir):
    t = stats.target_before_stop(_excursions(spark, sf_dir))
    return t.select("symbol", "paths", *(r(c) for c in t.columns if c.startswith("hit_")), "unclear")


@query
def block_bootstrap_ci(spark, sf_dir):
    b = stats.block_bootstrap(_plain(spark, sf_dir), ["symbol"], ["exit_ms", "candidate_id"], block=fx.BLOCK, samples=fx.SAMPLES)
    return b.select("symbol", "n", r("point_estimate"), r("lower_95"), r("upper_95"))


def _session_study(spark, sf_dir) -> DataFrame:
    from .studies import session_study

    return session_study(fx.all_bars(spark, sf_dir).where("timeframe = 'BASE'"), HOUR, fx.START + 10 * DAY, fx.START + 20 * DAY, samples=fx.SAMPLES, block=fx.BLOCK)


@query
def session_event_study(spark, sf_dir):
    s = _session_study(spark, sf_dir)
    return s.select("event", "period", "horizon", "n", *(r(c) for c in ("mean_pips", "median_pips", "lower_95", "upper_95")))


@query
def tick_barrier_labels(spark, sf_dir):
    """Every bar's close as a trade idea, with stops and targets a few pips away."""
    b = base(spark, sf_dir)
    long = F.col("bid_close") >= F.col("bid_open")
    sign = F.when(long, 1.0).otherwise(-1.0)
    ideas = b.select(F.concat_ws(":", "symbol", "bar_end_ms").alias("candidate_id"), "symbol", F.when(long, "LONG").otherwise("SHORT").alias("direction"), F.col("bid_close").alias("entry"), (F.col("bid_close") - sign * 0.004).alias("stop_loss"), (F.col("bid_close") + sign * 0.012).alias("take_profit"), F.col("bar_end_ms").alias("available_ms"), F.lit(2 * HOUR).cast("long").alias("max_holding_ms"))
    out = labels.tick_barriers(ideas, fx.ticks(spark, sf_dir), latency_ms=250, entry_slip=0.2, exit_slip=0.3, commission_r=0.01)
    return out.select("candidate_id", "direction", "outcome", "label", "entry_ms", "exit_ms", *(r(c) for c in ("entry_fill", "exit_fill", "gross_r", "spread_cost_r", "slippage_cost_r", "net_r")))


_FEATURES = ["spread_median", "max_gap_ms", "tick_count"]


@query
def robust_baseline(spark, sf_dir):
    b = base(spark, sf_dir).withColumn("session", clock.session(F.col("bar_start_ms"))).select("symbol", "session", *(F.col(f).cast("double").alias(f) for f in _FEATURES))
    return stats.robust_baseline(b, ["symbol", "session"], _FEATURES).select("symbol", "session", "feature", r("median"), r("mad"), "n")


@query
def fold_baseline(spark, sf_dir):
    folds = splits.walk_forward(fx.indexed(spark, sf_dir), fx.MIN_TRAIN, fx.VALIDATION, fx.EMBARGO, roles=("TRAIN",)).select("fold_id", F.col("event_id").alias("candidate_id"))
    rows = fx.ideas(spark, sf_dir).select("candidate_id", "symbol", "session", "past_median", "impulse").join(folds, "candidate_id")
    return stats.robust_baseline(rows.drop("candidate_id"), ["symbol", "fold_id", "session"], ["past_median", "impulse"]).select("symbol", "fold_id", "session", "feature", r("median"), r("mad"), "n")


_BUCKET, _PARENT = ["session", "benchmark", "dst_state", "regime"], ["session", "regime"]


def _posterior(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = context.time_context(_plain(spark, sf_dir).drop("session"), "available_ms", 60.0)
    return t, stats.posterior_table(t.select(*_BUCKET, "net_r"), _BUCKET, _PARENT)


@query
def posterior_table(spark, sf_dir):
    return _posterior(spark, sf_dir)[1].select(*_BUCKET, "bucket_n", "parent_n", *(r(c) for c in ("weight", "mean_r", "lower_95", "upper_95")), "actionable")


@query
def time_hazard(spark, sf_dir):
    t, table = _posterior(spark, sf_dir)
    h = context.hazard_annotations(t.select("candidate_id", *_BUCKET), table, _BUCKET, approved=True)
    return h.select("candidate_id", "effect", r("signal"), "confidence")


@query
def risk_violations(spark, sf_dir):
    """Candidates with targets and risks that break the policy here and there."""
    ideas = fx.ideas(spark, sf_dir)
    k = F.pmod(F.floor(F.col("available_ms") / HOUR), F.lit(7))
    sign = F.when(prices.is_long(), 1.0).otherwise(-1.0)
    made = ideas.withColumn("risk_fraction", 0.004 * k).withColumn("pair", F.col("symbol")).withColumn("candidate", F.when(k < 6, k != 2)).withColumn("take_profit", F.col("entry") + sign * prices.planned_risk() * (k - 1))
    out = candidates.risk_violations(made, ["click", "view", "purchase", "login"])
    return out.select("candidate_id", flags("violations"), "accepted", r(prices.planned_rr(), "rr"))


@query
def feasibility_gates(spark, sf_dir):
    keys = ["symbol", "policy"]
    plain = stats.performance(fx.outcomes(spark, sf_dir).where("scenario = 'BASELINE_1X'"), keys, ["exit_ms", "candidate_id"], "exit_ms")
    stress = fx.outcomes(spark, sf_dir).where("scenario = 'BASELINE_1.25X'").groupBy(*keys).agg(F.avg("net_r").alias("stress_ev_r"))
    rows = plain.join(stress, keys).select(*keys, F.lit(True).alias("valid_data"), F.lit(True).alias("sound_stop"), F.lit(0.005).alias("risk_fraction"), F.col("trades").alias("n"), F.col("expectancy_r").alias("net_ev_r"), "stress_ev_r", "max_drawdown_r", F.lit(20.0).alias("drawdown_ceiling_r"), F.lit(None).cast("double").alias("lower_95"))
    out = stats.feasibility(rows, strict=True)
    return out.select(*keys, "n", stats.reliability_tier(F.col("n")).alias("tier"), flags("reasons"), "accepted")


@query
def rank_scores(spark, sf_dir):
    p = stats.performance(_plain(spark, sf_dir), ["symbol"], ["exit_ms", "candidate_id"], "exit_ms")
    whole = p.crossJoin(F.broadcast(_plain(spark, sf_dir).agg(F.avg("net_r").alias("parent"))))
    parts = whole.withColumn("net_expectancy", F.col("win_rate")).withColumn("stability", 1 / (1 + F.col("max_drawdown_r"))).withColumn("confidence", F.least(F.lit(1.0), F.col("trades") / 200)).withColumn("regime_robustness", F.lit(None).cast("double")).withColumn("tail_robustness", F.lit(0.5))
    ev = stats.expected_value(F.col("win_rate"), F.lit(2.0), F.lit(-1.0), F.lit(0.05))
    return parts.select("symbol", r(stats.rank_score(), "score"), r(prices.shrunk_mean(F.col("expectancy_r"), F.col("trades"), F.col("parent")), "shrunk_ev_r"), r(ev, "expected_r"))


@query
def execution_monitor(spark, sf_dir):
    """Fills from ticks: expected slippage a fifth of a pip, real slippage a tenth of the spread."""
    t = fx.ticks(spark, sf_dir)
    fills = t.select("symbol", "seq", (prices.spread_pips() * F.when(F.col("symbol") == "view", 0.8).otherwise(0.1)).alias("real_slip"), F.lit(0.2).alias("expected_slip"), (prices.spread_pips() * 0.05).alias("real_cost_r"), F.lit(0.02).alias("estimated_cost_r"))
    return stats.execution_monitor(fills, ["symbol"], "seq").select("symbol", "n", flags("reasons"), "pause")


def _level_ideas(spark, sf_dir) -> DataFrame:
    """Every bar's close as a level, with a range measure that makes excursions frequent."""
    b = base(spark, sf_dir)
    long = F.col("bid_close") >= F.col("bid_open")
    return b.select(F.concat_ws(":", "symbol", "bar_end_ms").alias("candidate_id"), "symbol", F.when(long, "LONG").otherwise("SHORT").alias("direction"), ((F.col("bid_close") + F.col("ask_close")) / 2).alias("level"), F.greatest(F.col("bid_high") - F.col("bid_low"), F.lit(0.0001)).alias("atr"), F.col("bar_end_ms").alias("available_ms"))


@query
def level_excursion(spark, sf_dir):
    e = context.level_excursions(_level_ideas(spark, sf_dir), fx.ticks(spark, sf_dir), 3 * HOUR)
    return e.select("candidate_id", "direction", "event_seq", "event_ms", r("event_mid"), r("threshold", None, 8), "side")


def _features(spark, sf_dir) -> DataFrame:
    t = fx.ticks(spark, sf_dir)
    e = context.level_excursions(_level_ideas(spark, sf_dir), t, 3 * HOUR)
    b = base(spark, sf_dir).select("symbol", (F.col("tick_count") / 3600.0).alias("tick_intensity"), F.col("spread_median").alias("spread_pips"))
    return context.window_features(e, t, HOUR, HOUR // 2, 2 * HOUR, stats.robust_baseline(b, ["symbol"], ["tick_intensity", "spread_pips"]))


@query
def window_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("candidate_id", "event_ms", *(r(c, None, 5) for c, kind in f.dtypes if kind == "double"))


@query
def tick_state(spark, sf_dir):
    s = context.classify_states(_features(spark, sf_dir), F.lit(80))
    return s.select("candidate_id", "state", r("probability", None, 4), r("margin", None, 4), r("signal", None, 4), r("confidence", None, 4), "effect")


@query
def session_tick_state(spark, sf_dir):
    """States with the baseline of the event's own session, and a confidence by how much that baseline has seen."""
    t = fx.ticks(spark, sf_dir)
    e = context.level_excursions(_level_ideas(spark, sf_dir), t, 3 * HOUR)
    b = base(spark, sf_dir).select("symbol", clock.session(F.col("bar_start_ms")).alias("session"), (F.col("tick_count") / 3600.0).alias("tick_intensity"), F.col("spread_median").alias("spread_pips"))
    keys = ["symbol", "session"]
    f = context.window_features(e, t, HOUR, HOUR // 2, 2 * HOUR, stats.robust_baseline(b, keys, ["tick_intensity", "spread_pips"]), baseline_keys=keys)
    s = context.classify_states(f, F.col("baseline_n"))
    return s.select("candidate_id", "state", "baseline_n", r("probability", None, 4), r("margin", None, 4), r("signal", None, 4), r("confidence", None, 4), "effect")


def _observations(spark, sf_dir) -> DataFrame:
    return regime.regime_observations(base(spark, sf_dir))


@query
def rolling_robust_z(spark, sf_dir):
    z = regime.robust_threshold(_observations(spark, sf_dir), ["symbol"], "ts_ms", window=96)
    return z.select("symbol", "ts_ms", "history", r("spread_median_z", None, 4), "unstable")


@query
def regime_filter(spark, sf_dir):
    z = regime.rolling_robust_z(_observations(spark, sf_dir), ["symbol"], "ts_ms", ["rv_short", "spread_median"], 96)
    return regime.duration_filter(z.withColumnRenamed("rv_short_z", "volatility_z").withColumnRenamed("spread_median_z", "spread_z"), ["symbol"], "ts_ms").select("symbol", "ts_ms", "regime", "duration", r("confidence"))


@query
def burst_intensity(spark, sf_dir):
    return regime.burst_intensity(fx.ticks(spark, sf_dir), beta=0.002).select("symbol", "seq", *(r(c) for c in ("up", "down", "total", "directional")), r("surprise", None, 4))


@query
def changepoint_guard(spark, sf_dir):
    g = regime.regime_guard(_observations(spark, sf_dir))
    return g.select("symbol", "ts_ms", "event", "valid", *(r(c, None, 5) for c in ("signal", "confidence", "change_probability", "expected_run")), "suggested_multiplier", "applied_multiplier")


def _scored(spark, sf_dir) -> DataFrame:
    """Outcomes with a stand-in probability between 0.05 and 0.95."""
    p = 0.05 + 0.9 * F.pmod(F.floor(F.col("available_ms") / HOUR), F.lit(23)) / 22.0
    return _plain(spark, sf_dir).select("candidate_id", "symbol", "available_ms", p.alias("p"), (F.col("gross_r") > 0).cast("int").alias("y"))


@query
def conformal_sets(spark, sf_dir):
    s = _scored(spark, sf_dir)
    out = model.with_prediction_sets(s, model.conformal_threshold(s.where(F.col("available_ms") < fx.START + 20 * DAY), ["symbol"]), ["symbol"])
    return out.select("candidate_id", r("p"), r("threshold"), F.array_join("labels", ",").alias("labels"), "abstain")


@query
def meta_label(spark, sf_dir):
    """Every bar with whether the next one closes higher; earlier bars train, later ones calibrate and are predicted."""
    w = Window.partitionBy("symbol").orderBy("bar_start_ms")
    b = base(spark, sf_dir).select("symbol", "bar_start_ms", (F.col("bid_close") - F.col("bid_open")).alias("impulse"), (F.col("bid_high") - F.col("bid_low")).alias("range"), "spread_median", (F.lead("bid_close").over(w) > F.col("bid_close")).cast("int").alias("y")).where("y IS NOT NULL")
    t = F.col("bar_start_ms")
    out = model.meta_label(b.where(t < fx.START + 10 * DAY), b.where((t >= fx.START + 10 * DAY) & (t < fx.START + 20 * DAY)), b.where(t >= fx.START + 20 * DAY), ["impulse", "range", "spread_median"], min_rows=100)
    return out.select("symbol", "bar_start_ms", r("p", None, 4), F.array_join("labels", ",").alias("labels"), "abstain")


@query
def exit_plans(spark, sf_dir):
    """Targets at several multiples of each candidate's risk, and the best two of a partial plan."""
    ideas = fx.ideas(spark, sf_dir)
    kinds = F.array(*(F.struct(F.lit(m).alias("gross_r"), F.lit(k).alias("target_type"), F.lit(p).alias("priority")) for m, k, p in ((1.0, "FIXED_R", 1), (3.0, "FIXED_R", 0), (2.0, "STRUCTURAL", 0), (4.0, "EXTERNAL", 2))))
    t = ideas.withColumn("t", F.explode(kinds)).select("candidate_id", "t.*", F.col("available_ms").alias("ts_ms"), r(prices.r_target(F.col("entry"), prices.planned_risk(), F.col("t.gross_r"), prices.is_long()), "price"))
    t = t.withColumn("net_r", F.col("gross_r") - 0.1).withColumn("valid", F.col("gross_r") < 4)
    return stats.exit_plan(t, ["candidate_id"], "PARTIAL_TRAILING").select("candidate_id", "rank", "gross_r", "target_type", "fraction", "price")


@query
def family_index(spark, sf_dir):
    """Per family of candidates: trades, expectancy, and the best one marked."""
    member = candidates.families(fx.ideas(spark, sf_dir), fx.LOOKBACK).select("family", "candidate_id")
    per = _plain(spark, sf_dir).join(member, "candidate_id").groupBy("family").agg(F.count("*").alias("trades"), F.avg("net_r").alias("net_ev_r"), F.avg("gross_r").alias("gross_ev_r"))
    best = F.row_number().over(Window.orderBy(F.desc("net_ev_r"), "family")) == 1
    return per.select("family", "trades", r("net_ev_r"), r("gross_ev_r"), best.alias("best"))


@query
def feed_verdicts(spark, sf_dir):
    """Verdicts on the feeds that are there and on one that should be."""
    t = fx.ticks(spark, sf_dir)
    wanted = t.select("symbol").unionByName(spark.createDataFrame([("absent",)], "symbol string"))
    return quality.feed_quality(t, gap_threshold=fx.GAP_LIMIT, expected=wanted).select("symbol", "tick_count", "duplicates", "gaps", flags("hard_failures"), "valid")


@query
def observation_quarantine(spark, sf_dir):
    """Observations of all bars, those of every fifth hour with a broken measure or missing share: how many are sound, and what the others lack."""
    o = _observations(spark, sf_dir)
    hour = F.floor(F.col("ts_ms") / HOUR)
    made = o.withColumn("spread_p95", F.when(hour % 5 == 1, -1.0).otherwise(F.col("spread_p95"))).withColumn("intensity", F.when(hour % 5 == 2, F.lit(float("nan"))).otherwise(F.col("intensity"))).withColumn("missing_ratio", F.when(hour % 10 == 1, 1.5).otherwise(0.0))
    sound, others = regime.quarantine(made)
    both = sound.select("symbol", F.lit("").alias("faults")).unionByName(others.select("symbol", flags("faults")))
    return both.groupBy("symbol", "faults").agg(F.count("*").alias("rows"))


@fx.shared
def _family_facts(spark, sf_dir) -> DataFrame:
    from .studies import exit_facts

    return exit_facts(_family_events(spark, sf_dir), fx.all_bars(spark, sf_dir).where("timeframe = 'BASE'"), fx.cost_buckets(spark), fx.HORIZON)


@fx.shared
def _family_events(spark, sf_dir) -> DataFrame:
    from .studies import exit_events

    return exit_events(fx.all_bars(spark, sf_dir), fx.LOOKBACK, fx.STRIDE, fx.HORIZON, HOUR, fx.MIN_TRAIN, fx.VALIDATION, fx.EMBARGO, fx.ideas(spark, sf_dir))


@query
def family_study(spark, sf_dir):
    """Every family, exit policy and cost scenario on validation events before the locked holdout, with a bootstrap interval."""
    from .studies import family_metrics

    m = family_metrics(_family_facts(spark, sf_dir), _family_events(spark, sf_dir), fx.SAMPLES, fx.BLOCK)
    return m.select("family", "policy", "scenario", "trades", "no_path", *(r(c) for c in ("expectancy_r", "win_rate", "max_drawdown_r", "gross_ev_r", "cost_drag_r", "lower_95", "upper_95")), "longest_losing_run")


@query
def failure_slices(spark, sf_dir):
    from .studies import failure_diagnostics

    ideas = candidates.families(fx.ideas(spark, sf_dir), fx.LOOKBACK).withColumn("candidate_id", F.col("family_candidate_id"))
    s = failure_diagnostics(_family_facts(spark, sf_dir), ideas)[0]
    return s.select("family", "dimension", "value", "n", *(r(c) for c in ("gross_ev_r", "net_ev_r", "win_rate")))


def _named_ideas(spark, sf_dir) -> DataFrame:
    return candidates.families(fx.ideas(spark, sf_dir), fx.LOOKBACK).withColumn("candidate_id", F.col("family_candidate_id"))


@query
def failure_correlations(spark, sf_dir):
    from .studies import failure_diagnostics

    return failure_diagnostics(_family_facts(spark, sf_dir), _named_ideas(spark, sf_dir))[1].select("family", "feature", "n", r("correlation"))


@query
def failure_geometry(spark, sf_dir):
    from .studies import failure_geometry as geometry

    g = geometry(_family_facts(spark, sf_dir), _named_ideas(spark, sf_dir), fx.all_bars(spark, sf_dir).where("timeframe = 'BASE'"), fx.HORIZON)
    return g.select("family", "paths", *(r(c) for c in g.columns if c.startswith("hit_")), r("ambiguity_rate"))


@query
def research_report(spark, sf_dir):
    """Every family and exit policy: performance with its interval, every cost scenario, and whether it is fragile."""
    from .studies import research_report as report

    p = report(_family_facts(spark, sf_dir), ["family"], fx.SAMPLES, fx.BLOCK)
    out = p.select("family", "policy", "trades", *(r(c) for c in ("expectancy_r", "lower_95", "upper_95", "gross_ev_r", "win_rate", "max_drawdown_r", "trades_per_week")), "longest_losing_run", "execution_fragile", F.explode("stress").alias("scenario", "stress_ev_r"))
    return out.withColumn("stress_ev_r", F.round("stress_ev_r", 6))


@query
def hypothesis_registry(spark, sf_dir):
    from .studies import registry

    per = _family_facts(spark, sf_dir).groupBy("family", "policy", "scenario").agg(F.count("*").alias("trades"))
    return registry(per, fx.STUDY)


@query
def arm_report(spark, sf_dir):
    from ..sources.sinks import arm_report as report

    m = stats.performance(_fold_outcomes(spark, sf_dir), ["symbol", "policy", "scenario"], ["exit_ms", "candidate_id"], "exit_ms")
    return report(m).select("symbol", "policy", "trades", r("expectancy_r"), r("stress_ev_r"), "execution_fragile")


def _selected(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from .studies import selected_after_train

    indexed = fx.indexed(spark, sf_dir)
    open_events = indexed.join(splits.final_holdout(indexed).select("symbol", "event_id"), ["symbol", "event_id"], "left_anti")
    return selected_after_train(fx.outcomes(spark, sf_dir), open_events, fx.MIN_TRAIN, fx.VALIDATION, fx.EMBARGO)


@query
def selected_policies(spark, sf_dir):
    """The exit policy that each fold's training rows choose, and what it makes on the fold's validation rows."""
    chosen, tried = _selected(spark, sf_dir)
    scored = tried.groupBy("symbol", "fold_id").agg(F.count("*").alias("valid_n"), F.avg("net_r").alias("valid_ev_r"))
    out = chosen.join(scored, ["symbol", "fold_id"], "left").na.fill(0, ["valid_n"])
    return out.select("symbol", "fold_id", "policy", "train_n", r("train_ev_r"), "valid_n", r("valid_ev_r"))


@query
def selected_arm(spark, sf_dir):
    """Performance of the arm that selects after training, out of sample."""
    p = stats.performance(_selected(spark, sf_dir)[1], ["symbol"], ["exit_ms", "candidate_id"], "exit_ms")
    return p.select("symbol", "trades", *(r(c) for c in ("expectancy_r", "win_rate", "mean_mae_r", "mean_mfe_r", "max_drawdown_r", "trades_per_week")), "longest_losing_run")


@query
def metrics_unpivot(spark, sf_dir):
    m = _plain(spark, sf_dir).groupBy("symbol").agg(F.avg("gross_r").alias("gross"), F.avg("cost_r").alias("cost"), F.avg("net_r").alias("net"))
    return m.unpivot("symbol", ["gross", "cost", "net"], "metric", "value").select("symbol", "metric", r("value"))


@query
def stream_bar_view(spark, sf_dir):
    b = stream_bars(fx.ticks(spark, sf_dir))
    return b.select("symbol", "bar_start_ms", "bar_end_ms", r("bid_open"), r("bid_close"), r("ask_high"), "tick_count", r("spread_median"), "extreme_count")
