"""Studies put together from operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import bars, candidates, labels, splits, stats
from ..schemas import PIP

HORIZONS = (1, 3, 6, 12, 24, 36)
#: The exit policies compared, and the context modules whose combinations are.
EXIT_ARMS = {"A_FIXED": "FIXED_RR", "B_DYNAMIC": "DYNAMIC_RR", "C_STRUCTURE_LIQUIDITY": "STRUCTURE_TARGET", "D_PARTIAL": "PARTIAL_TRAILING", "E_BEST_OUT_OF_SAMPLE": "SELECTED_AFTER_TRAIN"}
MODULES = ("TICK", "TIME", "REGIME")


def module_arms() -> list[tuple[str, tuple[str, ...]]]:
    """No module, each one, each two, all, and all but each one: named arms with their modules."""
    some = [c for n in (1, 2) for c in combinations(MODULES, n)]
    without = [(f"FULL_WITHOUT_{m}", tuple(x for x in MODULES if x != m)) for m in MODULES]
    return [("BASELINE", ()), *(("_".join(c), c) for c in some), ("FULL", MODULES), *without]


def arms(spark: SparkSession) -> DataFrame:
    """The ablation arms as a dimension."""
    exits = [("EXIT", name, [policy], i) for i, (name, policy) in enumerate(EXIT_ARMS.items())]
    return spark.createDataFrame(exits + [("MODULE", name, list(parts), i) for i, (name, parts) in enumerate(module_arms())], "kind string, arm string, parts array<string>, place int")


def session_study(base: DataFrame, width: int, discovery_end: int, confirmation_end: int, horizons: tuple[int, ...] = HORIZONS, pip: float = PIP, samples: int = 500, block: int = 5) -> DataFrame:
    """Returns from session opens over several horizons, by period, with a bootstrap interval of their mean in order of time. A horizon counts only if its bar is exactly that many widths later; of the locked period only n is made, the returns being masked before they are aggregated."""
    w = Window.partitionBy("symbol").orderBy("bar_start_ms")
    ahead = [F.struct(F.lit(h).alias("horizon"), F.lead("bar_start_ms", h).over(w).alias("at"), F.lead("bid_close", h).over(w).alias("close")) for h in horizons]
    listed = base.withColumn("event", clock.session_open(F.col("bar_start_ms"))).withColumn("ahead", F.array(*ahead)).where(F.col("event").isNotNull() & bars.usable())
    rows = listed.withColumn("a", F.explode("ahead")).where(F.col("a.at") == F.col("bar_start_ms") + F.col("a.horizon") * width)
    period = clock.period(F.col("bar_start_ms"), discovery_end, confirmation_end)
    open_only = F.when(period != "LOCKED_HOLDOUT", (F.col("a.close") - F.col("ask_open")) / pip)
    shown = rows.select("event", period.alias("period"), F.col("a.horizon").alias("horizon"), open_only.alias("pips"), "symbol", "bar_start_ms")
    keys = ["event", "period", "horizon"]
    interval = stats.block_bootstrap(shown.where("pips IS NOT NULL"), keys, ["bar_start_ms", "symbol"], "pips", block, samples).select(*keys, "lower_95", "upper_95")
    means = shown.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("pips").alias("mean_pips"), F.percentile("pips", F.lit(0.5)).alias("median_pips"))
    return means.join(interval, keys, "left")


def exit_events(all_bars: DataFrame, lookback: int, stride: int, horizon: int, width: int, min_train: int, validation: int, embargo_ms: int, ideas: DataFrame | None = None) -> DataFrame:
    """Candidates of all families that are validation events of the folds before the locked holdout, with ``family`` and ``fold_id``."""
    made = candidates.families(candidates.generate(all_bars, lookback=lookback, stride=stride) if ideas is None else ideas, lookback)
    # a family's candidates are numbered on their own
    named = made.withColumn("group", F.concat_ws("/", "family", "symbol")).withColumn("event_id", F.col("family_candidate_id"))
    events = named.select(F.col("group").alias("symbol"), "event_id", F.col("available_ms").alias("start_ms"), (F.col("available_ms") + horizon * width).alias("label_end_ms"))
    indexed = splits.numbered(events)
    held = splits.final_holdout(indexed).select("symbol", "event_id")
    folds = splits.walk_forward(indexed.join(held, ["symbol", "event_id"], "left_anti"), min_train, validation, embargo_ms, roles=("VALIDATION",)).select("event_id", "fold_id")
    return named.join(folds, "event_id").withColumn("candidate_id", F.col("event_id"))


def exit_facts(chosen: DataFrame, base: DataFrame, buckets: DataFrame, horizon: int) -> DataFrame:
    """Outcomes of the events of :func:`exit_events` by policy and scenario."""
    return labels.bar_outcomes(chosen, base, buckets, horizon).join(chosen.select("candidate_id", "family", "fold_id"), "candidate_id")


def exit_ablation(all_bars: DataFrame, buckets: DataFrame, lookback: int, stride: int, horizon: int, width: int, min_train: int, validation: int, embargo_ms: int, samples: int = 500, block: int = 5, ideas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts and metrics of all families out of sample: candidates are made and frozen once, folds come before the locked holdout, and only validation events are evaluated.

    Metrics read the facts several times. Where these are not small, write :func:`exit_events` and :func:`exit_facts` down and call :func:`family_metrics`.
    """
    chosen = exit_events(all_bars, lookback, stride, horizon, width, min_train, validation, embargo_ms, ideas)
    facts = exit_facts(chosen, all_bars.where("timeframe = 'BASE'"), buckets, horizon)
    return facts, family_metrics(facts, chosen, samples, block)


def family_metrics(facts: DataFrame, chosen: DataFrame, samples: int = 500, block: int = 5) -> DataFrame:
    """Performance, interval, cost drag and candidates without a path (of ``chosen``) for each family, policy and scenario. ``facts`` are read several times, so give a written table."""
    keys, order = ["family", "policy", "scenario"], ["exit_ms", "candidate_id"]
    metrics = stats.performance(facts, keys, order, "exit_ms").join(stats.block_bootstrap(facts, keys, order, block=block, samples=samples).drop("n"), keys)
    more = facts.groupBy(*keys).agg(F.avg("gross_r").alias("gross_ev_r"), F.avg("cost_r").alias("cost_drag_r"))
    pathless = chosen.join(facts.select("candidate_id").distinct(), "candidate_id", "left_anti").groupBy("family").agg(F.count("*").alias("no_path"))
    return metrics.join(more, keys).join(pathless, "family", "left").na.fill(0, ["no_path"])


def selected_after_train(outcomes: DataFrame, indexed: DataFrame, min_train: int, validation: int, embargo_ms: int, scenario: str = "BASELINE_1X") -> tuple[DataFrame, DataFrame]:
    """The arm that picks its exit policy by the training rows of each fold: the choices (symbol, fold_id, policy, train_n, train_ev_r) and the outcomes of the chosen policies on the folds' validation rows, with ``fold_id``.

    The policy with the highest mean net result in training is chosen, the first in order of ``POLICIES`` among equals (to nine digits). Training
    sums come from sums per validation block, added up, less those of the purged events: no training row is listed once per fold.
    """
    folds, purged = splits.walk_forward_ranges(indexed, min_train, validation, embargo_ms)
    own = outcomes.where(F.col("scenario") == scenario).withColumnRenamed("candidate_id", "event_id")
    placed = own.join(indexed.select("symbol", "event_id", F.col("idx").cast("long").alias("idx")), ["symbol", "event_id"])
    block = F.greatest(F.lit(-1).cast("long"), F.floor((F.col("idx") - min_train) / validation))
    sums = placed.groupBy("symbol", "policy", block.alias("block")).agg(F.count("*").alias("n"), F.sum("net_r").alias("s"))
    # a policy's sums up to a block: blocks are as many as folds, at most
    blocks = folds.select("symbol", "fold_id", "lo", "hi", F.floor((F.col("lo") - min_train) / validation).alias("at"))
    upto = blocks.join(sums, "symbol").where("block < at").groupBy("symbol", "fold_id", "policy").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    lost = purged.join(own.select("symbol", "event_id", "policy", "net_r"), ["symbol", "event_id"]).groupBy("symbol", "fold_id", "policy").agg(F.count("*").alias("__n"), F.sum("net_r").alias("__s"))
    keys = ["symbol", "fold_id", "policy"]
    trained = upto.join(lost, keys, "left").withColumn("train_n", F.col("n") - F.coalesce("__n", F.lit(0))).where("train_n > 0")
    trained = trained.withColumn("train_ev_r", (F.col("s") - F.coalesce("__s", F.lit(0.0))) / F.col("train_n"))
    place = F.array_position(F.array(*map(F.lit, labels.POLICIES)), F.col("policy"))
    best = trained.groupBy("symbol", "fold_id").agg(F.max_by(F.struct("policy", "train_n", "train_ev_r"), F.struct(F.round("train_ev_r", 9), -place)).alias("b"))
    chosen = best.select("symbol", "fold_id", "b.*")
    spans = blocks.join(chosen.select(*keys), ["symbol", "fold_id"]).withColumn("idx", F.explode(F.sequence("lo", "hi"))).select(*keys, "idx")
    return chosen, placed.join(spans, ["symbol", "policy", "idx"]).withColumnRenamed("event_id", "candidate_id").drop("idx")


def failure_diagnostics(facts: DataFrame, ideas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices and feature correlations of the plain fixed-target results, joined to their candidates."""
    plain = facts.where("policy = 'FIXED_RR' AND scenario = 'BASELINE_1X'").join(ideas.select("candidate_id", "past_median", "impulse"), "candidate_id")
    timed = plain.withColumn("hour", clock.utc_hour(F.col("available_ms"))).withColumn("weekday", clock.weekday(F.col("available_ms")))
    return stats.slices(timed, ["direction", "session", "regime", "hour", "weekday"], ["family"]), stats.correlations(plain, ["past_median", "impulse"], "gross_r", ["family"])


def failure_geometry(facts: DataFrame, ideas: DataFrame, base: DataFrame, horizon: int) -> DataFrame:
    """Outcome geometry by family, over the candidates that have a plain fixed-target result. ``ideas`` has ``family`` and the ids of ``facts``."""
    tried = facts.where("policy = 'FIXED_RR' AND scenario = 'BASELINE_1X'").select("candidate_id")
    return labels.outcome_geometry(ideas.join(tried, "candidate_id", "left_semi"), base, horizon, ["family"])


def failure_analysis(facts: DataFrame, ideas: DataFrame, base: DataFrame, horizon: int) -> DataFrame:
    """A row per family: its plain fixed-target trades out of sample, their slices by dimension, correlations by feature, and the geometry of their paths."""
    sliced, correlated = failure_diagnostics(facts, ideas)
    geometry = failure_geometry(facts, ideas, base, horizon)
    per = facts.where("policy = 'FIXED_RR' AND scenario = 'BASELINE_1X'").groupBy("family").agg(F.count("*").alias("oos_trades"))
    # families, dimensions and values are few by design
    by = sliced.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("dimension", "value", "n", "gross_ev_r", "net_ev_r", "win_rate"))).alias("slices"))
    features = correlated.groupBy("family").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "correlation")))).alias("correlations"))
    shape = geometry.select("family", F.struct("paths", *(c for c in geometry.columns if c.startswith("hit_")), "ambiguity_rate").alias("geometry"))
    return per.join(by, "family", "left").join(features, "family", "left").join(shape, "family", "left")


def research_report(facts: DataFrame, keys: list[str], samples: int = 500, block: int = 5) -> DataFrame:
    """A row per policy (and ``keys``) of its plain scenario: performance, interval, the gross mean, its mean under every other cost scenario, whether 1.25 times the cost ends it, and the lineage of its trades."""
    arm, order = [*keys, "policy"], ["exit_ms", "candidate_id"]
    plain = facts.where("scenario = 'BASELINE_1X'")
    perf = stats.performance(plain, arm, order, "exit_ms").join(stats.block_bootstrap(plain, arm, order, block=block, samples=samples).select(*arm, "lower_95", "upper_95"), arm)
    lineage = candidates.fingerprint(plain, ["candidate_id", "exit_ms"], arm).select(*arm, F.col("fingerprint").alias("lineage"))
    gross = plain.groupBy(*arm).agg(F.avg("gross_r").alias("gross_ev_r"))
    stress = facts.where("scenario <> 'BASELINE_1X'").groupBy(*arm, "scenario").agg(F.avg("net_r").alias("net_ev_r"))
    stress = stress.groupBy(*arm).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario", "net_ev_r")))).alias("stress"))
    out = perf.join(gross, arm).join(stress, arm, "left").join(lineage, arm)
    return out.withColumn("execution_fragile", F.coalesce(F.col("stress")["BASELINE_1.25X"] <= 0, F.lit(False)))


def registry(metrics: DataFrame, config: str) -> DataFrame:
    """A row per family and the digest of its configuration; families with trades out of sample have been tested, the others lack data."""
    per = metrics.groupBy("family").agg(F.max("trades").alias("trades"))
    return per.select("family", F.sha2(F.lit(config), 256).alias("config_sha256"), F.when(F.col("trades") > 0, "REJECTED").otherwise("INSUFFICIENT_DATA").alias("status"))
