"""Context of a candidate: the release calendar, time buckets, and what quotes do around a price level."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, prices
from ..schemas import PIP
from .sequence import interval_join

STATES = ("DIRECTIONAL_BREAKOUT", "SWEEP_RETURN", "SPREAD_SPIKE", "UNRESOLVED")


def event_guard(candidates: DataFrame, calendar: DataFrame, pre_ms: int = 300_000, post_ms: int = 900_000, strict: bool = False) -> DataFrame:
    """Each candidate with the nearest high-impact release from ``post_ms`` before it to ``pre_ms`` after it, the first on ties; HARD_VETO if there is one.

    Only snapshots known by the candidate's time count; ``strict`` makes a later snapshot in the band an error.
    """
    ideas = candidates.select("candidate_id", "symbol", "available_ms").withColumn("from_ms", F.col("available_ms") - post_ms).withColumn("to_ms", F.col("available_ms") + pre_ms)
    width = pre_ms + post_ms
    high = calendar.where("impact = 'HIGH'").select("event_code", "event_id", "currency", "scheduled_ms", "as_of_ms")
    cell = lambda c: F.floor(c / width).cast("long")
    listed = ideas.withColumn("cell", F.explode(F.sequence(cell(F.col("from_ms")), cell(F.col("to_ms")))))
    near = listed.join(high.withColumn("cell", cell(F.col("scheduled_ms"))), "cell").where("scheduled_ms BETWEEN from_ms AND to_ms")
    late = F.col("as_of_ms") > F.col("available_ms")
    near = near.where(F.when(late, F.raise_error(F.lit("a calendar snapshot is younger than the candidate")).cast("boolean")).otherwise(True)) if strict else near.where(~late)
    away = F.abs(F.col("available_ms") - F.col("scheduled_ms"))
    best = near.groupBy("candidate_id").agg(F.min_by(F.struct("event_code", "currency", "scheduled_ms"), F.struct(away, "scheduled_ms", "event_id")).alias("e"))
    out = ideas.join(best, "candidate_id", "left")
    veto = F.col("e").isNotNull()
    return out.select(
        "candidate_id", "symbol", "available_ms", F.when(veto, "HARD_VETO").otherwise("NEUTRAL").alias("effect"), F.coalesce("e.event_code", F.lit("NO_SCHEDULED_HIGH_IMPACT_EVENT")).alias("event"),
        ((F.col("available_ms") - F.col("e.scheduled_ms")) / 1000.0).alias("seconds_from_release"), F.when(veto, -1.0).otherwise(0.0).alias("signal"),
    )


def post_release(calendar: DataFrame, ticks: DataFrame, observe_ms: int, pip: float = PIP) -> DataFrame:
    """Ticks, median spread and range of mids of every symbol from each release to a cut-off; releases without ticks stay."""
    symbols = ticks.select("symbol").distinct()
    spans = calendar.select("event_id", "scheduled_ms").withColumn("cutoff_ms", F.col("scheduled_ms") + observe_ms).crossJoin(symbols)
    quotes = ticks.select("symbol", "time_ms", prices.spread_pips(pip).alias("spread"), prices.mid().alias("mid"))
    seen = interval_join(spans, quotes, "scheduled_ms", "cutoff_ms", "time_ms", observe_ms, observe_ms)
    per = seen.groupBy("event_id", "symbol").agg(F.count("*").alias("ticks"), F.percentile("spread", F.lit(0.5)).alias("median_spread"), ((F.max("mid") - F.min("mid")) / pip).alias("range_pips"))
    return spans.join(per, ["event_id", "symbol"], "left").na.fill(0, ["ticks"]).select("event_id", "symbol", "scheduled_ms", "ticks", "median_spread", "range_pips")


def level_excursions(candidates: DataFrame, ticks: DataFrame, search_ms: int, look_ahead_spread: bool = False, bucket_ms: int = 3_600_000) -> DataFrame:
    """First tick within ``search_ms`` of a candidate whose mid is a threshold away from its level: a tenth of the range measure or 1.5 spreads.

    The spread is that of the tick itself; with ``look_ahead_spread`` it is the median over all ticks searched, which looks ahead.
    """
    ideas = candidates.where("level > 0 AND atr > 0").select("candidate_id", "symbol", "direction", "level", "atr", "available_ms").withColumn("until_ms", F.col("available_ms") + search_ms)
    path = interval_join(ideas, ticks.select("symbol", "seq", "time_ms", "bid", "ask"), "available_ms", "until_ms", "time_ms", bucket_ms, search_ms)
    spread = F.col("ask") - F.col("bid")
    if look_ahead_spread:
        middle = path.groupBy("candidate_id").agg(F.percentile(spread, F.lit(0.5)).alias("__spread"))
        path, spread = path.join(middle, "candidate_id"), F.col("__spread")
    threshold = F.greatest(0.1 * F.col("atr"), 1.5 * F.greatest(spread, F.lit(0.0)))
    hit = path.withColumn("mid", prices.mid()).withColumn("threshold", threshold).where(F.abs(F.col("mid") - F.col("level")) >= F.col("threshold"))
    first = hit.groupBy("candidate_id", "symbol", "direction", "level", "atr").agg(F.min_by(F.struct("seq", "time_ms", "mid", "threshold"), "seq").alias("e"))
    side = F.when(F.col("e.mid") > F.col("level"), 1).otherwise(-1)
    return first.select("candidate_id", "symbol", "direction", "level", "atr", F.col("e.seq").alias("event_seq"), F.col("e.time_ms").alias("event_ms"), F.col("e.mid").alias("event_mid"), F.col("e.threshold").alias("threshold"), side.alias("side"), F.when(prices.is_long(), 1).otherwise(-1).alias("sign"))


def _clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def window_features(events: DataFrame, ticks: DataFrame, pre_ms: int = 30_000, excursion_ms: int = 15_000, post_ms: int = 45_000, baseline: DataFrame | None = None, pip: float = PIP, baseline_keys: list[str] = ["symbol"]) -> DataFrame:
    """Fourteen numbers on the quotes before, during and after each event, by conditional aggregates over one interval join.

    An empty stretch after the excursion falls back to the excursion, an empty one before it to the excursion's first tick. ``baseline`` has (symbol, feature, median, mad, n) for ``tick_intensity`` and ``spread_pips``;
    with ``baseline_keys`` of symbol and session that of the event's session counts. ``baseline_n`` is the least n over its features, 0 without any.
    """
    spans = events.withColumn("__a", F.col("event_ms") - pre_ms).withColumn("__b", F.col("event_ms") + post_ms)
    around = interval_join(spans, ticks.select("symbol", "seq", "time_ms", "bid", "ask", "flags"), "__a", "__b", "time_ms", pre_ms + post_ms, pre_ms + post_ms)
    segment = F.when(F.col("seq") < F.col("event_seq"), "pre").when(F.col("time_ms") <= F.col("event_ms") + excursion_ms, "exc").otherwise("post")
    around = around.withColumn("seg", segment).withColumn("mid", prices.mid()).withColumn("spread", prices.spread_pips(pip))
    w = Window.partitionBy("candidate_id", "seg").orderBy("seq")
    step = F.signum(F.col("mid") - F.lag("mid").over(w))
    around = around.withColumn("step", step)
    ident = ["candidate_id", "symbol", "direction", "level", "atr", "event_ms", "side", "sign"]

    def per(seg: str) -> list[Column]:
        own = F.col("seg") == seg
        pick = lambda c: F.when(own, F.col(c))
        return [
            F.count_if(own).alias(f"{seg}_n"), F.min(pick("time_ms")).alias(f"{seg}_t0"), F.max(pick("time_ms")).alias(f"{seg}_t1"), F.sum(pick("step")).alias(f"{seg}_sum"), F.count_if(own & (F.col("step") != 0)).alias(f"{seg}_active"),
            F.count_if(own & (F.col("step") == F.col("sign"))).alias(f"{seg}_with"), F.percentile(pick("spread"), F.lit(0.5)).alias(f"{seg}_spread"), F.min_by("mid", F.when(own, F.col("seq"))).alias(f"{seg}_first"), F.max_by("mid", F.when(own, F.col("seq"))).alias(f"{seg}_last"),
        ]

    a = around.groupBy(*ident).agg(
        *per("pre"), *per("exc"), *per("post"), F.max("spread").alias("peak"), F.max(F.when(F.col("seg") == "exc", F.col("side") * (F.col("mid") - F.col("level")))).alias("deepest"),
        F.count_if(prices.bid_changed()).alias("bids"), F.count_if(prices.ask_changed()).alias("asks"),
    )
    after = lambda c: F.when(F.col("post_n") > 0, F.col(f"post_{c}")).otherwise(F.col(f"exc_{c}"))
    imbalance = lambda total, n: F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0))
    n, active = after("n"), after("active")
    intensity = F.when(n < 2, 0.0).otherwise((n - 1) / F.greatest((after("t1") - after("t0")) / 1000.0, F.lit(1e-3)))
    if baseline is None:
        z = lambda feature, x: F.lit(0.0)
        base_spread, baseline_n = F.lit(None).cast("double"), F.lit(0).cast("long")
    else:
        known = F.min(F.col("n") if "n" in baseline.columns else F.lit(0).cast("long")).alias("__known")
        wide = baseline.groupBy(*baseline_keys).agg(known, *(F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{f}_{c}") for f in ("tick_intensity", "spread_pips") for c in ("median", "mad")))
        if "session" in baseline_keys:
            a = a.withColumn("session", clock.session(F.col("event_ms")))
        a = a.join(wide, baseline_keys, "left")
        baseline_n = F.coalesce("__known", F.lit(0).cast("long"))
        z = lambda feature, x: F.coalesce((x - F.col(f"{feature}_median")) / F.greatest(1.4826 * F.col(f"{feature}_mad"), F.lit(1e-9)), F.lit(0.0))
        base_spread = F.when(F.col("spread_pips_median") != 0, F.col("spread_pips_median"))
    post_spread = F.greatest(after("spread"), F.lit(1e-9))
    final = F.col("side") * (after("last") - F.col("level"))
    deepest = F.greatest(F.col("deepest"), F.lit(1e-12))
    quotes = (F.col("bids") + F.col("asks")).cast("double")
    values = {
        "tick_intensity": intensity,
        "tick_intensity_z": z("tick_intensity", intensity),
        "imbalance_pre": F.when(F.col("pre_n") > 0, imbalance(F.col("pre_sum"), F.nullif("pre_active", F.lit(0)))).otherwise(0.0) * F.col("sign"),
        "imbalance_post": imbalance(after("sum"), F.nullif(active, F.lit(0))) * F.col("sign"),
        "persistence": F.coalesce(F.try_divide(after("with").cast("double"), F.nullif(active, F.lit(0))), F.lit(0.5)),
        "spread_peak": F.col("peak"),
        "spread_peak_z": z("spread_pips", F.col("peak")),
        "spread_normalization": _clip(F.coalesce(base_spread, post_spread) / post_spread),
        "penetration": F.col("deepest") / F.col("atr"),
        "rejection": _clip((F.col("deepest") - final) / deepest),
        "close_location": _clip(final / deepest),
        "impact_per_tick": F.abs(F.col("exc_last") - F.col("exc_first")) / pip / F.greatest(F.lit(1), F.col("exc_n") - 1),
        "quote_asymmetry": F.coalesce(F.try_divide((F.col("bids") - F.col("asks")).cast("double"), quotes), F.lit(0.0)) * F.col("sign"),
        "alignment": (F.col("side") * F.col("sign")).cast("double"),
    }
    return a.select("candidate_id", "symbol", "direction", "event_ms", *(v.alias(k) for k, v in values.items()), baseline_n.alias("baseline_n"))


def classify_states(features: DataFrame, baseline_n: Column | None = None) -> DataFrame:
    """Softmax (temperature 4) over four state scores; the best state, its margin, a signal and a confidence. Ties keep the order of ``STATES``."""
    f = F.col
    reversal = _clip(-f("imbalance_pre") * f("imbalance_post"))
    intensity, quote = _clip((f("tick_intensity_z") + 1) / 4), _clip((f("quote_asymmetry") + 1) / 2)
    scores = {
        "DIRECTIONAL_BREAKOUT": _clip(0.25 * f("persistence") + 0.20 * f("spread_normalization") + 0.20 * f("close_location") + 0.20 * intensity + 0.15 * quote) * _clip((f("alignment") + 1) / 2),
        "SWEEP_RETURN": _clip(0.45 * f("rejection") + 0.20 * f("spread_normalization") + 0.20 * reversal + 0.15 * (1 - f("close_location"))) * _clip((1 - f("alignment")) / 2),
        "SPREAD_SPIKE": _clip(0.65 * _clip(f("spread_peak_z") / 4) + 0.35 * (1 - f("spread_normalization"))),
        "UNRESOLVED": F.lit(0.35),
    }
    scored = features.select("*", *(v.alias(f"s_{k}") for k, v in scores.items()))
    top = F.greatest(*(F.col(f"s_{k}") for k in STATES))
    weights = scored.withColumns({f"w_{k}": F.exp(4.0 * (F.col(f"s_{k}") - top)) for k in STATES})
    total = sum((F.col(f"w_{k}") for k in STATES), F.lit(0.0))
    shares = weights.withColumns({f"p_{k}": F.col(f"w_{k}") / total for k in STATES})
    # the order of the states breaks ties: the first one has the largest last field
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(F.col(f"p_{k}").alias("p"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(STATES)))))
    out = shares.withColumn("__r", ranked).withColumn("state", F.col("__r")[0]["k"]).withColumn("probability", F.col("__r")[0]["p"]).withColumn("margin", F.col("__r")[0]["p"] - F.col("__r")[1]["p"])
    signal = F.when(F.col("state").isin("DIRECTIONAL_BREAKOUT", "SWEEP_RETURN"), F.col("probability")).when(F.col("state") == "SPREAD_SPIKE", -F.col("probability")).otherwise(0.0)
    factor = F.lit(0.5) if baseline_n is None else F.when(baseline_n > 0, F.least(F.lit(1.0), baseline_n / 100.0)).otherwise(0.5)
    out = out.withColumn("signal", signal).withColumn("confidence", _clip(_clip(0.35 + 1.5 * F.col("margin")) * factor))
    effect = F.when(F.col("signal") > 0.15, "SUPPORT").when(F.col("signal") < -0.15, "CONTRADICT").otherwise("NEUTRAL")
    return out.withColumn("effect", effect).drop("__r", *(f"{x}_{k}" for x in "sw" for k in STATES))


def hazard_annotations(candidates: DataFrame, posterior: DataFrame, bucket: list[str], approved: bool = False) -> DataFrame:
    """A soft veto for candidates of an approved, well-filled time bucket whose interval lies below zero."""
    joined = candidates.join(posterior, bucket, "left")
    veto = F.lit(approved) & F.coalesce(F.col("actionable") & (F.col("upper_95") < 0), F.lit(False))
    return joined.withColumn("effect", F.when(veto, "SOFT_VETO").otherwise("NEUTRAL")).withColumn("signal", F.when(veto, -F.least(F.lit(1.0), F.abs(F.col("mean_r")))).otherwise(0.0)).withColumn("confidence", F.coalesce(F.col("actionable").cast("double"), F.lit(0.0)))


def time_context(df: DataFrame, ms: str, half_width: float = 15.0) -> DataFrame:
    """Add session, summer-time state and the benchmark window (if any) of a time."""
    t = F.col(ms)
    near = F.coalesce(*(F.when(F.abs(clock.benchmark_minutes(t, n)) <= half_width, n) for n in clock.BENCHMARKS), F.lit("NONE"))
    return df.withColumn("session", clock.session(t)).withColumn("dst_state", clock.dst_state(t)).withColumn("benchmark", near)
