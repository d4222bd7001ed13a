"""Feed quality and history audit: anomalies are counted and flagged, never repaired."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, prices
from ..schemas import PIP
from . import selection
from .sequence import CHUNK, with_previous

SUMMARY = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per key with named percentiles, by linear interpolation; see :mod:`.selection`."""
    return selection.percentiles(rows, keys, value, shares).drop("n")


def feed_quality(ticks: DataFrame, keys: list[str] = ["symbol"], expected_interval: int | None = None, gap_threshold: int | None = None, pip: float = PIP, chunk: int = CHUNK, expected: DataFrame | None = None, feed: list[str] = ["symbol"]) -> DataFrame:
    """One row per key (and per row of ``expected`` keys, which may have no ticks; ticks follow each other within a ``feed``): order, equal times, repeats, crossed and non-positive quotes, gaps, inferred missing share, spreads of valid quotes, and the hard failures that make a feed unusable."""
    step = F.col("time_ms") - F.col("prev_time_ms")
    moved = with_previous(ticks, ["time_ms"], chunk, feed=feed).withColumn("step", step).withColumn("spread", F.when(prices.valid_quote(), prices.spread_pips(pip)))
    missing = F.greatest(F.lit(0), F.ceil(F.col("step") / expected_interval) - 1) if expected_interval else F.lit(None).cast("long")
    out = moved.groupBy(*keys).agg(
        F.count("*").alias("tick_count"),
        F.count_if(F.col("step") < 0).alias("out_of_order"),
        F.count_if(F.col("step") == 0).alias("equal_times"),
        F.count_if(F.col("bid") > F.col("ask")).alias("crossed"),
        F.count_if((F.col("bid") <= 0) | (F.col("ask") <= 0)).alias("nonpositive"),
        (F.count_if(F.col("step") > gap_threshold) if gap_threshold else F.lit(0).cast("long")).alias("gaps"),
        F.sum(F.when(F.col("step") > (expected_interval or 0), missing).otherwise(0) if expected_interval else missing).alias("missing"),
    )
    once = moved.groupBy(*dict.fromkeys([*keys, "symbol", "time_ms", "bid", "ask", "flags"])).agg((F.count("*") - 1).alias("more"))
    out = out.join(once.groupBy(*keys).agg(F.sum("more").alias("duplicates")), keys)
    out = out.join(exact_percentiles(moved, keys, "spread", {"spread_median": 0.5, "spread_p95": 0.95}), keys, "left")
    if expected is not None:
        out = expected.select(*keys).distinct().join(out, keys, "left").na.fill(0, [c for c in out.columns if c not in (*keys, "missing", "spread_median", "spread_p95")])
    failures = F.array_compact(F.array(F.when(F.col("tick_count") == 0, "EMPTY"), F.when(F.col("out_of_order") > 0, "OUT_OF_ORDER_TICKS"), F.when(F.col("crossed") > 0, "CROSSED_QUOTES"), F.when(F.col("nonpositive") > 0, "NONPOSITIVE_QUOTES")))
    return (
        out.withColumn("duplicate_ratio", F.coalesce(F.try_divide(F.col("duplicates"), F.col("tick_count")), F.lit(0.0)))
        .withColumn("missing_ratio", F.try_divide(F.col("missing").cast("double"), F.col("tick_count") + F.col("missing")))
        .withColumn("hard_failures", failures)
        .withColumn("valid", F.size("hard_failures") == 0)
    )


def gate(ticks: DataFrame, quality: DataFrame, strict: bool = False, feed: list[str] = ["symbol"]) -> DataFrame:
    """Ticks of the feeds without hard failure; ``strict`` makes a failed feed an error."""
    if strict:
        checked = quality.select(*feed, F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat_ws(", ", F.lit("feed refused"), *(F.col(c).cast("string") for c in feed), "hard_failures")).cast("boolean")).alias("__ok"))
        return ticks.join(checked, feed, "left").where(F.coalesce("__ok", F.lit(False))).drop("__ok")
    return ticks.join(quality.where("valid").select(*feed), feed, "left_semi")


CHUNK_KEY = ["symbol", "chunk_start_ms"]


def with_chunk(ticks: DataFrame, start_ms: int, step: int) -> DataFrame:
    """Add ``chunk_start_ms``, the start of the chunk of ``step`` that a tick's time lies in."""
    return ticks.withColumn("chunk_start_ms", (F.lit(start_ms) + F.floor((F.col("time_ms") - start_ms) / step) * step).cast("long"))


def chunk_quality(ticks: DataFrame, chunks: DataFrame | None = None, **limits) -> DataFrame:
    """:func:`feed_quality` of every (symbol, chunk) on its own: the first tick of a chunk has none before it, and each of ``chunks`` has a verdict even without ticks."""
    return feed_quality(ticks, CHUNK_KEY, expected=chunks, feed=CHUNK_KEY, **limits)


def latest_entries(ledger: DataFrame) -> DataFrame:
    """The last entry of every (symbol, chunk): of the highest ``run`` (entries without one come first), and of equal runs the fullest."""
    run = F.coalesce(F.col("run"), F.lit(0)) if "run" in ledger.columns else F.lit(0)
    rest = [c for c in ledger.columns if c not in CHUNK_KEY]
    last = ledger.groupBy(*CHUNK_KEY).agg(F.max_by(F.struct(*rest), F.struct(run, "tick_count", "status")).alias("__e"))
    return last.select(*(F.col(c) if c in CHUNK_KEY else F.col(f"__e.{c}").alias(c) for c in ledger.columns))


def gap_observations(ticks: DataFrame, limit: int, chunk: int = CHUNK) -> DataFrame:
    """Gaps over the limit that are not wholly inside a weekend, with their class: an expected closure if they touch one, else suspicious."""
    before = with_previous(ticks, ["time_ms", "bid", "ask"], chunk)
    a, b = F.col("prev_time_ms"), F.col("time_ms")
    odd = before.where((b - a > limit) & ~clock.inside_weekend(a, b))
    return odd.select(
        "symbol", "seq", a.alias("from_ms"), b.alias("to_ms"), (b - a).alias("gap_ms"), clock.utc_hour(a).alias("utc_hour"), "prev_bid", "prev_ask", F.col("bid").alias("next_bid"), F.col("ask").alias("next_ask"),
        F.when(clock.touches_weekend(a, b), "EXPECTED_CLOSURE").otherwise("SUSPICIOUS").alias("gap_class"),
    )


def spread_summary(ticks: DataFrame, keys: list[str], pip: float = PIP) -> DataFrame:
    """Seven numbers of the spreads of valid quotes, by linear interpolation."""
    valid = ticks.where(prices.valid_quote()).withColumn("spread", prices.spread_pips(pip))
    return exact_percentiles(valid, keys, "spread", {"min": 0.0, **SUMMARY, "max": 1.0})


_PROFILE = {"spread_p50": 0.5, "spread_p95": 0.95}


def _profile_measures(extreme: float) -> list[Column]:
    s = F.col("spread")
    return [F.count(s).alias("valid_quotes"), F.count_if(s == 0).alias("zero_spreads"), F.count_if(s >= extreme).alias("extreme_spreads")]


def daily_profile(ticks: DataFrame, extreme: float = 5.0, pip: float = PIP) -> DataFrame:
    """One row per symbol and UTC day. Ticks of a weekend day are not counted as trading ticks; its quotes are."""
    t = ticks.withColumn("day", clock.day_number(F.col("time_ms"))).withColumn("spread", F.when(prices.valid_quote(), prices.spread_pips(pip)))
    per = t.groupBy("symbol", "day").agg(F.count_if(clock.weekday(F.col("time_ms")) < 5).alias("trading_ticks"), *_profile_measures(extreme))
    per = per.join(exact_percentiles(t, ["symbol", "day"], "spread", _PROFILE), ["symbol", "day"], "left")
    return per.withColumn("zero_ratio", _share("zero_spreads", "valid_quotes"))


def hourly_profile(ticks: DataFrame, extreme: float = 5.0, pip: float = PIP) -> DataFrame:
    """One row per symbol and UTC hour, all 24 of them."""
    t = ticks.withColumn("hour", clock.utc_hour(F.col("time_ms"))).withColumn("spread", F.when(prices.valid_quote(), prices.spread_pips(pip)))
    per = t.groupBy("symbol", "hour").agg(F.count("*").alias("ticks"), *_profile_measures(extreme))
    per = per.join(exact_percentiles(t, ["symbol", "hour"], "spread", _PROFILE), ["symbol", "hour"], "left")
    spine = ticks.select("symbol").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = spine.join(per, ["symbol", "hour"], "left").na.fill(0, ["ticks", "valid_quotes", "zero_spreads", "extreme_spreads"])
    return full.withColumn("zero_ratio", _share("zero_spreads", "valid_quotes"))


def duplicates_by_day(ticks: DataFrame) -> DataFrame:
    same = ticks.groupBy("symbol", "time_ms", "bid", "ask", "flags").agg(F.count("*").alias("n")).where("n > 1")
    return same.groupBy("symbol", clock.day_number(F.col("time_ms")).alias("day")).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def low_density_days(daily: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Trading days with under a fraction of the symbol's median number of ticks."""
    days = daily.where("trading_ticks > 0").select("symbol", "day", "trading_ticks")
    middle = days.groupBy("symbol").agg(F.percentile("trading_ticks", F.lit(0.5)).alias("median_ticks"))
    return days.join(middle, "symbol").where(F.col("trading_ticks") < F.col("median_ticks") * fraction)


def most_affected_hour(hourly: DataFrame) -> DataFrame:
    """The UTC hour with most extreme spreads (the earliest on ties), and its share of them."""
    per = hourly.where("extreme_spreads > 0").groupBy("symbol").agg(F.max_by("hour", F.struct("extreme_spreads", -F.col("hour"))).alias("hour"), F.max("extreme_spreads").alias("extreme_spreads"), F.sum("extreme_spreads").alias("total"))
    return per.withColumn("percent", 100.0 * F.col("extreme_spreads") / F.col("total"))


def chunk_calendar(spark, start_ms: int, end_ms: int, step: int) -> DataFrame:
    """Half-open chunks of a range; the last one may be short."""
    n = -(-(end_ms - start_ms) // step)
    start = F.lit(start_ms) + F.col("id") * step
    return spark.range(n).select(start.alias("chunk_start_ms"), F.least(start + step, F.lit(end_ms)).alias("chunk_end_ms"))


def chunk_coverage(expected: DataFrame, files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each expected (symbol, chunk) beside its file and its ledger entry, with a status.

    ``files`` has (symbol, chunk_start_ms, file_ticks), ``ledger`` (symbol, chunk_start_ms, chunk_end_ms, tick_count, status), of which the last
    entry of a chunk counts. Missing ledger entries are found first; a chunk wholly in the weekend must be in the ledger only, with no ticks.
    """
    key = ["symbol", "chunk_start_ms"]
    entry = latest_entries(ledger).select(*key, F.col("chunk_end_ms").alias("ledger_end_ms"), F.col("tick_count").alias("ledger_ticks"), F.col("status").alias("ledger_status"))
    both = expected.join(files, key, "left").join(entry, key, "left")
    weekend = clock.inside_weekend(F.col("chunk_start_ms"), F.col("chunk_end_ms"))
    no_file = F.col("file_ticks").isNull()
    status = (
        F.when(F.col("ledger_status").isNull(), "MISSING_LEDGER")
        .when(F.col("ledger_end_ms") != F.col("chunk_end_ms"), "LEDGER_MISMATCH")
        .when(weekend & no_file & (F.col("ledger_ticks") == 0), "EXPECTED_MARKET_CLOSED")
        .when(weekend, "LEDGER_MISMATCH")
        .when(F.col("ledger_status") == "NO_BROKER_HISTORY", "MISSING_HISTORY")
        .when(no_file, "MISSING_FILE")
        .when(F.col("file_ticks") != F.col("ledger_ticks"), "COUNT_MISMATCH")
        .otherwise("COMPLETED")
    )
    return both.withColumn("chunk_status", status)


def orphans(expected: DataFrame, files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files and ledger entries that no expected chunk asks for."""
    key = ["symbol", "chunk_start_ms"]
    stray = lambda df, kind: df.join(expected, key, "left_anti").select(*key, F.lit(kind).alias("kind"))
    return stray(files, "FILE").unionByName(stray(ledger, "LEDGER"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("chunk_status").isin(*names))
    out = coverage.groupBy("symbol").agg(F.count("*").alias("expected"), n("COMPLETED").alias("completed"), n("EXPECTED_MARKET_CLOSED").alias("closed"), F.count_if(F.col("chunk_status").startswith("MISSING")).alias("missing"), n("LEDGER_MISMATCH", "COUNT_MISMATCH").alias("mismatches"))
    out = out.withColumn("percent", 100.0 * (F.col("completed") + F.col("closed")) / F.col("expected"))
    return out.withColumn("severity", F.when((F.col("missing") > 0) | (F.col("mismatches") > 0), "FAIL").otherwise("PASS"))
