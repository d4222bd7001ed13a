"""OHLC bars of any width from ticks, with exact spread statistics and quality flags."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, prices
from ..schemas import HOUR, PIP
from .sequence import CHUNK, with_previous

#: (name, width in ms), each a multiple of the one before.
TIMEFRAMES = (("BASE", HOUR), ("MID", 3 * HOUR), ("TOP", 12 * HOUR))


def with_gaps(ticks: DataFrame, gap_limit: int, pip: float = PIP, chunk: int = CHUNK) -> DataFrame:
    """Ticks with spread, the gap to the previous tick across all bar edges, and whether it is suspicious: longer than the limit and off the weekend."""
    before = with_previous(ticks, ["time_ms"], chunk)
    gap = F.col("time_ms") - F.col("prev_time_ms")
    odd = (gap > gap_limit) & ~clock.touches_weekend(F.col("prev_time_ms"), F.col("time_ms"))
    return before.withColumn("spread", prices.spread_pips(pip)).withColumn("gap_ms", gap).withColumn("odd_gap", F.coalesce(odd, F.lit(False)))


def _measures(extreme: float) -> list[Column]:
    at = F.struct("time_ms", "seq")
    sides = [f(F.col(side), at).alias(f"{side}_{name}") if two else f(side).alias(f"{side}_{name}") for side in ("bid", "ask") for name, f, two in (("open", F.min_by, True), ("high", F.max, False), ("low", F.min, False), ("close", F.max_by, True))]
    return [
        *sides,
        F.count("*").alias("tick_count"),
        F.min("time_ms").alias("first_ms"),
        F.max("time_ms").alias("last_ms"),
        F.min("spread").alias("spread_min"),
        F.percentile("spread", F.lit(0.5)).alias("spread_median"),
        F.percentile("spread", F.lit(0.95)).alias("spread_p95"),
        F.max("spread").alias("spread_max"),
        F.count_if(F.col("spread") == 0).alias("zero_spread_count"),
        F.coalesce(F.max("gap_ms"), F.lit(0)).cast("long").alias("max_gap_ms"),
        F.count_if("odd_gap").alias("suspicious_gap_count"),
        F.count_if(F.col("spread") >= extreme).alias("extreme_count"),
    ]


def _flags(zero_ratio: float, *more: tuple[Column, str]) -> Column:
    own = [
        (F.col("extreme_count") > 0, "EXTREME_SPREAD"),
        (F.col("suspicious_gap_count") > 0, "HAS_SUSPICIOUS_GAP"),
        *more,
        (F.col("zero_spread_ratio") >= zero_ratio, "ZERO_SPREAD_HEAVY"),
    ]
    return F.array_compact(F.array(*(F.when(test, name) for test, name in own)))


def base_bars(gapped: DataFrame, width: int = HOUR, extreme: float = 5.0, zero_ratio: float = 0.5) -> DataFrame:
    """One row per symbol and non-empty bar; nothing is made for empty ones."""
    bucketed = gapped.withColumn("bar_start_ms", F.col("time_ms") - F.pmod(F.col("time_ms"), F.lit(width)))
    return with_flags(bucketed.groupBy("symbol", "bar_start_ms").agg(*_measures(extreme)), width, zero_ratio)


def with_flags(bars: DataFrame, width: int, zero_ratio: float = 0.5) -> DataFrame:
    """Add what follows from a base bar's measures: its end, the share of zero spreads, and its flags."""
    bars = bars.withColumn("zero_spread_ratio", F.col("zero_spread_count") / F.col("tick_count"))
    return bars.withColumn("bar_end_ms", F.col("bar_start_ms") + width).withColumn("quality_flags", _flags(zero_ratio)).withColumn("empty_count", F.lit(0).cast("long"))


def rollup_bars(gapped: DataFrame, timeframes: tuple[tuple[str, int], ...] = TIMEFRAMES, extreme: float = 5.0, zero_ratio: float = 0.5) -> DataFrame:
    """Bars of all timeframes in one table.

    Medians do not add up, so each tick is listed under its bar of every timeframe and all are aggregated in one
    shuffle; flags and missing children come from the narrower bars. A heavy share of zero spreads is handed up even if the wider bar has a low one.
    """
    bucket = lambda width: F.col("time_ms") - F.pmod(F.col("time_ms"), F.lit(width))
    listed = gapped.withColumn("tf", F.explode(F.array(*(F.struct(F.lit(name).alias("timeframe"), bucket(width).alias("bar_start_ms"), F.lit(width).cast("long").alias("width")) for name, width in timeframes))))
    bars = listed.select(*gapped.columns, "tf.*").groupBy("symbol", "timeframe", "width", "bar_start_ms").agg(*_measures(extreme))
    bars = bars.withColumn("zero_spread_ratio", F.col("zero_spread_count") / F.col("tick_count"))
    bars = bars.withColumn("__heavy", F.col("zero_spread_ratio") >= zero_ratio)
    # what children hand up, level by level
    known = bars.where(F.col("timeframe") == timeframes[0][0]).select("symbol", "timeframe", "bar_start_ms", F.lit(0).cast("long").alias("empty_count"), F.col("__heavy").alias("__any_heavy"), F.lit(False).alias("__any_gap"))
    levels, child_width = known, timeframes[0][1]
    for name, width in timeframes[1:]:
        start = F.col("bar_start_ms") - F.pmod(F.col("bar_start_ms"), F.lit(width))
        parents = known.withColumn("bar_start_ms", start).groupBy("symbol", "bar_start_ms").agg((F.lit(width // child_width) - F.count("*")).cast("long").alias("empty_count"), F.max("__any_heavy").alias("__any_heavy"), F.max("__any_gap").alias("__child_gap"))
        known = parents.select("symbol", F.lit(name).alias("timeframe"), "bar_start_ms", "empty_count", "__any_heavy", (F.col("__child_gap") | (F.col("empty_count") > 0)).alias("__any_gap"))
        levels, child_width = levels.unionByName(known), width
    joined = bars.join(levels, ["symbol", "timeframe", "bar_start_ms"])
    flags = [
        (F.col("extreme_count") > 0, "EXTREME_SPREAD"),
        (F.col("suspicious_gap_count") > 0, "HAS_SUSPICIOUS_GAP"),
        (F.col("__any_gap"), "INCOMPLETE_OR_EMPTY_INTERVAL"),
        (F.col("__any_heavy") | F.col("__heavy"), "ZERO_SPREAD_HEAVY"),
    ]
    out = joined.withColumn("quality_flags", F.array_compact(F.array(*(F.when(test, name) for test, name in flags))))
    return out.withColumn("bar_end_ms", F.col("bar_start_ms") + F.col("width")).drop("__heavy", "__any_heavy", "__any_gap", "width")


def usable() -> Column:
    from ..schemas import UNUSABLE

    return ~F.arrays_overlap("quality_flags", F.array(*map(F.lit, UNUSABLE)))


def ohlc_violations(bars: DataFrame) -> DataFrame:
    inside = lambda s, x: (F.col(f"{s}_low") <= F.col(f"{s}_{x}")) & (F.col(f"{s}_{x}") <= F.col(f"{s}_high"))
    return bars.where(~(inside("bid", "open") & inside("bid", "close") & inside("ask", "open") & inside("ask", "close")))


def reconcile(bars: DataFrame, timeframes: tuple[tuple[str, int], ...] = TIMEFRAMES) -> DataFrame:
    """Each wider bar beside its children: their ticks must add up, the first bid and the last ask must agree."""
    pairs = None
    for (child, _), (parent, width) in zip(timeframes, timeframes[1:]):
        kids = bars.where(F.col("timeframe") == child).withColumn("start", F.col("bar_start_ms") - F.pmod(F.col("bar_start_ms"), F.lit(width)))
        kids = kids.groupBy("symbol", F.col("start").alias("bar_start_ms")).agg(F.sum("tick_count").alias("child_ticks"), F.min_by("bid_open", "bar_start_ms").alias("child_bid"), F.max_by("ask_close", "bar_start_ms").alias("child_ask"))
        own = bars.where(F.col("timeframe") == parent).join(kids, ["symbol", "bar_start_ms"], "left")
        agrees = F.coalesce((F.col("tick_count") == F.col("child_ticks")) & (F.col("bid_open") == F.col("child_bid")) & (F.col("ask_close") == F.col("child_ask")), F.lit(False))
        one = own.select("symbol", "timeframe", "bar_start_ms", "tick_count", "child_ticks", agrees.alias("agrees"))
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs


def build_report(bars: DataFrame, ticks: DataFrame, reconciliation: DataFrame, start_ms: int, end_ms: int, base: tuple[str, int] = TIMEFRAMES[0]) -> DataFrame:
    """One row per symbol: counts, slots that the calendar closes, empty slots, flags and a severity.

    Closed slots are counted by the calendar even where ticks exist, so the empty ones can be below zero.
    """
    name, width = base
    slots = (end_ms - start_ms) // width
    from pyspark.sql import SparkSession

    spark: SparkSession = bars.sparkSession
    spine = spark.range(slots).select((F.lit(start_ms) + F.col("id") * width).alias("s"))
    closed = spine.agg(F.count_if(clock.inside_weekend(F.col("s"), F.col("s") + width)).alias("closed_slots"))
    has = lambda flag: F.count_if(F.array_contains("quality_flags", flag))
    per = bars.where(F.col("timeframe") == name).groupBy("symbol").agg(
        F.count("*").alias("bar_count"), F.sum("tick_count").alias("bar_ticks"), has("HAS_SUSPICIOUS_GAP").alias("gap_bars"), F.sum("suspicious_gap_count").alias("suspicious_gaps"),
        has("EXTREME_SPREAD").alias("extreme_bars"), has("ZERO_SPREAD_HEAVY").alias("zero_heavy_bars"),
    )
    input_ticks = ticks.groupBy("symbol").agg(F.count("*").alias("input_ticks"))
    broken = ohlc_violations(bars).groupBy("symbol").agg(F.count("*").alias("ohlc_violations"))
    unlike = reconciliation.where("NOT agrees").groupBy("symbol").agg(F.count("*").alias("reconciliation_failures"))
    out = per.join(input_ticks, "symbol").join(broken, "symbol", "left").join(unlike, "symbol", "left").crossJoin(F.broadcast(closed)).na.fill(0, ["ohlc_violations", "reconciliation_failures"])
    out = out.withColumn("empty_slots", F.lit(slots) - F.col("bar_count") - F.col("closed_slots"))
    wrong = (F.col("ohlc_violations") > 0) | (F.col("reconciliation_failures") > 0) | (F.col("bar_ticks") != F.col("input_ticks"))
    odd = (F.col("gap_bars") + F.col("extreme_bars") + F.col("zero_heavy_bars") > 0) | (F.col("empty_slots") != 0)
    return out.withColumn("severity", F.when(wrong, "FAIL").when(odd, "WARN").otherwise("PASS"))
