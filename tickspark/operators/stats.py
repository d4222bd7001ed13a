"""Statistics of trades: performance, slices, correlation, bootstrap, posterior means and monitors."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from . import scan, selection

WEEK_MS = 7 * clock.DAY
#: A portable generator: integer mixing that any engine repeats.
MODULUS, MULTIPLIER = 2147483647, 48271


def equity_curve(trades: DataFrame, keys: list[str], order: list[str], width: int = clock.DAY) -> DataFrame:
    """Trades with cumulative equity, its running peak (from zero) and the drawdown. ``order`` starts with a time, ``width`` cuts it into segments; see :mod:`.scan`."""
    local = scan.local_sums(trades, keys, order, "net_r", width)
    out = scan.attach(local, scan.carried(scan.summaries(local, keys), keys), keys, ["__base", "__top"])
    known = F.col("__sum").isNotNull() | F.col("__base").isNotNull()
    base = F.coalesce("__base", F.lit(0.0))
    out = out.withColumn("equity", F.when(known, base + F.coalesce("__sum", F.lit(0.0))))
    out = out.withColumn("peak", F.greatest(F.lit(0.0), F.col("__top"), base + F.col("__max")))
    return out.withColumn("drawdown", F.col("peak") - F.col("equity")).select(*trades.columns, "equity", "peak", "drawdown")


def performance(trades: DataFrame, keys: list[str], order: list[str], time: str = "ts_ms", width: int = clock.DAY) -> DataFrame:
    """One row per key: n, expectancy, win rate, excursions, worst drawdown, longest losing run (a zero ends it) and trades a week. ``order`` starts with a time, which ``width`` cuts into segments."""
    more = {"won": (F.count_if(F.col("net_r") > 0), F.sum), "t0": (F.min(time), F.min), "t1": (F.max(time), F.max)}
    for c in ("net_r", "mae_r", "mfe_r"):
        more |= {f"{c}_s": (F.sum(c), F.sum), f"{c}_n": (F.count(c), F.sum)}
    parts = scan.carried(scan.summaries(scan.local_sums(trades, keys, order, "net_r", width), keys, more), keys)
    mean = lambda c: F.try_divide(F.sum(f"{c}_s"), F.sum(f"{c}_n"))
    return parts.groupBy(*keys).agg(
        F.sum("__n").alias("trades"), mean("net_r").alias("expectancy_r"), F.try_divide(F.sum("won").cast("double"), F.sum("net_r_n")).alias("win_rate"), mean("mae_r").alias("mean_mae_r"), mean("mfe_r").alias("mean_mfe_r"),
        F.max("__drawdown").alias("max_drawdown_r"), F.try_divide(F.sum("__n").cast("double"), (F.max("t1") - F.min("t0")) / WEEK_MS).alias("trades_per_week"), F.max("__longest").alias("longest_losing_run"),
    )


def slices(trades: DataFrame, dimensions: list[str], keys: list[str] = []) -> DataFrame:
    """One row per value of each dimension, by one grouping-sets pass; nulls count in n but in no mean."""
    sets = [(*keys, d) for d in dimensions]
    cast = trades.select(*keys, *(F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN")).alias(d) for d in dimensions), "gross_r", "net_r", "mfe_r", "mae_r")
    grouped = cast.groupingSets(sets, *keys, *dimensions).agg(F.count("*").alias("n"), F.avg("gross_r").alias("gross_ev_r"), F.avg("net_r").alias("net_ev_r"), F.avg((F.col("net_r") > 0).cast("double")).alias("win_rate"), F.avg("mfe_r").alias("mean_mfe_r"), F.avg("mae_r").alias("mean_mae_r"))
    name = F.coalesce(*(F.when(F.col(d).isNotNull(), F.lit(d)) for d in dimensions))
    return grouped.select(*keys, name.alias("dimension"), F.coalesce(*dimensions).alias("value"), "n", "gross_ev_r", "net_ev_r", "win_rate", "mean_mfe_r", "mean_mae_r")


def correlations(trades: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """Pearson correlation of each feature with the target over rows that have both; absent for two rows or fewer, zero without variance."""
    long = trades.select(*keys, target, *features).unpivot([*keys, target], features, "feature", "x").where(F.col("x").isNotNull() & F.col(target).isNotNull())
    per = long.groupBy(*keys, "feature").agg(F.count("*").alias("n"), F.covar_pop("x", target).alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop(target).alias("sy")).where("n > 2")
    return per.select(*keys, "feature", "n", F.coalesce(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")), F.lit(0.0)).alias("correlation"))


def target_before_stop(paths: DataFrame, targets: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0), values: str = "path", keys: list[str] = ["symbol"]) -> DataFrame:
    """Of ordered excursions in R, the share that shows a target strictly before the first value at or below -1; empty paths are unclear."""
    first = lambda test: F.array_min(F.transform(values, lambda v, i: F.when(test(v), i)))
    stop = F.coalesce(first(lambda v: v <= -1.0), F.lit(1 << 30))
    shares = [F.avg(F.coalesce(first(lambda v, t=t: v >= t) < stop, F.lit(False)).cast("double")).alias(f"hit_{str(t).replace('.', '_')}r") for t in targets]
    return paths.groupBy(*keys).agg(F.count("*").alias("paths"), *shares, F.count_if(F.size(values) == 0).alias("unclear"))


def block_starts(n: Column, sample: Column, block: Column, seed: int = 0) -> Column:
    """Start of a block: three rounds of a multiplicative generator over seed, sample and block."""
    one = (F.lit(seed) * MULTIPLIER + sample * 69621 + 1) % MODULUS
    two = (one * MULTIPLIER + block * 69621 + 11) % MODULUS
    return ((two * MULTIPLIER) % MODULUS) % n


def block_bootstrap(returns: DataFrame, keys: list[str], order: list[str], value: str = "net_r", block: int = 5, samples: int = 500, seed: int = 0, width: int = clock.DAY) -> DataFrame:
    """Circular moving-block bootstrap of the mean: point estimate and the 2.5 % and 97.5 % order statistics of the resampled means.

    Values are numbered and summed up by segments of time (:mod:`.scan`; ``order`` starts with a time). Every place then gets the
    sum of the whole block that starts there and that of the cut last block, each a difference of two cumulative sums; a sample
    costs a row per block, which meets its place in one join.
    """
    local = scan.local_sums(returns.select(*keys, *dict.fromkeys([*order, value])), keys, order, value, width)
    every = Window.partitionBy(*keys)
    parts = scan.carried(scan.summaries(local, keys), keys).withColumn("n", F.sum("__n").over(every)).withColumn("total", F.sum("__s").over(every))
    parts = parts.withColumn("size", F.least(F.lit(block), F.col("n"))).withColumn("blocks", F.ceil(F.col("n") / F.col("size")))
    sums = scan.attach(local, parts, keys, ["__base", "__before", "n", "total", "size", "blocks"])
    sums = sums.withColumn("i", F.col("__before") + F.col("__i") - 1).withColumn("__to", F.coalesce("__base", F.lit(0.0)) + F.coalesce("__sum", F.lit(0.0)))
    # a place is the start of two blocks, a whole one and the last one that is cut so that a sample has n values, and the end of two others
    listed = sums.withColumn("cut", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("len", F.when(F.col("cut"), F.col("n") - (F.col("blocks") - 1) * F.col("size")).otherwise(F.col("size")))
    starts = F.struct(F.col("i").alias("start"), (F.col("__to") - F.coalesce(value, F.lit(0.0))).alias("a"), F.lit(None).cast("double").alias("b"))
    ends = F.struct(F.pmod(F.col("i") - F.col("len") + 1, F.col("n")).alias("start"), F.lit(None).cast("double").alias("a"), F.when(F.col("i") < F.col("len") - 1, F.col("__to") + F.col("total")).otherwise(F.col("__to")).alias("b"))
    at = listed.select(*keys, "cut", F.inline(F.array(starts, ends))).groupBy(*keys, "start", "cut").agg((F.max("b") - F.max("a")).alias("part"))
    # samples are dealt out before their blocks are listed, so that no task lists all of a key's
    draws = parts.select(*keys, "n", "total", "size", "blocks").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long")))).repartition(*keys, "sample")
    draws = draws.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    draws = draws.withColumn("start", block_starts(F.col("n"), F.col("sample"), F.col("b"), seed)).withColumn("cut", F.col("b") == F.col("blocks") - 1)
    joined = draws.join(at, [*keys, "start", "cut"])
    means = joined.groupBy(*keys, "sample").agg((F.sum("part") / F.max("n")).alias("mean"), F.max("n").alias("n"), (F.max("total") / F.max("n")).alias("point"))
    ranked = means.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "sample")) - 1)  # a row per sample
    pick = lambda q: F.max(F.when(F.col("__k") == F.bround(F.lit((samples - 1) * q), 0).cast("long"), F.col("mean")))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max("point").alias("point_estimate"), pick(0.025).alias("lower_95"), pick(0.975).alias("upper_95"))


def robust_baseline(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Median, median absolute deviation and n per key and feature."""
    return selection.median_deviations(rows, keys, features).select(*keys, "feature", "median", "mad", "n")


def robust_z(value: Column, median: Column, mad: Column, floor: float = 1e-9) -> Column:
    return (value - median) / F.greatest(1.4826 * mad, F.lit(floor))


def posterior_table(outcomes: DataFrame, bucket: list[str], parent: list[str], strength: float = 30.0, actionable: int = 30) -> DataFrame:
    """Bucket means shrunk to their parents, with an interval from the narrowest level that has two values.

    All three levels come from one grouping-sets pass.
    """
    sets = outcomes.groupingSets([tuple(bucket), tuple(parent), ()], *bucket).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("net_r").alias("m"), F.stddev_samp("net_r").alias("s"))
    full = 0
    part = sum(1 << (len(bucket) - 1 - i) for i, c in enumerate(bucket) if c not in parent)
    none = (1 << len(bucket)) - 1
    top = sets.where(F.col("g") == none).select(F.col("m").alias("gm"), F.col("s").alias("gs"), F.col("n").alias("gn"))
    mid = sets.where(F.col("g") == part).select(*parent, F.col("m").alias("pm"), F.col("s").alias("ps"), F.col("n").alias("pn"))
    low = sets.where(F.col("g") == full).select(*bucket, "m", "s", "n")
    joined = low.join(mid, parent, "left").crossJoin(F.broadcast(top))
    weight = F.col("n") / (F.col("n") + strength)
    out = joined.withColumn("weight", weight).withColumn("mean_r", F.col("weight") * F.col("m") + (1 - F.col("weight")) * F.coalesce("pm", "gm"))
    spread = F.when(F.col("n") >= 2, F.col("s")).when(F.col("pn") >= 2, F.col("ps")).when(F.col("gn") >= 2, F.col("gs")).otherwise(0.0)
    half = 1.96 * spread / F.sqrt(F.greatest(F.lit(1.0), F.col("n") * F.col("weight") + F.coalesce("pn", F.lit(0)) * (1 - F.col("weight"))))
    out = out.withColumn("lower_95", F.col("mean_r") - half).withColumn("upper_95", F.col("mean_r") + half)
    return out.select(*bucket, F.col("n").alias("bucket_n"), F.coalesce("pn", F.lit(0).cast("long")).alias("parent_n"), "weight", "mean_r", "lower_95", "upper_95", (F.col("n") >= actionable).alias("actionable"))


def reliability_tier(n: Column) -> Column:
    return F.when(n < 30, "INSUFFICIENT").when(n < 100, "LOW").when(n < 200, "MEDIUM").otherwise("NORMAL")


def expected_value(p: Column, win: Column, loss: Column, cost: Column) -> Column:
    """Net expectancy in R; null for a probability out of range, a positive loss or a value that isn't finite."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when((p >= 0) & (p <= 1) & (loss <= 0) & finite(win) & finite(loss) & finite(cost), p * win + (1 - p) * loss - cost)


def feasibility(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``reasons`` against a setup and ``accepted``. Needs valid_data, sound_stop, risk_fraction, n, net_ev_r, stress_ev_r (null: net_ev_r), max_drawdown_r, drawdown_ceiling_r and lower_95."""
    tests = [
        (~F.col("valid_data"), "INVALID_DATA"),
        (~F.col("sound_stop"), "INVALID_STOP"),
        (~((F.col("risk_fraction") > 0) & (F.col("risk_fraction") <= 0.01)), "RISK_TOO_HIGH"),
        (F.col("n") < 30, "INSUFFICIENT_SAMPLE"),
        (F.col("net_ev_r") <= 0, "NO_NET_EXPECTANCY"),
        (F.coalesce("stress_ev_r", "net_ev_r") <= 0, "EXECUTION_FRAGILE"),
        (F.col("max_drawdown_r") > F.col("drawdown_ceiling_r"), "DRAWDOWN_CEILING"),
        ((F.col("n") >= 200) & ~F.coalesce(F.col("lower_95") > 0, F.lit(False)) if strict else F.lit(False), "INTERVAL_NOT_POSITIVE"),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(t, code) for t, code in tests)))).withColumn("accepted", F.size("reasons") == 0)


RANK_WEIGHTS = {"net_expectancy": 0.35, "stability": 0.20, "confidence": 0.15, "regime_robustness": 0.15, "tail_robustness": 0.15}


def rank_score(weights: dict[str, float] = RANK_WEIGHTS) -> Column:
    """Weighted sum of parts in [0, 1], a missing one being 0; a part out of range is an error."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to one")
    out = F.lit(0.0)
    for name, w in weights.items():
        x = F.coalesce(F.col(name), F.lit(0.0))
        out = out + F.when((x >= 0) & (x <= 1), x * w).otherwise(F.raise_error(F.concat(F.lit(f"{name} is out of range: "), x)).cast("double"))
    return out


def execution_monitor(fills: DataFrame, keys: list[str], order: str, window: int = 30, median_limit: float = 1.5, p90_limit: float = 2.0, cost_limit: float = 0.10) -> DataFrame:
    """Verdict on the last ``window`` fills of each key: real against expected slippage at the median and at the 90 % order statistic, and the median cost gap."""
    last = fills.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__r") <= window)
    gap = F.col("real_cost_r") - F.col("estimated_cost_r")
    per = last.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_list("real_slip").alias("real"), F.collect_list("expected_slip").alias("expected"), F.collect_list(gap).alias("gap"))
    return monitor_verdict(per, keys, window, median_limit, p90_limit, cost_limit)


def monitor_verdict(per: DataFrame, keys: list[str], window: int = 30, median_limit: float = 1.5, p90_limit: float = 2.0, cost_limit: float = 0.10) -> DataFrame:
    """``reasons`` and ``pause`` from the ``n`` last fills of a key, held as arrays ``real``, ``expected`` and ``gap``."""
    low, high = lambda a: F.floor((F.size(a) - 1) / 2).cast("int"), lambda a: F.floor(F.size(a) / 2).cast("int")
    middle = lambda a: (F.get(a, low(a)) + F.get(a, high(a))) / 2
    per = per.withColumns({c: F.array_sort(c) for c in ("real", "expected", "gap")})
    k = int(round((window - 1) * 0.9))  # half to even, as the index rule of the monitor has it
    enough = F.col("n") >= window
    found = F.array_compact(F.array(F.when(middle("real") > median_limit * middle("expected"), "MEDIAN_SLIPPAGE"), F.when(F.get("real", F.lit(k)) > p90_limit * F.get("expected", F.lit(k)), "P90_SLIPPAGE"), F.when(middle("gap") > cost_limit, "COST_GAP")))
    out = per.withColumn("reasons", F.when(enough, found).otherwise(F.array(F.lit("INSUFFICIENT_OBSERVATIONS"))))
    return out.select(*keys, "n", "reasons", (enough & (F.size("reasons") > 0)).alias("pause"))


def exit_plan(targets: DataFrame, keys: list[str], policy: str, fixed_r: float = 3.0) -> DataFrame:
    """The valid targets of a plan, best first: by priority, then net estimate, then time. A partial plan has the first two, half each."""
    valid = targets.where("valid")
    if policy == "FIXED_RR":
        valid = valid.where((F.col("target_type") == "FIXED_R") & (F.abs(F.col("gross_r") - fixed_r) < 1e-12))
    elif policy == "STRUCTURE_TARGET":
        valid = valid.where(F.col("target_type").isin("STRUCTURAL", "LIQUIDITY"))
    w = Window.partitionBy(*keys).orderBy("priority", F.desc("net_r"), "ts_ms")
    ranked = valid.withColumn("rank", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    half = F.lit(policy == "PARTIAL_TRAILING") & (F.col("__n") >= 2)
    return ranked.where((F.col("rank") == 1) | half & (F.col("rank") == 2)).withColumn("fraction", F.when(half, 0.5).otherwise(1.0)).drop("__n")
