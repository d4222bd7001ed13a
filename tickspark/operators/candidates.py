"""Candidate trades from closed bars, families of them, and checks on trade ideas."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, prices
from ..schemas import PIP
from .bars import usable
from .sequence import as_of

FAMILIES = ("BASELINE_MOMENTUM", "TREND_PULLBACK", "SWEEP_REVERSAL", "RANGE_EXPANSION")


def closed_bars(base: DataFrame, wider: DataFrame, value: str) -> DataFrame:
    """Each base bar with the last wider bar that had closed by its end."""
    keep = ["bar_end_ms", "bid_open", "bid_close"]
    return as_of(base, wider, "bar_end_ms", "bar_end_ms", value, keep)


def with_history(base: DataFrame, lookback: int = 12) -> DataFrame:
    """Add the bar's number, the next bar's open, and what the ``lookback`` bars before it were like."""
    w = Window.partitionBy("symbol").orderBy("bar_start_ms")
    past = w.rowsBetween(-lookback, -1)
    reach = F.col("bid_high") - F.col("bid_low")
    return (
        base.withColumn("range", reach)
        .withColumn("bar_no", F.row_number().over(w) - 1)
        .withColumn("past_median", F.expr(f"percentile(range, 0.5D) OVER (PARTITION BY symbol ORDER BY bar_start_ms ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"))
        .withColumn("past_mean", F.avg("range").over(past))
        .withColumn("past_low", F.min("bid_low").over(past))
        .withColumn("past_high", F.max("ask_high").over(past))
        .withColumn("next_ask", F.lead("ask_open").over(w))
        .withColumn("next_bid", F.lead("bid_open").over(w))
    )


def generate(bars: DataFrame, timeframes: tuple[str, str, str] = ("BASE", "MID", "TOP"), lookback: int = 12, stride: int = 12, pip: float = PIP) -> DataFrame:
    """Momentum candidates on every ``stride``-th base bar, counted before the quality filter.

    Direction follows the closed base bar; a closed middle bar against it vetoes, a flat one does not; the closed top bar only names the regime.
    Entry is the next bar's open, the stop lies a buffer beyond the bar's extreme.
    """
    base, mid, top = (bars.where(F.col("timeframe") == name) for name in timeframes)
    known = with_history(base, lookback)
    picked = known.where((F.col("bar_no") >= lookback) & ((F.col("bar_no") - lookback) % stride == 0) & F.col("next_ask").isNotNull() & usable())
    closed = closed_bars(closed_bars(picked, mid, "mid"), top, "top").where("mid IS NOT NULL AND top IS NOT NULL")
    long = F.col("bid_close") >= F.col("bid_open")
    veto = F.when(long, F.col("mid.bid_close") < F.col("mid.bid_open")).otherwise(F.col("mid.bid_close") > F.col("mid.bid_open"))
    buffer = F.greatest(F.col("past_median") * 0.10, F.lit(pip))
    entry = F.when(long, F.col("next_ask")).otherwise(F.col("next_bid"))
    stop = F.when(long, F.col("bid_low") - buffer).otherwise(F.col("ask_high") + buffer)
    made = (
        closed.where(~veto)
        .withColumn("direction", F.when(long, "LONG").otherwise("SHORT"))
        .withColumn("entry", entry)
        .withColumn("stop_loss", stop)
        .withColumn("available_ms", F.col("bar_end_ms"))
        .withColumn("regime", F.when(F.col("top.bid_close") >= F.col("top.bid_open"), "BULL").otherwise("BEAR"))
        .withColumn("session", clock.session(F.col("bar_end_ms")))
        .withColumn("impulse", F.col("bid_close") - F.col("bid_open"))
        .withColumn("mid_impulse", F.col("mid.bid_close") - F.col("mid.bid_open"))
        .withColumn("candidate_id", F.concat_ws("-", "symbol", F.date_format(F.timestamp_millis("bar_end_ms"), "yyyyMMdd'T'HHmmss'Z'"), F.when(long, "LONG").otherwise("SHORT")))
    )
    return made.where(stop_is_sound())


def stop_is_sound(direction: str = "direction") -> Column:
    """The stop lies on the losing side of the entry."""
    return F.when(prices.is_long(direction), F.col("stop_loss") < F.col("entry")).otherwise(F.col("stop_loss") > F.col("entry"))


def family_tests(lookback: int = 12) -> dict[str, Column]:
    long = prices.is_long()
    swept = F.when(long, (F.col("bid_low") < F.col("past_low")) & (F.col("bid_close") > F.col("bid_open"))).otherwise((F.col("ask_high") > F.col("past_high")) & (F.col("ask_close") < F.col("ask_open")))
    return {
        "BASELINE_MOMENTUM": F.lit(True),
        "TREND_PULLBACK": (F.col("regime") == "BULL") == long,
        "SWEEP_REVERSAL": (F.col("bar_no") >= lookback) & swept,
        "RANGE_EXPANSION": (F.col("bar_no") > lookback) & (F.col("range") >= 1.5 * F.col("past_mean")),
    }


def families(candidates: DataFrame, lookback: int = 12) -> DataFrame:
    """A row per candidate and family that takes it; one pass for all families."""
    member = F.array_compact(F.array(*(F.when(test, name) for name, test in family_tests(lookback).items())))
    out = candidates.withColumn("family", F.explode(member))
    return out.withColumn("family_candidate_id", F.concat_ws(":", "family", "candidate_id"))


#: Codes of the risk policy, in the order in which they are told.
RISK_CODES = ("NOT_A_CANDIDATE", "PAIR_NOT_ALLOWED", "RISK_OUT_OF_BOUNDS", "REWARD_TOO_SMALL", "PRICES_OUT_OF_ORDER")


def risk_violations(ideas: DataFrame, pairs: list[str], max_risk: float = 0.01, min_rr: float | None = 3.0, flag: str = "candidate") -> DataFrame:
    """Add ``violations``, the codes of the risk policy that a trade idea breaks, in a fixed order. ``flag`` has to be true; ideas without that column are taken as flagged."""
    long = prices.is_long()
    ordered = F.when(long, (F.col("stop_loss") < F.col("entry")) & (F.col("entry") < F.col("take_profit"))).otherwise((F.col("take_profit") < F.col("entry")) & (F.col("entry") < F.col("stop_loss")))
    tests = [
        ~F.coalesce(F.col(flag), F.lit(False)) if flag in ideas.columns else F.lit(False),
        ~F.col("pair").isin(pairs),
        ~((F.col("risk_fraction") > 0) & (F.col("risk_fraction") <= max_risk)),
        (prices.planned_rr() < min_rr - 1e-12) if min_rr is not None else F.lit(False),
        ~ordered,
    ]
    return ideas.withColumn("violations", F.array_compact(F.array(*(F.when(t, code) for t, code in zip(tests, RISK_CODES))))).withColumn("accepted", F.size("violations") == 0)


def fingerprint(df: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """Count and order-free digest of a table's rows: the same for the same rows in any order."""
    h = F.xxhash64(*columns)
    per = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s"))
    return per.select(*keys, "rows", F.sha2(F.concat_ws(":", F.col("rows"), F.col("x"), F.col("s")), 256).alias("fingerprint"))


def dataset_manifest(bars: DataFrame) -> DataFrame:
    """One row per symbol and timeframe: rows, unusable bars, first and last time."""
    return bars.groupBy("symbol", "timeframe").agg(F.count("*").alias("rows"), F.count_if(~usable()).alias("unusable"), F.min("bar_start_ms").alias("start_ms"), F.max("bar_end_ms").alias("end_ms"))
