"""Execution cost in R: a bucket's slippage and fees under a regime, without the spread, which quotes already hold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PIP

#: A trade without a bucket of its own.
FALLBACK = {"entry_slip": 0.2, "exit_slip": 0.3, "latency_ms": 100.0, "commission_r": 0.0, "stop_slip": 0.0, "rollover_r": 0.0, "event_slip": 0.0}
REGIMES = ("HIGH_VOLATILITY", "NEWS_EVENT", "ROLLOVER", "JOINT_EXECUTION_STRESS")
#: (scenario, regime, multiplier)
STRESS = (("BASELINE_1X", "NORMAL", 1.0), ("BASELINE_1.25X", "NORMAL", 1.25), ("BASELINE_1.5X", "NORMAL", 1.5), ("BASELINE_2X", "NORMAL", 2.0), *((r, r, 1.0) for r in REGIMES), ("NORMAL", "NORMAL", 1.0))
SCENARIOS = (*STRESS[:4], ("JOINT_EXECUTION_STRESS", "JOINT_EXECUTION_STRESS", 1.0))


def with_bucket(trades: DataFrame, buckets: DataFrame) -> DataFrame:
    """Left join by session, regime and direction in upper case; the fallback where there is none. Spark broadcasts the dimension if it is small."""
    keys = ("session", "regime", "direction")
    right = buckets.select(*(F.upper(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__{c}") for c in FALLBACK))
    on = [F.upper(F.col(k)) == F.col(f"__{k}") for k in keys]
    out = trades.join(right, on, "left")
    return out.select(*trades.columns, *(F.coalesce(f"__{c}", F.lit(v)).alias(c) for c, v in FALLBACK.items()))


def cost_r(risk: Column, regime: Column, multiplier: Column, stopped: Column, pip: float = PIP) -> dict[str, Column]:
    """The five parts of a cost and their sum. Price parts scale with pip over risk, fees with the multiplier only; stops slip only under joint stress."""
    is_ = lambda name: regime == name
    entry = F.when(is_("HIGH_VOLATILITY"), F.col("entry_slip") * 1.25).when(is_("NEWS_EVENT"), F.col("entry_slip") + F.col("event_slip")).when(is_("JOINT_EXECUTION_STRESS"), F.col("entry_slip") * 2.0 + F.col("event_slip")).otherwise(F.col("entry_slip"))
    out = F.when(is_("HIGH_VOLATILITY"), F.col("exit_slip") * 1.5).when(is_("NEWS_EVENT"), F.col("exit_slip") + F.col("event_slip")).when(is_("JOINT_EXECUTION_STRESS"), F.col("exit_slip") * 2.5 + F.col("event_slip")).otherwise(F.col("exit_slip"))
    stop = F.when(is_("JOINT_EXECUTION_STRESS") & stopped, F.col("stop_slip") * 2.0).otherwise(0.0)
    rollover = F.when(is_("ROLLOVER") | is_("JOINT_EXECUTION_STRESS"), 2.0 * F.col("rollover_r")).otherwise(F.col("rollover_r"))
    scale = F.when(risk > 0, F.lit(pip) / F.nullif(risk, F.lit(0.0)) * multiplier)
    parts = {"entry_cost_r": entry * scale, "exit_cost_r": out * scale, "stop_cost_r": stop * scale, "commission_cost_r": F.col("commission_r") * multiplier, "rollover_cost_r": rollover * multiplier}
    total = parts["entry_cost_r"] + parts["exit_cost_r"] + parts["stop_cost_r"] + parts["commission_cost_r"] + parts["rollover_cost_r"]
    return parts | {"total_cost_r": total}


def scenario_column(scenarios=SCENARIOS) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("cost_regime"), F.lit(m).alias("multiplier")) for n, r, m in scenarios))


def stress_matrix(trades: DataFrame, buckets: DataFrame, stopped: Column | None = None, pip: float = PIP) -> DataFrame:
    """A row per trade and scenario: four multiples of the normal cost, four regimes and the plain one."""
    out = with_bucket(trades, buckets).withColumn("__s", F.explode(scenario_column(STRESS))).select("*", "__s.*").drop("__s")
    hit = F.lit(False) if stopped is None else stopped
    # the plain row is never that of a stop
    parts = cost_r(F.col("risk"), F.col("cost_regime"), F.col("multiplier"), hit & (F.col("scenario") != "NORMAL"), pip)
    return out.withColumns(parts)
