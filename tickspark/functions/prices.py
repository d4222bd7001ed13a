"""Price arithmetic on quote ticks and trade ideas."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PIP


def spread_pips(pip: float = PIP, bid: str = "bid", ask: str = "ask") -> Column:
    return (F.col(ask) - F.col(bid)) / F.lit(pip)


def mid() -> Column:
    return (F.col("bid") + F.col("ask")) / 2


def valid_quote() -> Column:
    return (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))


def is_long(direction: str = "direction") -> Column:
    return F.col(direction) == "LONG"


def planned_risk() -> Column:
    return F.abs(F.col("entry") - F.col("stop_loss"))


def planned_rr() -> Column:
    """Reward over risk; infinite without risk."""
    return F.when(planned_risk() == 0, F.lit(float("inf"))).otherwise(F.abs(F.col("take_profit") - F.col("entry")) / F.nullif(planned_risk(), F.lit(0.0)))


def r_target(entry: Column, risk: Column, multiple: Column | float, long: Column) -> Column:
    """Price at a multiple of the risk; null unless both are positive."""
    m = F.lit(multiple) if isinstance(multiple, (int, float)) else multiple
    return F.when((risk > 0) & (m > 0), F.when(long, entry + risk * m).otherwise(entry - risk * m))


def bid_changed(flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(2) != 0


def ask_changed(flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(4) != 0


def shrunk_mean(mean: Column, n: Column, parent: Column, weight: float = 50.0) -> Column:
    return F.coalesce(F.try_divide(n * mean + F.lit(weight) * parent, n + F.lit(weight)), parent)


def digest(*columns: str) -> Column:
    """Hex digest of named columns as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)
