"""Sequential features and regimes. Rolling statistics are window expressions; recurrences run as grouped-map pandas per symbol (and day), in order."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, prices
from .sequence import CHUNK

OBSERVATION = ("rv_short", "rv_long", "spread_median", "spread_p95", "intensity", "abs_return")


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def rolling_robust_z(df: DataFrame, keys: list[str], order: str, columns: list[str], window: int = 288, least: int = 2, floor: float = 1e-9) -> DataFrame:
    """Add ``<column>_z``: how far a value is from the median of the ``window`` rows before it, in scaled median deviations; 0 with fewer than ``least`` rows. And ``history``, the number of rows seen."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    out = df
    for c in columns:
        out = out.withColumn(f"__{c}", F.collect_list(c).over(w))
    for c in columns:
        out = out.withColumn(f"__{c}_m", _median(F.col(f"__{c}")))
    for c in columns:
        middle = F.col(f"__{c}_m")
        out = out.withColumn(f"__{c}_a", F.transform(f"__{c}", lambda x: F.abs(x - middle)))
    for c in columns:
        out = out.withColumn(f"__{c}_d", _median(F.col(f"__{c}_a")))
    for c in columns:
        z = (F.col(c) - F.col(f"__{c}_m")) / F.greatest(1.4826 * F.col(f"__{c}_d"), F.lit(floor))
        out = out.withColumn(f"{c}_z", F.when(F.size(f"__{c}") >= least, z).otherwise(0.0))
    out = out.withColumn("history", F.size(f"__{columns[0]}"))
    return out.drop(*(f"__{c}{x}" for c in columns for x in ("", "_m", "_a", "_d")))


def robust_threshold(df: DataFrame, keys: list[str], order: str, threshold: float = 3.0, window: int = 288, ready: int = 30) -> DataFrame:
    """Rolling scores of volatility and spread; unstable once there is enough history and the larger one reaches the threshold."""
    out = rolling_robust_z(df, keys, order, ["rv_short", "spread_median"], window)
    return out.withColumn("unstable", (F.col("history") >= ready) & (F.greatest("rv_short_z", "spread_median_z") >= threshold))


def regime_observations(bars: DataFrame, short: int = 1, long: int = 6) -> DataFrame:
    """Observations from base bars: log ranges over few and more bars, spreads, ticks a minute and the absolute return in pips."""
    w = Window.partitionBy("symbol").orderBy("bar_start_ms")
    reach = F.log(F.col("bid_high") / F.col("bid_low"))
    return bars.select(
        "symbol", F.col("bar_end_ms").alias("ts_ms"), F.avg(reach).over(w.rowsBetween(1 - short, 0)).alias("rv_short"), F.avg(reach).over(w.rowsBetween(1 - long, 0)).alias("rv_long"), "spread_median", "spread_p95",
        (F.col("tick_count") / ((F.col("bar_end_ms") - F.col("bar_start_ms")) / 60_000)).alias("intensity"), F.abs((F.col("bid_close") - F.col("bid_open")) / 0.0001).alias("abs_return"), F.lit(0.0).alias("missing_ratio"),
    )


def observation_faults() -> Column:
    """What makes an observation unsound: a measure that is missing, no number or below zero, or a missing share outside 0 to 1."""
    bad = lambda c: F.coalesce(F.isnan(c) | (F.col(c) < 0), F.lit(True))
    share = F.coalesce(~F.col("missing_ratio").between(0, 1), F.lit(True))
    return F.array_compact(F.array(*(F.when(bad(c), c.upper()) for c in OBSERVATION), F.when(share, "MISSING_RATIO")))


def quarantine(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sound observations, and the others with their ``faults``; no row is in neither."""
    marked = observations.withColumn("faults", observation_faults())
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


class Expanding:
    """Median and median absolute deviation of the values so far. The values stay sorted; the deviations are two sorted runs going out from the median, so their median is found by bisection."""

    def __init__(self) -> None:
        self.values: list[float] = []

    def add(self, x: float) -> None:
        insort(self.values, x)

    def median(self) -> float:
        v, n = self.values, len(self.values)
        return (v[(n - 1) // 2] + v[n // 2]) / 2

    def _deviation(self, middle: float, split: int, k: int) -> float:
        """The deviation with k smaller ones; ``split`` values lie below the median."""
        v, n = self.values, len(self.values)
        lo, hi = max(0, k + 1 - (n - split)), min(k + 1, split)
        while lo < hi:  # how many of the k + 1 least deviations lie below the median
            take = (lo + hi) // 2
            if middle - v[split - 1 - take] < v[split + k - take] - middle:
                lo = take + 1
            else:
                hi = take
        below = middle - v[split - lo] if lo else 0.0
        above = v[split + k - lo] - middle if k + 1 > lo else 0.0
        return max(below, above)

    def deviation(self, middle: float) -> float:
        n, split = len(self.values), bisect_left(self.values, middle)
        return (self._deviation(middle, split, (n - 1) // 2) + self._deviation(middle, split, n // 2)) / 2


BURST_SCHEMA = "symbol string, seq long, time_ms long, up double, down double, total double, directional double, surprise double"


def burst_runs(ticks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What :func:`burst_walk` needs of ticks: their mid, and the day and run of ``chunk`` places that they belong to."""
    return ticks.select("symbol", "seq", "time_ms", prices.mid().alias("mid"), clock.day_number(F.col("time_ms")).alias("day"), F.floor(F.col("seq") / chunk).cast("long").alias("run"))


def burst_walk(pdf: pd.DataFrame, kept: tuple | None = None, mu: float = 0.25, alpha: float = 1.0, beta: float = 2.0, least: int = 20) -> tuple[pd.DataFrame, tuple]:
    """Rows of :data:`BURST_SCHEMA` for one run's ticks that follow ``kept``, and what the next ones need: last time and mid, the decayed counts and the sums so far."""
    pdf = pdf.sort_values("seq")
    time, mid, level_up, level_down, seen = kept or (pdf["time_ms"].iloc[0], pdf["mid"].iloc[0], 0.0, 0.0, Expanding())
    gap, move = np.diff(pdf["time_ms"], prepend=time), np.diff(pdf["mid"], prepend=mid)
    if (gap < 0).any():
        raise ValueError("ticks go back in time")
    keep = np.exp(-beta * gap / 1000.0)
    decayed = lambda jumps, level: np.fromiter(accumulate(zip(keep, alpha * jumps), lambda level, x: level * x[0] + x[1], initial=level), float)[1:]
    ups, downs = decayed(move > 0, level_up), decayed(move < 0, level_down)
    up, down = mu + ups, mu + downs
    total, surprise = up + down, np.full(len(up), np.nan)
    for i, x in enumerate(total.tolist()):
        if len(seen.values) >= least:
            middle = seen.median()
            surprise[i] = (x - middle) / max(1.4826 * seen.deviation(middle), 1e-9)
        seen.add(x)
    out = {"symbol": pdf["symbol"], "seq": pdf["seq"], "time_ms": pdf["time_ms"], "up": up, "down": down, "total": total, "directional": (up - down) / np.maximum(total, 1e-12), "surprise": surprise}
    return pd.DataFrame(out), (int(pdf["time_ms"].iloc[-1]), float(pdf["mid"].iloc[-1]), float(ups[-1]), float(downs[-1]), seen)


def burst_intensity(ticks: DataFrame, mu: float = 0.25, alpha: float = 1.0, beta: float = 2.0, least: int = 20, chunk: int = CHUNK) -> DataFrame:
    """Decaying counts of upward and downward mid changes, and how surprising their sum is against what was seen so far.

    What was seen starts anew with each symbol, UTC day and run of ``chunk`` places, so no task holds more than a run.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return burst_walk(pdf, None, mu, alpha, beta, least)[0]

    made = burst_runs(ticks, chunk).groupBy("symbol", "day", "run").applyInPandas(run, BURST_SCHEMA)
    return made.withColumn("surprise", F.nanvl("surprise", F.lit(None).cast("double")))


def proposed_regime() -> Column:
    return F.when(F.greatest("volatility_z", "spread_z") >= 2.5, "HIGH_STRESS").when(F.col("volatility_z") <= -1.5, "LOW_VOL").otherwise("NORMAL")


def duration_filter(df: DataFrame, keys: list[str], order: str, least: int = 3) -> DataFrame:
    """Regime that changes only after ``least`` like proposals in a row: HIGH_STRESS from a score of 2.5, LOW_VOL down to -1.5, else NORMAL.

    A proposal is confirmed from its ``least``-th row in a row on, and the regime is the last confirmed one. It lasts since the first of the
    rows that confirmed it. Windows over each key, in one sort.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, order, proposed_regime().alias("p")).withColumns({"i": F.row_number().over(w), "before": F.lag("p").over(w)})
    rows = rows.withColumn("since", F.max(F.when(~F.col("p").eqNullSafe(F.col("before")), F.col("i"))).over(upto))
    rows = rows.withColumn("regime", F.coalesce(F.last(F.when(F.col("i") - F.col("since") + 1 >= least, F.col("p")), ignorenulls=True).over(upto), F.lit("NORMAL")))
    rows = rows.withColumn("turned", F.col("regime") != F.lag("regime", 1, "NORMAL").over(w))
    start = F.max(F.when(F.col("turned"), F.col("since"))).over(upto)
    rows = rows.withColumn("duration", (F.col("i") - F.coalesce(start, F.lit(1)) + 1).cast("int"))
    return rows.select(*keys, order, "regime", "duration", F.least(F.lit(1.0), F.col("duration") / (2.0 * least)).alias("confidence"))


class ChangePoint:
    """Bayesian online change point with a Student-t predictive per dimension and a constant hazard; run lengths are arrays."""

    def __init__(self, dims: int, hazard_mean: float = 144.0, longest: int = 288, prior_scale: float = 2.5, prior_df: float = 4.0) -> None:
        self.hazard, self.longest, self.scale0, self.df0 = 1 / hazard_mean, longest, prior_scale, prior_df
        self.posterior = np.ones(1)
        self.n, self.mean, self.m2 = np.zeros(1), np.zeros((1, dims)), np.zeros((1, dims))
        self._gamma = {}

    def _gammas(self, df: float) -> float:
        if df not in self._gamma:
            self._gamma[df] = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
        return self._gamma[df]

    def _log_density(self, x, n, mean, m2):
        variance = np.where(n[:, None] > 1, m2 / np.maximum(1, n - 1)[:, None], self.scale0**2)
        scale = np.maximum(np.sqrt(variance), 0.25)
        df = np.maximum(self.df0, self.df0 + n - 1)
        constant = np.array([self._gammas(float(v)) for v in df])
        z2 = ((x - mean) / scale) ** 2
        return (constant[:, None] - np.log(scale) - (df[:, None] + 1) / 2 * np.log1p(z2 / df[:, None])).sum(axis=1)

    def update(self, x: np.ndarray) -> tuple[float, float, float]:
        dims = len(x)
        run = self._log_density(x, self.n, self.mean, self.m2)
        fresh = self._log_density(x, np.zeros(1), np.zeros((1, dims)), np.zeros((1, dims)))[0]
        top = max(run.max(), fresh)
        change = self.hazard * math.exp(fresh - top) * self.posterior.sum()
        weights = np.concatenate([[change], (1 - self.hazard) * self.posterior * np.exp(run - top)])
        weights = weights / weights.sum()
        n = np.concatenate([[0.0], self.n]) + 1
        old = np.vstack([np.zeros(dims), self.mean])
        delta = x - old
        mean = old + delta / n[:, None]
        m2 = np.vstack([np.zeros(dims), self.m2]) + delta * (x - mean)
        keep = self.longest + 1
        if len(weights) > keep:
            weights, n, mean, m2 = weights[:keep] / weights[:keep].sum(), n[:keep], mean[:keep], m2[:keep]
        self.posterior, self.n, self.mean, self.m2 = weights, n, mean, m2
        return float(weights[0]), float((np.arange(len(weights)) * weights).sum()), float(weights.max())


POINT_SCHEMA = "symbol string, ts_ms long, missing_ratio double, change_probability double, expected_run double, peak double"


def point_walk(pdf: pd.DataFrame, past: np.ndarray, posterior: ChangePoint, history: int, ready: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of :data:`POINT_SCHEMA` for observations that follow the logarithms in ``past``, and the logarithms that the next ones need; ``posterior`` moves on."""
    pdf = pdf.sort_values("ts_ms")
    logs = np.vstack([past, np.log(pdf[list(OBSERVATION)].to_numpy(float) + 1e-12)])
    out = np.full((len(pdf), 3), np.nan)
    for i in range(max(ready, len(past)), len(logs)):
        known = logs[max(0, i - history) : i]
        middle = np.median(known, axis=0)
        out[i - len(past)] = posterior.update((logs[i] - middle) / np.maximum(1.4826 * np.median(np.abs(known - middle), axis=0), 1e-6))
    made = pdf[["symbol", "ts_ms", "missing_ratio"]].assign(change_probability=out[:, 0], expected_run=out[:, 1], peak=out[:, 2])
    return made, logs[-max(history, ready) :]


def change_points(observations: DataFrame, history: int = 2016, ready: int = 30, **point) -> DataFrame:
    """Change-point posterior of each observation's logarithms, scaled by the median and deviation of the ``history`` observations before it; no number for the first ``ready`` ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return point_walk(pdf, np.zeros((0, len(OBSERVATION))), ChangePoint(len(OBSERVATION), **point), history, ready)[0]

    return observations.groupBy("symbol").applyInPandas(run, POINT_SCHEMA)


#: What the guard keeps of a symbol: the time of its last observation, the logarithms that the next ones are scaled by (row by row), and the run lengths' weights, counts, means and squares.
SNAPSHOT_SCHEMA = "symbol string, last_ms long, past array<double>, weights array<double>, counts array<double>, means array<double>, squares array<double>"
STEP_SCHEMA = f"{POINT_SCHEMA}, {SNAPSHOT_SCHEMA.removeprefix('symbol string, ')}"


def _restored(row: pd.Series, dims: int, **point) -> tuple[np.ndarray, ChangePoint]:
    kept = ChangePoint(dims, **point)
    kept.posterior, kept.n = np.array(row["weights"], float), np.array(row["counts"], float)
    kept.mean, kept.m2 = (np.array(row[c], float).reshape(-1, dims) for c in ("means", "squares"))
    return np.array(row["past"], float).reshape(-1, dims), kept


def resumed_points(observations: DataFrame, snapshot: DataFrame, history: int = 2016, ready: int = 30, **point) -> DataFrame:
    """Rows of :data:`POINT_SCHEMA` for observations that follow a ``snapshot``, and for every symbol a row whose ``last_ms`` is set: its new snapshot.

    Observations up to the snapshot's time are left out before they are grouped. A symbol without new ones keeps its snapshot.
    """
    dims = len(OBSERVATION)
    known = snapshot.select("symbol", "last_ms")
    new = observations.join(known, "symbol", "left").where("last_ms IS NULL OR ts_ms > last_ms").drop("last_ms")

    def run(key: tuple, rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        past, posterior = _restored(kept.iloc[0], dims, **point) if len(kept) else (np.zeros((0, dims)), ChangePoint(dims, **point))
        made, past = point_walk(rows, past, posterior, history, ready)
        last = int(rows["ts_ms"].max()) if len(rows) else int(kept["last_ms"].iloc[0])
        state = {"symbol": [key[0]], "last_ms": [last], "past": [past.ravel()], "weights": [posterior.posterior], "counts": [posterior.n], "means": [posterior.mean.ravel()], "squares": [posterior.m2.ravel()]}
        columns = [c.split()[0] for c in STEP_SCHEMA.split(", ")]
        parts = [df.reindex(columns=columns).astype(object) for df in (made, pd.DataFrame(state)) if len(df)]
        out = pd.concat(parts)
        return out.where(out.notna(), None)

    return new.groupBy("symbol").cogroup(snapshot.groupBy("symbol")).applyInPandas(run, STEP_SCHEMA)


def guard_verdicts(points: DataFrame, change: float = 0.55, missing: float = 0.02, shadow: bool = True) -> DataFrame:
    """Verdicts on rows of :data:`POINT_SCHEMA`, whose measures are no numbers while the guard warms up.

    A shadow guard writes down the multiplier it would apply but applies one; too many missing ticks veto in any case.
    """
    points = points.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("change_probability", "expected_run", "peak")})
    p = F.col("change_probability")
    fine, warm, unstable = F.col("missing_ratio") <= missing, p.isNull(), p >= change
    suggested = F.when(warm, 1.0).when(~fine, 0.0).when(unstable, 0.5).otherwise(1.0)
    event = F.when(warm, "WARMUP").when(~fine, "DATA_QUALITY_INVALID").when(unstable, "VOLATILITY_LIQUIDITY_CHANGEPOINT").otherwise("REGIME_STABLE")
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return points.select(
        "symbol", "ts_ms", event.alias("event"), (fine & (warm | F.lit(shadow) | ~unstable)).alias("valid"), known(1 - 2 * p).alias("signal"), known(F.col("peak")).alias("confidence"), known(p).alias("change_probability"),
        known(F.col("expected_run")).alias("expected_run"), suggested.alias("suggested_multiplier"), F.when(~fine, 0.0).when(F.lit(shadow), 1.0).otherwise(suggested).alias("applied_multiplier"),
    )


def regime_guard(observations: DataFrame, change: float = 0.55, missing: float = 0.02, shadow: bool = True, **options) -> DataFrame:
    """One verdict per sound observation, in time order per symbol; see :func:`quarantine` for the others and :func:`guard_verdicts`."""
    return guard_verdicts(change_points(quarantine(observations)[0], **options), change, missing, shadow)
