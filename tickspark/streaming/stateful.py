"""Sequential filters on streams: the rules of the batch forms, with what a symbol needs of its past kept as state.

A symbol's rows have to come in order from one micro-batch to the next; within one they are sorted. State is bounded for each symbol: a
window of fills, a counter, or the history and run lengths that the change point looks back on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import regime, stats


def _stateful(df: DataFrame, step, out: str, state: str) -> DataFrame:
    return df.groupBy("symbol").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def _sorted(parts: Iterable[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order, kind="stable")


def stream_monitor(fills: DataFrame, order: str = "seq", window: int = 30, **limits) -> DataFrame:
    """After each micro-batch the verdict of :func:`tickspark.operators.stats.execution_monitor` on the symbols that had fills in it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted(parts, order)
        kept = [list(x) for x in state.get] if state.exists else [[], [], []]
        new = (rows["real_slip"], rows["expected_slip"], rows["real_cost_r"] - rows["estimated_cost_r"])
        kept = [(old + [None if pd.isna(x) else float(x) for x in more])[-window:] for old, more in zip(kept, new)]
        state.update(tuple(kept))
        known = [[x for x in values if x is not None] for values in kept]
        yield pd.DataFrame({"symbol": [key[0]], "n": [len(kept[0])], "real": [known[0]], "expected": [known[1]], "gap": [known[2]]})

    arrays = "real array<double>, expected array<double>, gap array<double>"
    last = _stateful(fills.select("symbol", order, "real_slip", "expected_slip", "real_cost_r", "estimated_cost_r"), step, f"symbol string, n long, {arrays}", arrays)
    return stats.monitor_verdict(last, ["symbol"], window, **limits)


def stream_durations(scores: DataFrame, order: str = "ts_ms", least: int = 3) -> DataFrame:
    """:func:`tickspark.operators.regime.duration_filter` by symbol."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, since, before, now, start = state.get if state.exists else (0, 0, "", "NORMAL", 1)
        rows, found = _sorted(parts, order), []
        for proposal in rows["p"]:
            place += 1
            if proposal != before:
                before, since = proposal, place
            if place - since + 1 >= least and proposal != now:
                now, start = proposal, since
            found.append((now, place - start + 1))
        state.update((place, since, before, now, start))
        yield rows[["symbol", order]].assign(regime=[x for x, _ in found], duration=[n for _, n in found])

    out = _stateful(scores.select("symbol", order, regime.proposed_regime().alias("p")), step, f"symbol string, {order} long, regime string, duration int", "place long, since long, before string, now string, start long")
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("duration") / (2.0 * least)))


def stream_bursts(ticks: DataFrame, chunk: int = regime.CHUNK, **options) -> DataFrame:
    """:func:`tickspark.operators.regime.burst_intensity` on ticks in order of ``seq``, across micro-batches and midnights.

    State of a symbol: its current day and run, last time and mid, the decayed counts, and the sums seen in the run, in order. A tick
    of the next day or run starts anew, so the state holds ``chunk`` numbers at most.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, kept = None, None
        if state.exists:
            day, run, time, mid, up, down, seen = state.get
            place, known = (day, run), regime.Expanding()
            known.values = list(seen)
            kept = (time, mid, up, down, known)
        for now, rows in _sorted(parts, "seq").groupby(["day", "run"], sort=True):
            made, kept = regime.burst_walk(rows, kept if now == place else None, **options)
            place = now
            yield made
        time, mid, up, down, known = kept
        state.update((int(place[0]), int(place[1]), time, mid, up, down, known.values))

    held = "day long, run long, time long, mid double, up double, down double, seen array<double>"
    return _stateful(regime.burst_runs(ticks, chunk), step, regime.BURST_SCHEMA, held).withColumn("surprise", F.nanvl("surprise", F.lit(None).cast("double")))


def stream_guard(observations: DataFrame, history: int = 2016, ready: int = 30, change: float = 0.55, missing: float = 0.02, shadow: bool = True, **point) -> DataFrame:
    """:func:`tickspark.operators.regime.regime_guard` on the sound observations."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dims = len(regime.OBSERVATION)
        past, posterior = pickle.loads(state.get[0]) if state.exists else (np.zeros((0, dims)), regime.ChangePoint(dims, **point))
        made, past = regime.point_walk(_sorted(parts, "ts_ms"), past, posterior, history, ready)
        state.update((pickle.dumps((past, posterior)),))
        yield made

    sound = regime.quarantine(observations)[0].select("symbol", "ts_ms", "missing_ratio", *regime.OBSERVATION)
    return regime.guard_verdicts(_stateful(sound, step, regime.POINT_SCHEMA, "kept binary"), change, missing, shadow)
