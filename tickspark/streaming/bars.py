"""Live bars: the batch bars of :mod:`tickspark.operators.bars` on a stream of ticks.

:func:`stream_bars` aggregates windows under a watermark; :func:`live_bars` has all that the batch bars have, as it carries each
symbol's last tick over the edges of bars.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clock, prices
from ..operators import bars as batch
from ..schemas import HOUR, PIP


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 minutes", extreme: float = 5.0, pip: float = PIP) -> DataFrame:
    """Bars of closed windows; ticks that come later than ``late`` are dropped, repeats within it too. Works on batch tables as well."""
    at = F.struct("time_ms", "seq")
    t = ticks.withColumn("ts", F.timestamp_millis("time_ms")).withColumn("spread", prices.spread_pips(pip)).withWatermark("ts", late)
    t = t.dropDuplicatesWithinWatermark(["symbol", "seq"]) if ticks.isStreaming else t.dropDuplicates(["symbol", "seq"])
    bars = t.groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("bid", at).alias("bid_open"), F.max("bid").alias("bid_high"), F.min("bid").alias("bid_low"), F.max_by("bid", at).alias("bid_close"),
        F.min_by("ask", at).alias("ask_open"), F.max("ask").alias("ask_high"), F.min("ask").alias("ask_low"), F.max_by("ask", at).alias("ask_close"),
        F.count("*").alias("tick_count"), F.percentile("spread", F.lit(0.5)).alias("spread_median"), F.count_if(F.col("spread") >= extreme).alias("extreme_count"),
    )
    return bars.select("symbol", F.unix_millis("window.start").alias("bar_start_ms"), F.unix_millis("window.end").alias("bar_end_ms"), *bars.columns[2:])


def start_bars(ticks: DataFrame, path: str, checkpoint: str, **options):
    """Append closed bars to Parquet, exactly once by the checkpoint."""
    return stream_bars(ticks, **options).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).partitionBy("symbol").start()


_SIDES = [f"{side}_{name}" for side in ("bid", "ask") for name in ("open", "high", "low", "close")]
_LIVE = (
    "symbol string, bar_start_ms long, " + ", ".join(f"{c} double" for c in _SIDES)
    + ", tick_count long, first_ms long, last_ms long, spread_min double, spread_median double, spread_p95 double, spread_max double, zero_spread_count long, max_gap_ms long, extreme_count long, gaps_from array<long>, gaps_to array<long>"
)


def _summary(rows: pd.DataFrame, gap_limit: int) -> dict:
    """What a stretch of one bar's ticks, in order of their feed, says of the bar; such summaries merge."""
    order = rows.sort_values(["time_ms", "seq"], kind="stable")
    first, last = order.iloc[0], order.iloc[-1]
    gaps = rows["time_ms"] - rows["before"]
    wide = rows[gaps > gap_limit]
    values, counts = np.unique(rows["spread"].to_numpy(float), return_counts=True)
    return {
        "first": [int(first.time_ms), int(first.seq), float(first.bid), float(first.ask)], "last": [int(last.time_ms), int(last.seq), float(last.bid), float(last.ask)],
        "high": [float(rows["bid"].max()), float(rows["ask"].max())], "low": [float(rows["bid"].min()), float(rows["ask"].min())], "n": len(rows),
        "gap": int(max(0, gaps.max())) if gaps.notna().any() else 0, "gaps": [[int(a), int(b)] for a, b in zip(wide["before"], wide["time_ms"])], "spreads": [values.tolist(), counts.tolist()],
    }


def _merged(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    spreads = dict(zip(*a["spreads"]))
    for v, n in zip(*b["spreads"]):
        spreads[v] = spreads.get(v, 0) + n
    return {
        "first": min(a["first"], b["first"]), "last": max(a["last"], b["last"]), "high": [max(x) for x in zip(a["high"], b["high"])], "low": [min(x) for x in zip(a["low"], b["low"])], "n": a["n"] + b["n"],
        "gap": max(a["gap"], b["gap"]), "gaps": a["gaps"] + b["gaps"], "spreads": [list(spreads), list(spreads.values())],
    }


def _quantile(values: list[float], counts: list[int], q: float) -> float:
    order = np.argsort(values)
    v, upto = np.array(values)[order], np.cumsum(np.array(counts)[order])
    at = (upto[-1] - 1) * q
    low, high = (float(v[np.searchsorted(upto, k, side="right")]) for k in (np.floor(at), np.ceil(at)))
    return low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high


def _closed(symbol: str, start: int, s: dict, extreme: float) -> tuple:
    values, counts = s["spreads"]
    of = lambda test: int(sum(n for v, n in zip(values, counts) if test(v)))
    sides = [x for k in (0, 1) for x in (s["first"][2 + k], s["high"][k], s["low"][k], s["last"][2 + k])]
    return (
        symbol, start, *sides, s["n"], s["first"][0], s["last"][0], min(values), _quantile(values, counts, 0.5), _quantile(values, counts, 0.95), max(values), of(lambda v: v == 0), s["gap"], of(lambda v: v >= extreme),
        [a for a, _ in s["gaps"]], [b for _, b in s["gaps"]],
    )


def live_bars(ticks: DataFrame, gap_limit: int, width: int = HOUR, late_ms: int = 120_000, extreme: float = 5.0, zero_ratio: float = 0.5, pip: float = PIP) -> DataFrame:
    """The columns of :func:`tickspark.operators.bars.base_bars` for every bar that ended ``late_ms`` before the newest tick of its symbol.

    A symbol's ticks come in order of ``seq`` from one micro-batch to the next; one that was seen before is left out, one whose bar is closed counts for
    the next gap only. State per symbol, as readable JSON: time and place of the last tick, and a summary of each open bar, in which
    spreads are counted by value; it does not grow with the number of ticks.
    """
    names = [c.split()[0] for c in _LIVE.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"seq": None, "time": None, "top": None, "bars": {}}
        rows = pd.concat(list(parts)).drop_duplicates("seq").sort_values("seq", kind="stable")
        if kept["seq"] is not None:
            rows = rows[rows["seq"] > kept["seq"]]
        if len(rows):
            rows = rows.assign(before=rows["time_ms"].shift().fillna(np.nan if kept["time"] is None else kept["time"]))
            open_from = -np.inf if kept["top"] is None else kept["top"] - late_ms
            live = rows.assign(start=rows["time_ms"] - rows["time_ms"] % width)
            for start, own in live[live["start"] + width > open_from].groupby("start"):
                kept["bars"][str(start)] = _merged(kept["bars"].get(str(start)), _summary(own, gap_limit))
            top = int(rows["time_ms"].max())
            kept |= {"seq": int(rows["seq"].iloc[-1]), "time": int(rows["time_ms"].iloc[-1]), "top": top if kept["top"] is None else max(top, kept["top"])}
        done = sorted(int(s) for s in kept["bars"] if kept["top"] is not None and int(s) + width <= kept["top"] - late_ms)
        out = [_closed(key[0], s, kept["bars"].pop(str(s)), extreme) for s in done]
        state.update((json.dumps(kept),))
        yield pd.DataFrame(out, columns=names)

    fed = ticks.select("symbol", "seq", "time_ms", "bid", "ask", prices.spread_pips(pip).alias("spread"))
    made = fed.groupBy("symbol").applyInPandasWithState(step, _LIVE, "kept string", "append", GroupStateTimeout.NoTimeout)
    odd = F.filter(F.arrays_zip("gaps_from", "gaps_to"), lambda g: ~clock.touches_weekend(g["gaps_from"], g["gaps_to"]))
    made = made.withColumn("suspicious_gap_count", F.size(odd).cast("long")).drop("gaps_from", "gaps_to")
    return batch.with_flags(made, width, zero_ratio)
