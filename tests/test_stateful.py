"""Streams in three micro-batches give what the batch forms give for the whole table."""

import os

import pytest
from pyspark.sql import functions as F

from tickspark.operators import bars, regime, stats
from tickspark.plans import fixture as fx
from tickspark.plans import queries
from tickspark.schemas import HOUR, TICK
from tickspark.streaming import bars as live
from tickspark.streaming import ingest
from tickspark.streaming import stateful


def streamed(spark, df, order, tmp_path, run, name):
    """Rows that ``run`` gives for ``df`` in three files, one for each micro-batch, each with the rows before the next cut."""
    source, table = str(tmp_path / "in"), f"stateful_{name}"
    cuts = df.select(F.percentile(order, F.array(F.lit(0.3), F.lit(0.7))).alias("c")).first()["c"]
    for k, (low, high) in enumerate(zip([float("-inf"), *cuts], [*cuts, float("inf")])):
        df.where((F.col(order) > low) & (F.col(order) <= high)).coalesce(1).write.mode("append").parquet(source)
        for file in os.listdir(source):
            if file.endswith(".parquet") and os.path.getmtime(f"{source}/{file}") > 1e9:
                os.utime(f"{source}/{file}", (1000 + k, 1000 + k))
    stream = run(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    q = stream.writeStream.format("memory").queryName(table).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(table)


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def observed(spark, sf_dir):
    return queries._observations(spark, sf_dir)


def test_guard(spark, observed, tmp_path):
    got = streamed(spark, observed, "ts_ms", tmp_path, stateful.stream_guard, "guard")
    want = rows(regime.regime_guard(observed))
    assert want and rows(got) == want


def test_durations(spark, observed, tmp_path):
    scores = observed.select("symbol", "ts_ms", (F.col("rv_short") % 5).alias("volatility_z"), (F.col("spread_median") % 3).alias("spread_z"))
    scores = scores.withColumn("volatility_z", F.when(F.floor(F.col("ts_ms") / 36_000_000) % 3 == 0, F.lit(-2.0)).otherwise(F.col("volatility_z")))
    got = streamed(spark, scores, "ts_ms", tmp_path, stateful.stream_durations, "durations")
    want = rows(regime.duration_filter(scores, ["symbol"], "ts_ms"))
    assert len({r[2] for r in want}) > 1 and rows(got) == want


def test_monitor(spark, sf_dir, tmp_path):
    t = fx.ticks(spark, sf_dir)
    slip = (F.col("ask") - F.col("bid")) * 10_000
    fills = t.select("symbol", "seq", F.when(F.col("seq") % 10 > 0, slip * 0.3).alias("real_slip"), F.lit(0.2).alias("expected_slip"), (slip * 0.05).alias("real_cost_r"), F.lit(0.02).alias("estimated_cost_r"))
    got = streamed(spark, fills, "seq", tmp_path, stateful.stream_monitor, "monitor")
    want = rows(stats.execution_monitor(fills, ["symbol"], "seq"))
    # the last verdict of each symbol is that of the whole table
    assert want and set(want) <= set(rows(got))


@pytest.mark.parametrize("chunk", [500_000, 150])
def test_bursts_across_midnights(spark, sf_dir, tmp_path, chunk):
    t = fx.ticks(spark, sf_dir)
    got = streamed(spark, t, "seq", tmp_path, lambda s: stateful.stream_bursts(s, chunk, least=5), f"bursts_{chunk}")
    want = rows(regime.burst_intensity(t, least=5, chunk=chunk))
    assert len({r[2] // 86_400_000 for r in want}) > 20 and any(r[7] is not None for r in want) and rows(got) == want


def test_live_bars_have_all_that_batch_bars_have(spark, sf_dir, tmp_path):
    t = fx.ticks(spark, sf_dir)
    got = streamed(spark, t, "seq", tmp_path, lambda s: live.live_bars(s, fx.GAP_LIMIT), "bars")
    want = bars.base_bars(bars.with_gaps(t, fx.GAP_LIMIT))
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns, key=lambda c: (c not in ("symbol", "bar_start_ms"), c))
    ends = {r.symbol: r.top for r in t.groupBy("symbol").agg(F.max("time_ms").alias("top")).collect()}
    closed = [r for r in want.select(*order).collect() if r.bar_end_ms <= ends[r.symbol] - 120_000]
    plain = lambda rs: sorted((tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rs), key=repr)
    assert len(closed) > 300 and plain(got.select(*order).collect()) == plain(closed)
    assert any("HAS_SUSPICIOUS_GAP" in r.quality_flags for r in closed)


def test_live_bars_drop_repeats_and_late_ticks(spark, tmp_path):
    start = 1_704_067_200_000
    rows = [("S", i, start + i * 600_000, 1.0 + i, 1.1 + i, 0) for i in range(13)] + [("S", 13, start + 60_000, 9.0, 9.1, 0), ("S", 14, start + 3 * HOUR, 1.0, 1.1, 0)]
    t = spark.createDataFrame(rows, TICK)
    source = str(tmp_path / "in")
    for k, part in enumerate((t.where("seq < 13"), t.where("seq IN (4, 12, 13)"), t.where("seq = 14"))):
        part.coalesce(1).write.mode("append").parquet(source)
        for file in os.listdir(source):
            if file.endswith(".parquet") and os.path.getmtime(f"{source}/{file}") > 1e9:
                os.utime(f"{source}/{file}", (1000 + k, 1000 + k))
    stream = live.live_bars(spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(source), fx.GAP_LIMIT)
    q = stream.writeStream.format("memory").queryName("late_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    out = {(r.bar_start_ms - start) // HOUR: (r.tick_count, r.bid_open, r.bid_high, r.max_gap_ms) for r in spark.table("late_bars").collect()}
    # the tick that came late is in no bar, and the next gap counts from it
    assert out == {0: (6, 1.0, 6.0, 600_000), 1: (6, 7.0, 12.0, 600_000)}


def test_guard_from_snapshots_equals_one_walk(spark, observed, tmp_path):
    path = str(tmp_path / "guard")
    cuts = observed.select(F.percentile("ts_ms", F.array(F.lit(0.3), F.lit(0.7))).alias("c")).first()["c"]
    got = []
    for cut in (*cuts, float("inf")):
        got += rows(ingest.advance_guard(spark, observed.where(F.col("ts_ms") <= cut), path))
    want = rows(regime.regime_guard(observed))
    assert want and sorted(got, key=repr) == want
    assert ingest.advance_guard(spark, observed, path).count() == 0  # nothing new, and every symbol keeps its snapshot
    kept = spark.read.parquet(path).where("last_ms IS NOT NULL").groupBy("version").count().collect()
    assert {r["version"]: r["count"] for r in kept} == dict.fromkeys((1, 2, 3, 4), observed.select("symbol").distinct().count())
    assert ingest.advance_guard(spark, observed.limit(0), str(tmp_path / "none")).count() == 0
