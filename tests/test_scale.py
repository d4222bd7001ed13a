"""Selection, scans, first touches and interval joins against plain loops, with cuts small enough to matter."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.operators import extremes, labels, model, scan, selection, sequence, stats
from tickspark.schemas import DAY, HOUR, TICK

MONDAY = 1_704_067_200_000


def series():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=700).tolist(), "heavy": rng.pareto(0.3, size=500).tolist(), "tied": [1.0] * 400 + [2.0] * 80 + [1.0 + 1e-12], "one": [7.0],
        "wild": [math.inf, -math.inf, math.nan, 1.0, 2.0, 5e-324, 1.7e308, -1.7e308], None: [float(v) for v in range(9)],
    }


def listed(spark):
    return spark.createDataFrame([(k, v) for k, own in series().items() for v in own] + [("none", None), ("one", None)], "k string, v double")


@pytest.mark.parametrize("accuracy", [10_000, 8])
def test_every_order_statistic(spark, monkeypatch, accuracy):
    """Wrong brackets (of a coarse sketch) cost time, not exactness."""
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    got = selection.order_statistics(listed(spark), ["k"], "v", [0.5, 0.95], F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).collect()
    for k, own in series().items():
        mine = [r.value for r in sorted((r for r in got if r.k == k), key=lambda r: r.place)]
        assert repr(mine) == repr(sorted(own, key=lambda x: (math.isnan(x), x))) and {r["size"] for r in got if r.k == k} == {len(own)}
    assert "none" not in {r.k for r in got}


def test_percentiles_and_deviations(spark):
    own = {k: v for k, v in series().items() if k != "wild"}
    df = listed(spark).where("k IS NULL OR k <> 'wild'")
    for r in selection.percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.3, "c": 0.95, "d": 1.0}).collect():
        assert np.allclose([r.a, r.b, r.c, r.d], np.percentile(own[r.k], [0, 30, 95, 100]), rtol=1e-12) and r.n == len(own[r.k])
    everything = [v for x in own.values() for v in x]
    (r,) = selection.median_deviations(df, [], ["v"]).collect()
    middle = np.median(everything)
    assert (r.feature, r.n) == ("v", len(everything)) and np.isclose(r.median, middle) and np.isclose(r.mad, np.median(np.abs(np.array(everything) - middle)))
    assert selection.percentiles(df.where("v > 1e300"), ["k"], "v", {"a": 0.5}).count() == 0


def test_models_have_no_exact_buffers(spark):
    rows = spark.createDataFrame([(float(i % 97), float(i), i % 2, 0.01 + (i % 89) / 90) for i in range(900)], "a double, b double, y int, p double")
    t = model.conformal_threshold(rows)
    score = sorted(1 - (p if y == 1 else 1 - p) for _, _, y, p in map(tuple, rows.collect()))
    (r,) = t.collect()
    assert (r.threshold, r.n) == (score[min(899, int(899 * 0.9 + 0.999999))], 900)
    for df in (t, model.robust_scaled(rows, rows, ["a", "b"]), stats.robust_baseline(rows, ["y"], ["a", "b"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "collect_list" not in plan
    scaled = model.robust_scaled(rows, rows, ["a"]).agg(F.expr("percentile(a, 0.5)").alias("m")).first()
    assert abs(scaled.m) < 1e-12


def curve(values):
    equity = peak = 0.0
    seen, out, worst, run, longest = False, [], 0.0, 0, 0
    for v in values:
        seen = seen or v is not None
        equity += v or 0.0
        run = run + 1 if v is not None and v < 0 else 0
        longest = max(longest, run)
        if seen:
            peak = max(peak, equity)
        out.append((equity if seen else None, peak, peak - equity if seen else None))
        worst = max(worst, peak - equity)
    return out, worst, longest


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_segments_of_any_width(spark, width):
    rng = random.Random(width)
    own = {"mixed": [rng.choice((-1.0, -0.5, 0.0, 2.0, None)) for _ in range(120)], "losing": [-1.0] * 60, "winning": [0.25] * 30, "late": [None, None, None, -1.0, 3.0, -4.0], None: [-1.0, -1.0, 1.0, -1.0]}
    rows = [(k, i, f"{i:03}", v, -0.5, 0.5) for k, vs in own.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, ts_ms long, id string, net_r double, mae_r double, mfe_r double")
    found = {(r.k, r.ts_ms): (r.equity, r.peak, r.drawdown) for r in stats.equity_curve(df, ["k"], ["ts_ms", "id"], width).collect()}
    perf = {r.k: r for r in stats.performance(df, ["k"], ["ts_ms", "id"], width=width).collect()}
    for k, vs in own.items():
        want, worst, longest = curve(vs)
        assert [found[k, i] for i in range(len(vs))] == [pytest.approx(w) for w in want]
        assert (perf[k].trades, perf[k].max_drawdown_r, perf[k].longest_losing_run) == (len(vs), pytest.approx(worst), longest)
    sizes = scan.summaries(scan.local_sums(df, ["k"], ["ts_ms", "id"], "net_r", width), ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in sizes} == {k: -(-len(vs) // width) for k, vs in own.items()}


def test_bootstrap_does_not_depend_on_segments(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, i, rng.gauss(0, 1)) for k, n in (("a", 83), ("b", 3), ("c", 1), ("d", 40)) for i in range(n)], "k string, ts_ms long, net_r double")
    one, many = ({r.k: tuple(r) for r in stats.block_bootstrap(df, ["k"], ["ts_ms"], samples=60, width=w).collect()} for w in (1000, 7))
    assert {k: pytest.approx(v[1:]) for k, v in one.items()} == {k: v[1:] for k, v in many.items()} and len(one) == 4
    plan = stats.block_bootstrap(df, ["k"], ["ts_ms"], samples=60)._jdf.queryExecution().optimizedPlan().toString()
    assert "[k#" in plan and all("__seg" in line or "mean" in line or "__s#" in line or "__n#" in line for line in plan.splitlines() if "Window [" in line)


def test_intervals_of_all_lengths(spark):
    rng = random.Random(6)
    spans = [(s, i, a, a + rng.choice((-5, 0, 1, 7, 100, 5_000, 336_000))) for i in range(60) for s in "ab" for a in [rng.randrange(-3000, 400_000)]]
    points = [(rng.choice("abc"), rng.randrange(-4000, 700_000)) for _ in range(800)]
    left = spark.createDataFrame(spans, "symbol string, id int, lo long, hi long")
    right = spark.createDataFrame(points, "symbol string, t long")
    want = sorted((s, i, t) for s, i, a, b in spans for z, t in points if z == s and a <= t <= b)
    for bucket in (1, 1000):
        for sizes in ({}, {"length": F.lit(340_000)}, {"length": 336_000}, {"length": F.col("hi") - F.col("lo"), "sizes": left.select("lo", "hi").distinct()}):
            got = sequence.interval_join(left, right, "lo", "hi", "t", bucket, **sizes)
            assert sorted((r.symbol, r.id, r.t) for r in got.collect()) == want


def test_a_long_barrier_is_listed_few_times(spark):
    """Two weeks by hours would be 337 cells."""
    one = spark.createDataFrame([("S", MONDAY + 17, MONDAY + 17 + 14 * DAY)], "symbol string, a long, b long")
    points = spark.createDataFrame([("S", MONDAY)], "symbol string, t long")
    joined = sequence.interval_join(one, points, "a", "b", "t", HOUR)
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in text
    level = math.ceil(math.log2(14 * DAY / (HOUR * sequence.CELLS)))
    width = HOUR * 2**level
    assert (MONDAY + 17 + 14 * DAY) // width - (MONDAY + 17) // width + 1 <= sequence.CELLS + 1


def test_cover_is_exact_and_short(spark):
    rng = random.Random(7)
    spans = [(a, a + n) for n in (0, 1, 2, 7, 8, 9, 63, 64, 65, 500, 2400) for a in (0, 1, 7, 8, -5, rng.randrange(9999))] + [(5, 3)]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.select("a", "b", extremes.cover(F.col("a"), F.col("b")).alias("c")).collect():
        cells = sorted(k for c in r.c for k in range(c["cell"] * 8 ** c["level"], (c["cell"] + 1) * 8 ** c["level"]))
        assert cells == list(range(r.a, r.b))
        assert len(r.c) <= 3 * 2 * 7 + max(0, (r.b - r.a)) // 8**3 + 1


def ideas_and_ticks(seed, shuffled):
    rng = random.Random(seed)
    price, ticks, t = 1.0, [], MONDAY
    for i in range(900):
        t += rng.choice((0, 1, 40_000, 700_000))
        price += rng.gauss(0, 0.0004)
        ticks.append(["S", i, t, price, price + 0.0002, 0])
    if shuffled:  # a feed out of order: places do not follow times
        for _ in range(60):
            i, j = rng.randrange(900), rng.randrange(900)
            ticks[i][2], ticks[j][2] = ticks[j][2], ticks[i][2]
    ideas = []
    for k in range(120):
        a, r, long = ticks[rng.randrange(900)][2] + rng.choice((-1, 0, 5)), rng.choice((0.0005, 0.002, 0.02)), rng.random() < 0.5
        p = ticks[min(899, k * 7)][3]
        ideas.append((f"i{k}", "S", "LONG" if long else "SHORT", p, p - r if long else p + r, p + 3 * r if long else p - 3 * r, a, rng.choice((0, 60_000, 9 * HOUR, 6 * DAY))))
    return ideas, [tuple(x) for x in ticks]


@pytest.mark.parametrize("shuffled", [False, True])
def test_index_of_extremes_equals_reading_all(spark, shuffled):
    ideas, ticks = ideas_and_ticks(8, shuffled)
    c = spark.createDataFrame(ideas, "candidate_id string, symbol string, direction string, entry double, stop_loss double, take_profit double, available_ms long, max_holding_ms long")
    t = spark.createDataFrame(ticks, TICK)
    wide, narrow = (sorted(map(tuple, labels.tick_barriers(c, t, bucket_ms=b).collect()), key=repr) for b in (400 * DAY, 8 * 60_000))
    assert wide == narrow and {r[3] for r in wide} >= {"TAKE_PROFIT", "STOP_LOSS", "VERTICAL"}


def test_rows_read_do_not_grow_with_the_horizon(spark):
    ideas, ticks = ideas_and_ticks(9, False)
    t = spark.createDataFrame(ticks, TICK).select("symbol", "seq", "time_ms", "bid", "ask")
    live = lambda days: spark.createDataFrame([("x", "S", "LONG", 0.0, 9.0, MONDAY, -1, MONDAY + days * DAY)], "candidate_id string, symbol string, direction string, stop_loss double, take_profit double, entry_ms long, entry_seq long, barrier_ms long")
    few, many = (extremes.touching_ticks(live(d), t, HOUR // 8).count() for d in (1, 3))
    assert max(few, many) < 60 < sequence.interval_join(live(3), t, "entry_ms", "barrier_ms", "time_ms", HOUR).count()
