import json

import pytest
from pyspark.sql import functions as F

from tickspark.operators import bars, quality
from tickspark.plans import fixture as fx
from tickspark.schemas import DAY, HOUR, TICK
from tickspark.sources import scans, sinks
from tickspark.streaming import bars as live
from tickspark.streaming import ingest

MONDAY = 1_704_067_200_000


def test_csv_ticks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿bid,time_ms,ask,note,flags\n1.0,5,1.1,x,\n1.2,6,1.3,y,4\n", encoding="utf-8")
    rows = scans.csv_ticks(spark, str(tmp_path / "a.csv"), "S").orderBy("seq").collect()
    assert [(r.symbol, r.time_ms, r.bid, r.ask, r.flags) for r in rows] == [("S", 5, 1.0, 1.1, 0), ("S", 6, 1.2, 1.3, 4)]
    (tmp_path / "b.csv").write_text("bid,time_ms,ask\n1.0,5,1.1\n1.0,x,1.1\n")
    with pytest.raises(Exception):
        scans.csv_ticks(spark, str(tmp_path / "b.csv"), "S").collect()
    assert [r.bad_line for r in scans.csv_bad_rows(spark, str(tmp_path / "b.csv"), ["bid", "time_ms", "ask"]).collect()] == ["1.0,x,1.1"]
    (tmp_path / "c.csv").write_text("bid,ask\n1,2\n")
    with pytest.raises(ValueError, match="time_ms"):
        scans.csv_ticks(spark, str(tmp_path / "c.csv"), "S")


def snapshot(**changes):
    event = {"event_id": "e", "event_code": "C", "name": "N", "currency": "USD", "scheduled_at": "2024-01-02T10:00:00Z", "impact": "HIGH"} | changes.pop("event", {})
    return {"snapshot_id": "s", "as_of": "2024-01-01T00:00:00Z", "source": "src", "events": [event, *changes.pop("more", [])]} | changes


def test_calendar_json(spark, tmp_path):
    def read(body):
        (tmp_path / "c.json").write_text(json.dumps(body))
        return scans.calendar_json(spark, str(tmp_path / "c.json")).collect()

    (r,) = read(snapshot())
    assert (r.source, r.impact, r.scheduled_ms, r.as_of_ms) == ("src", "HIGH", MONDAY + DAY + 10 * HOUR, MONDAY)
    earlier = {"event_id": "f", "event_code": "C", "name": "N", "currency": "USD", "scheduled_at": "2024-01-02T09:00:00Z", "impact": "LOW"}
    for body, fault in ((snapshot(event={"actual": 3}), "unknown fields actual"), (snapshot(revised=1), "unknown fields revised"), (snapshot(event={"impact": "HUGE"}), "unknown impact"), (snapshot(event={"name": " "}), "empty name"), (snapshot(more=[earlier]), "out of order")):
        with pytest.raises(Exception, match=fault):
            read(body)


def test_candidates_ledger_and_summaries(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"candidate_id": "a", "symbol": "S", "direction": "LONG", "entry": 1.0}) + "\n")
    (r,) = scans.candidates_json(spark, str(tmp_path / "i.json")).collect()
    assert (r.max_holding_ms, r.risk_fraction, r.pair, r.level) == (5_400_000, 0.005, "EUR_USD", None)
    (tmp_path / "l.json").write_text('{"symbol": "S", "chunk_start_ms": 1, "status": "COMPLETED"}\nbroken\n')
    assert sorted((r.symbol or "", r.status or "") for r in scans.ledger_json(spark, str(tmp_path / "l.json")).collect()) == [("", ""), ("S", "COMPLETED")]
    body = {"F1": {"metrics": {"FIXED_RR:BASELINE_1X": {"net_expectancy_r": 0.1}}}, "F2": {"metrics": {"FIXED_RR:BASELINE_1X": {"net_expectancy_r": 0.4}}}}
    (tmp_path / "f.json").write_text(json.dumps(body))
    best = scans.best_family(scans.family_summaries(spark, str(tmp_path / "f.json"))).collect()
    assert [(r.family, r.policy, r.scenario, r.score) for r in best] == [("F2", "FIXED_RR", "BASELINE_1X", 0.4)]


def test_history_round_trip_refuses_bad_feeds(spark, tmp_path):
    rows = [("GOOD", i, MONDAY + i * HOUR, 1.0, 1.1, 0) for i in range(30)] + [("BAD", 0, MONDAY + 9, 1.0, 1.1, 0), ("BAD", 1, MONDAY, 1.0, 1.1, 0)]
    report = sinks.write_ticks(spark.createDataFrame(rows, TICK), str(tmp_path / "t"))
    assert {r.symbol: r.valid for r in report.collect()} == {"GOOD": True, "BAD": False}
    back = scans.parquet_ticks(spark, str(tmp_path / "t"), ["GOOD"], MONDAY + DAY)
    assert back.count() == 6 and back.columns == TICK.fieldNames()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(time_ms" in plan


def test_bars_reports_and_fingerprint(spark, sf_dir, tmp_path):
    b = fx.all_bars(spark, sf_dir)
    sinks.write_bars(b, str(tmp_path / "b"))
    back = scans.bar_dataset(spark, str(tmp_path / "b"), "click", ("BASE", "MID", "TOP"), fx.START, fx.END)
    assert back.count() == b.where("symbol = 'click'").count()
    with pytest.raises(ValueError, match="missing"):
        scans.bar_dataset(spark, str(tmp_path / "b"), "click", ("BASE", "H9"))
    with pytest.raises(ValueError, match="no bars"):
        scans.bar_dataset(spark, str(tmp_path / "b"), "click", ("BASE",), fx.END)
    report = sinks.with_self_hash(quality.spread_summary(fx.ticks(spark, sf_dir), ["symbol"]))
    sinks.write_json(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 5 and all(len(r.report_sha256) == 64 for r in report.collect())
    nested = sinks.nested(b.groupBy("symbol", "timeframe").count(), "symbol", "timeframe", ["count"])
    assert set(nested.first()["by_timeframe"]) == {"BASE", "MID", "TOP"}
    assert sinks.markdown(report.select("symbol", "p50").limit(1), "T").startswith("# T\n\n| symbol | p50 |")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    t = fx.ticks(spark, sf_dir)
    source = str(tmp_path / "in")
    t.orderBy("time_ms").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(TICK).parquet(source)
    q = live.start_bars(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    key = lambda df: {(r.symbol, r.bar_start_ms): (r.bid_open, r.bid_close, r.ask_high, r.tick_count, r.spread_median) for r in df.collect()}
    got = key(spark.read.parquet(str(tmp_path / "out")))
    want = key(bars.base_bars(bars.with_gaps(t, fx.GAP_LIMIT)))
    last = max(k for _, k in want)
    # the watermark holds the last window back
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if k[1] < last} <= set(got)


def test_resumable_ingest(spark, sf_dir, tmp_path):
    t = fx.ticks(spark, sf_dir).where(F.col("symbol").isin("click", "view"))
    expected = t.select("symbol").distinct().crossJoin(quality.chunk_calendar(spark, fx.START, fx.START + 8 * DAY, DAY))
    empty = spark.createDataFrame([], "symbol string, chunk_start_ms long, chunk_end_ms long, tick_count long, status string")
    data, ledger = str(tmp_path / "data"), str(tmp_path / "ledger")
    first = ingest.ingest(spark, t, expected.where(F.col("chunk_start_ms") < fx.START + 3 * DAY), empty, DAY, fx.START, data, ledger)
    assert first.count() == 6
    seen = scans.ledger_json(spark, ledger)
    assert ingest.pending_chunks(expected, seen).count() == 10
    ingest.ingest(spark, t, expected, seen, DAY, fx.START, data, ledger)
    assert ingest.pending_chunks(expected, scans.ledger_json(spark, ledger)).count() == expected.join(scans.ledger_json(spark, ledger).where("status = 'NO_BROKER_HISTORY'"), ["symbol", "chunk_start_ms"], "left_semi").count()
    assert scans.parquet_ticks(spark, data).count() == t.where(F.col("time_ms") < fx.START + 8 * DAY).count()


def test_csv_files_in_other_orders(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ask,time_ms,bid\n" + "".join(f"{1.1 + i},{100 + i},{1.0 + i}\n" for i in range(3)))
    (tmp_path / "a.csv").write_text("\ufefftime_ms,bid,ask,flags\n5,1.0,1.1,2\n6,2.0,2.1,\n", encoding="utf-8")
    rows = scans.csv_ticks(spark, str(tmp_path), "S").orderBy("seq").collect()
    assert [(r.seq, r.time_ms, r.bid, r.flags) for r in rows] == [(0, 5, 1.0, 2), (1, 6, 2.0, 0), (2, 100, 1.0, 0), (3, 101, 2.0, 0), (4, 102, 3.0, 0)]
    assert all(r.ask > r.bid for r in rows)


def test_a_bad_cell_is_told_with_its_line(spark, tmp_path):
    lines = [f"{100 + i},1.0,1.1,2" for i in range(4000)]
    for name, at, line in (("a", 2999, "abc,1.0,1.1,0"), ("b", 0, "5,,1.1,0"), ("c", 3999, "5,1.0,1.1,x"), ("d", 10, "5,1.0")):
        (tmp_path / f"{name}.csv").write_text("time_ms,bid,ask,flags\n" + "\n".join([*lines[:at], line, *lines[at + 1 :]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # several blocks a file
    try:
        for name, told in (("a", r"a.csv line 3001: time_ms = abc"), ("b", r"b.csv line 2: bid = "), ("c", r"c.csv line 4001: flags = x"), ("d", r"d.csv line 12: ask = ")):
            with pytest.raises(Exception, match=told):
                scans.csv_ticks(spark, str(tmp_path / f"{name}.csv"), "S").collect()
        (tmp_path / "e.csv").write_text("time_ms,bid,ask,flags\n" + "\n".join(lines) + "\n")
        rows = scans.csv_ticks(spark, str(tmp_path / "e.csv"), "S").orderBy("seq").collect()
        assert [(r.seq, r.time_ms, r.flags) for r in rows] == [(i, 100 + i, 2) for i in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifest_reads_new_files_only(spark, sf_dir, tmp_path):
    b = fx.all_bars(spark, sf_dir).where("timeframe = 'BASE'")
    path, manifest = str(tmp_path / "bars"), str(tmp_path / "manifest")
    for k, symbol in enumerate(("click", "view")):
        b.where(F.col("symbol") == symbol).coalesce(1).write.mode("append").partitionBy("symbol", "timeframe").parquet(path)
        files = sinks.update_manifest(spark, path, manifest)
        assert files.count() == k + 1 == spark.read.parquet(manifest).count()
    assert sinks.update_manifest(spark, path, manifest).count() == 2 == spark.read.parquet(manifest).count()
    got = {r.symbol: (r.rows, r.files) for r in sinks.manifest_of(files).collect()}
    assert got == {s: (b.where(F.col("symbol") == s).count(), 1) for s in ("click", "view")}
    b.where("symbol = 'view'").limit(3).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe").parquet(path)
    assert {r.symbol: r.rows for r in sinks.update_manifest(spark, path, manifest).collect()}["view"] == 3


def test_json_has_plain_values(spark, tmp_path):
    sql = "SELECT timestamp'2026-01-02 03:04:05' AS a, timestamp'2026-01-02 03:04:05.25' AS b, double('NaN') AS c, array(double('Infinity'), 1.5D) AS d, map(7, timestamp'2026-01-01 00:00:00') AS e, named_struct('x', double('-Infinity'), 'y', 'z') AS f, CAST(NULL AS STRUCT<x: DOUBLE>) AS g, timestamp_ntz'2026-01-02 03:04:05.000001' AS h"
    sinks.write_json(spark.sql(sql), str(tmp_path / "j"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert json.loads(line) == {"a": "2026-01-02T03:04:05Z", "b": "2026-01-02T03:04:05.250000Z", "d": [None, 1.5], "e": {"7": "2026-01-01T00:00:00Z"}, "f": {"y": "z"}, "h": "2026-01-02T03:04:05.000001Z"}


def test_report_of_arms(spark):
    from tickspark.plans.studies import research_report

    rows = [("F", p, s, f"c{i}", i * HOUR, g, g - c, 0.0, 1.0) for p, g in (("A", 1.0), ("B", 0.05)) for i in range(12) for s, c in (("BASELINE_1X", 0.04), ("BASELINE_1.25X", 0.05))]
    facts = spark.createDataFrame(rows, "family string, policy string, scenario string, candidate_id string, exit_ms long, gross_r double, net_r double, mae_r double, mfe_r double")
    report = research_report(facts, ["family"], samples=20)
    got = {r.policy: r for r in report.collect()}
    assert (got["A"].execution_fragile, got["B"].execution_fragile) == (False, True) and got["A"].lower_95 == pytest.approx(0.96)
    assert got["A"].lineage == got["B"].lineage and len(got["A"].lineage) == 64  # the same trades under two policies
    text = sinks.research_markdown(report, "Study", ["family", "policy"])
    assert "| F A | 12 | 0.960 [0.960, 0.960] | 1.000 | 100.0% | 0.000 | 0 |" in text and "- F B: BASELINE_1.25X 0.000; fragile: true" in text and got["A"].lineage in text


def test_ingest_after_a_stop_repeats_nothing(spark, tmp_path):
    data, ledger = str(tmp_path / "data"), str(tmp_path / "ledger")
    ticks = spark.createDataFrame([("S", i, MONDAY + i * HOUR, 1.0, 1.1, 0) for i in range(60)], TICK)
    expected = spark.createDataFrame([("S", MONDAY + k * DAY, MONDAY + (k + 1) * DAY) for k in range(3)], "symbol string, chunk_start_ms long, chunk_end_ms long")
    nothing = spark.createDataFrame([], "symbol string, chunk_start_ms long, chunk_end_ms long, tick_count long, status string")
    sinks.write_ticks(ticks.where("seq < 30"), data)  # a run that stopped before its ledger entries
    ingest.ingest(spark, ticks, expected, nothing, DAY, MONDAY, data, ledger)
    assert spark.read.parquet(data).count() == 60
    assert sorted((r.chunk_start_ms, r.tick_count) for r in scans.ledger_json(spark, ledger).collect()) == [(MONDAY + k * DAY, n) for k, n in enumerate((24, 24, 12))]


CHUNKS = "symbol string, chunk_start_ms long, chunk_end_ms long"


def halves(spark, n):
    return spark.createDataFrame([("S", MONDAY + k * DAY // 2, MONDAY + (k + 1) * DAY // 2) for k in range(n)], CHUNKS)


def run(spark, tmp_path, ticks, expected, **more):
    """One ingest by half days; what the ledger then says of each chunk and how many ticks the history has of it."""
    data, ledger = str(tmp_path / "data"), str(tmp_path / "ledger")
    step = DAY // 2
    made = ingest.ingest(spark, spark.createDataFrame(ticks, TICK), expected, scans.lineage_json(spark, ledger), step, MONDAY, data, ledger, **more)
    index = lambda df: {(r.chunk_start_ms - MONDAY) // step: r for r in df.collect()}
    held = index(quality.with_chunk(scans.parquet_ticks(spark, data), MONDAY, step).groupBy("symbol", "chunk_start_ms").count())
    return index(made), index(quality.latest_entries(scans.lineage_json(spark, ledger))), {k: r["count"] for k, r in held.items()}


def test_a_bad_tick_loses_its_chunk_only(spark, tmp_path):
    hour = lambda h, ask=1.1: ("S", h, MONDAY + h * HOUR, 1.0, ask, 0)
    ticks = [hour(h, 0.9 if h == 14 else 1.1) for h in range(48) if not 24 <= h < 36]
    made, last, held = run(spark, tmp_path, ticks, halves(spark, 4), source="feed", config_sha256="c")
    assert {k: (r.status, r.tick_count, r.run) for k, r in made.items()} == {0: ("COMPLETED", 12, 1), 2: ("NO_BROKER_HISTORY", 0, 1), 3: ("COMPLETED", 12, 1)}
    assert held == {0: 12, 3: 12} and made[2].hard_failures == ["EMPTY"] and (made[0].source, made[0].config_sha256) == ("feed", "c")
    verdicts = spark.read.parquet(str(tmp_path / "ledger") + "-verdicts").collect()
    assert {(r.chunk_start_ms - MONDAY) * 2 // DAY: r.hard_failures for r in verdicts if not r.valid} == {1: ["CROSSED_QUOTES"], 2: ["EMPTY"]}
    # mended: the refused half of the day comes in beside the settled one, which is not read from the source again
    made, last, held = run(spark, tmp_path, [hour(h) for h in range(12, 36)], halves(spark, 4))
    assert {k: (r.status, r.run) for k, r in made.items()} == {1: ("COMPLETED", 2), 2: ("COMPLETED", 2)}
    assert held == {0: 12, 1: 12, 2: 12, 3: 12} and {r.run for r in last.values()} == {1, 2}
    made, last, held = run(spark, tmp_path, [hour(99)], halves(spark, 4))
    assert not made and held == {0: 12, 1: 12, 2: 12, 3: 12}
    whole = quality.chunk_coverage(halves(spark, 4), spark.createDataFrame([("S", MONDAY + k * DAY // 2, 12) for k in held], "symbol string, chunk_start_ms long, file_ticks long"), scans.lineage_json(spark, str(tmp_path / "ledger")))
    assert [(r.expected, r.completed, r.percent, r.severity) for r in quality.coverage_summary(whole).collect()] == [(4, 4, 100.0, "PASS")]
    ids = [r.lineage_id for r in scans.lineage_json(spark, str(tmp_path / "ledger")).collect()]
    assert len(set(ids)) == len(ids) == 5


def test_runs_that_bring_nothing_or_stop_early(spark, tmp_path):
    tick = lambda h, ask: ("S", h, MONDAY + h * HOUR, 1.0, ask, 0)
    ledger = str(tmp_path / "ledger")
    bad = spark.createDataFrame([tick(1, 0.5)], TICK)
    ingest.ingest(spark, bad, halves(spark, 1), scans.lineage_json(spark, ledger), DAY // 2, MONDAY, str(tmp_path / "data"), ledger)
    # nothing was written and nothing entered, so the next run has the same number; its own verdicts count
    made, last, held = run(spark, tmp_path, [tick(1, 1.5), tick(2, 1.5)], halves(spark, 1))
    assert (held, {k: (r.status, r.run) for k, r in last.items()}) == ({0: 2}, {0: ("COMPLETED", 1)})


def test_order_is_judged_within_a_chunk(spark, tmp_path):
    """A tick that is late by a chunk breaks no order in the chunk that its time lies in."""
    rows = [("S", 0, MONDAY + 20 * HOUR, 1.0, 1.1, 0), ("S", 1, MONDAY + 2 * HOUR, 1.0, 1.1, 0), ("S", 2, MONDAY + 21 * HOUR, 1.0, 1.1, 0), ("S", 3, MONDAY + HOUR, 1.0, 1.1, 0)]
    made, _, held = run(spark, tmp_path, rows, halves(spark, 2))
    assert held == {1: 2} and set(made) == {1}


def test_strict_ingest_keeps_what_is_sound(spark, tmp_path):
    rows = [("S", 0, MONDAY, 1.0, 1.1, 0), ("S", 1, MONDAY + DAY // 2, 1.0, 0.9, 0)]
    with pytest.raises(ValueError, match="CROSSED_QUOTES"):
        run(spark, tmp_path, rows, halves(spark, 2), strict=True)
    assert [r.status for r in scans.lineage_json(spark, str(tmp_path / "ledger")).collect()] == ["COMPLETED"]
    with pytest.raises(ValueError, match="EMPTY"):
        run(spark, tmp_path / "other", rows[:1], halves(spark, 2), strict=True, record_missing=False)


def test_chunks_without_history_may_settle(spark, tmp_path):
    tick = [("S", 0, MONDAY, 1.0, 1.1, 0)]
    run(spark, tmp_path, tick, halves(spark, 2))
    made, _, _ = run(spark, tmp_path, tick, halves(spark, 2), retry_missing=False)
    assert not made
    made, last, _ = run(spark, tmp_path, tick, halves(spark, 2))
    assert {k: r.run for k, r in made.items()} == {1: 2} and last[1].status == "NO_BROKER_HISTORY"


def test_the_last_entry_of_a_chunk_counts(spark):
    rows = [("S", 1, 2, 0, "NO_BROKER_HISTORY", 1), ("S", 1, 2, 5, "COMPLETED", 3), ("S", 1, 2, 0, "NO_BROKER_HISTORY", 2), ("T", 1, 2, 4, "COMPLETED", None)]
    ledger = spark.createDataFrame(rows, CHUNKS + ", tick_count long, status string, run long")
    assert sorted((r.symbol, r.tick_count, r.status) for r in quality.latest_entries(ledger).collect()) == [("S", 5, "COMPLETED"), ("T", 4, "COMPLETED")]
    assert quality.latest_entries(ledger.drop("run")).count() == 2
    expected = spark.createDataFrame([("S", 1, 2), ("T", 1, 2)], CHUNKS)
    assert ingest.pending_chunks(expected, ledger).count() == 0 and ingest.pending_chunks(expected, ledger.where("run < 3")).count() == 2
