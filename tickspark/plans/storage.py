"""Registered queries over sinks and sources: what the tables give is written to the shared folder and read back.

Reading back loops over the feeds where a source takes one symbol; ticks and bars stay in Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, prices
from ..operators import bars, quality
from ..schemas import DAY, HOUR
from ..sources import scans, sinks
from ..streaming.ingest import advance_guard, ingest
from . import fixture as fx
from .queries import _BAR, _chunks, _family_facts, _faulty, _named_ideas, _observations, _session_study, flags, query, r
from .studies import failure_analysis, registry

#: Half-open range that the histories are read back for.
FROM, TO = fx.START + 5 * DAY, fx.START + 25 * DAY


def _tick_columns(t: DataFrame) -> DataFrame:
    return t.select("symbol", "seq", "time_ms", r("bid"), r("ask"), "flags")


def _of_symbols(df: DataFrame, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` gives for each feed of ``df``."""
    symbols = sorted(row.symbol for row in df.select("symbol").distinct().collect())
    return reduce(DataFrame.unionByName, map(read, symbols))


@query
def csv_history(spark, sf_dir):
    """Every feed as CSV files with a header; ``seq`` is the place in the files."""
    path = fx.new_folder(spark, "csv-history")
    t = fx.ticks(spark, sf_dir)
    ordered = t.repartitionByRange("symbol", "seq").sortWithinPartitions("symbol", "seq")
    ordered.select("symbol", "ask", "time_ms", "bid", F.when(F.col("flags") > 0, F.col("flags")).alias("flags")).write.partitionBy("symbol").option("header", True).csv(path)
    return _tick_columns(_of_symbols(t, lambda s: scans.csv_ticks(spark, f"{path}/symbol={s}", s)))


@query
def tick_history(spark, sf_dir):
    """Sound feeds beside faulty ones through the gated sink: the range that is read back holds the sound ones only."""
    path = fx.new_folder(spark, "tick-history")
    t = fx.ticks(spark, sf_dir)
    faulty = _faulty(spark, sf_dir).withColumn("symbol", F.concat("symbol", F.lit("-faulty")))
    sinks.write_ticks(t.unionByName(faulty.select(*t.columns)), path)
    return _tick_columns(scans.parquet_ticks(spark, path, None, FROM, TO))


@query
def bar_history(spark, sf_dir):
    path = fx.new_folder(spark, "bar-history")
    b = fx.all_bars(spark, sf_dir)
    sinks.write_bars(b, path)
    back = _of_symbols(b, lambda s: scans.bar_dataset(spark, path, s, ("BASE", "MID", "TOP"), FROM, TO))
    return back.select("symbol", "timeframe", "bar_start_ms", "bar_end_ms", *map(r, _BAR), "tick_count")


@query
def signed_bar_report(spark, sf_dir):
    """The bar report as written beside the bars, and whether its digest is that of its text."""
    path = fx.new_folder(spark, "bar-build")
    b = fx.all_bars(spark, sf_dir)
    report = bars.build_report(b, fx.ticks(spark, sf_dir), bars.reconcile(b), fx.START, fx.END)
    sinks.write_bar_build(b, report, path)
    return scans.signed_json(spark, f"{path}/report", report.schema, "payload_sha256")


@query
def candidate_import(spark, sf_dir):
    """Candidates as JSON lines, some without holding time, risk, pair or timeframe."""
    path = fx.new_folder(spark, "candidates")
    long = prices.is_long()
    ideas = fx.ideas(spark, sf_dir).select("candidate_id", "symbol", "direction", "entry", "stop_loss", "available_ms", F.when(long, 3_600_000).alias("max_holding_ms"), F.when(~long, 0.01).alias("risk_fraction"), F.when(F.col("regime") == "BULL", F.col("symbol")).alias("pair"))
    sinks.write_json(ideas, path)
    back = scans.candidates_json(spark, path)
    return back.select("candidate_id", "symbol", "direction", r("entry", None, 9), r("stop_loss", None, 9), "available_ms", "max_holding_ms", "risk_fraction", "pair", "timeframe")


@query
def calendar_import(spark, sf_dir):
    """A calendar snapshot per feed with the first tick of each day as an event; those at weekends name a source of their own."""
    path = fx.new_folder(spark, "calendars")
    iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    day = clock.day_number(F.col("time_ms"))
    first = fx.ticks(spark, sf_dir).groupBy("symbol", day.alias("day")).agg(F.min("time_ms").alias("time_ms"), F.min_by("seq", F.struct("time_ms", "seq")).alias("seq"))
    weekend = clock.weekday(F.col("time_ms")) >= 5
    event = F.struct(
        iso(F.col("time_ms")).alias("scheduled_at"), F.col("seq").cast("string").alias("event_id"), F.col("symbol").alias("event_code"), F.concat("symbol", F.lit(" "), "day").alias("name"), F.lit("USD").alias("currency"),
        F.when(weekend, "LOW").otherwise("HIGH").alias("impact"), F.when(weekend, "weekend").alias("source"),
    )
    listed = first.groupBy("symbol").agg(F.array_sort(F.collect_list(event)).alias("events"))
    body = F.to_json(F.struct(F.col("symbol").alias("snapshot_id"), iso(F.lit(fx.START)).alias("as_of"), F.lit("desk").alias("source"), "events"))
    listed.select("symbol", body.alias("value")).repartition("symbol").write.partitionBy("symbol").text(path)
    return scans.calendar_json(spark, path)


@query
def ledger_import(spark, sf_dir):
    """Ledger entries appended in two runs."""
    path = fx.new_folder(spark, "ledger")
    entries = _chunks(spark, sf_dir)[2]
    early = F.col("chunk_start_ms") < fx.START + 15 * DAY
    sinks.append_ledger(entries.where(early), path)
    sinks.append_ledger(entries.where(~early), path)
    return scans.ledger_json(spark, path)


@query
def resumed_ingest(spark, sf_dir):
    """The feeds brought in by daily chunks in two runs: each chunk's ledger entry beside the ticks that the history has of it."""
    data, ledger = fx.new_folder(spark, "ingest-data"), fx.new_folder(spark, "ingest-ledger")
    t = fx.ticks(spark, sf_dir)
    expected = t.select("symbol").distinct().crossJoin(quality.chunk_calendar(spark, fx.START, fx.END, DAY))
    none = spark.createDataFrame([], "symbol string, chunk_start_ms long, chunk_end_ms long, tick_count long, status string")
    ingest(spark, t, expected.where(F.col("chunk_start_ms") < fx.START + 15 * DAY), none, DAY, fx.START, data, ledger)
    ingest(spark, t, expected, scans.ledger_json(spark, ledger), DAY, fx.START, data, ledger)
    entries = quality.latest_entries(scans.lineage_json(spark, ledger)).select("symbol", "chunk_start_ms", "tick_count", "status")
    return entries.join(_held(spark, data), ["symbol", "chunk_start_ms"], "left").na.fill(0, ["file_ticks"])


def _held(spark: SparkSession, data: str) -> DataFrame:
    """Ticks that a history has of each daily chunk."""
    return quality.with_chunk(scans.parquet_ticks(spark, data), fx.START, DAY).groupBy("symbol", "chunk_start_ms").agg(F.count("*").alias("file_ticks"))


def _marred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of which the last one of some days is crossed, and of others comes an hour too early."""
    t = quality.with_chunk(fx.ticks(spark, sf_dir), fx.START, DAY)
    last = t.groupBy("symbol", "chunk_start_ms").agg(F.max("seq").alias("__last"))
    n, at_end = (F.col("chunk_start_ms") - fx.START) / DAY, F.col("seq") == F.col("__last")
    early = F.greatest(F.col("chunk_start_ms"), F.col("time_ms") - HOUR)
    crossed = F.when(at_end & (n % 7 == 2), F.col("bid") - 0.001).otherwise(F.col("ask"))
    return t.join(last, ["symbol", "chunk_start_ms"]).withColumn("ask", crossed).withColumn("time_ms", F.when(at_end & (n % 7 == 4), early).otherwise(F.col("time_ms"))).select(*t.columns[:-1])


def _repeated_ingest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three runs of one ingest: some days of a marred source, all days of it, and all again after the crossed quotes were mended. Gives the expected chunks, what the history holds and all ledger entries."""
    data, ledger = fx.new_folder(spark, "chunk-data"), fx.new_folder(spark, "chunk-ledger")
    t, marred = fx.ticks(spark, sf_dir), _marred(spark, sf_dir)
    expected = t.select("symbol").distinct().crossJoin(quality.chunk_calendar(spark, fx.START, fx.END, DAY))
    late = (F.floor((F.col("time_ms") - fx.START) / DAY) % 7) == 4
    mended = t.where(~late).unionByName(marred.where(late))
    for source, chunks in ((marred, expected.where(F.col("chunk_start_ms") < fx.START + 15 * DAY)), (marred, expected), (mended, expected)):
        ingest(spark, source, chunks, scans.lineage_json(spark, ledger), DAY, fx.START, data, ledger, source="events", config_sha256=fx.STUDY)
    return expected, _held(spark, data), scans.lineage_json(spark, ledger)


@query
def chunk_verdicts(spark, sf_dir):
    """Every day of every feed with faults, judged on its own, and the days without ticks."""
    t = quality.with_chunk(_faulty(spark, sf_dir), fx.START, DAY)
    chunks = t.select("symbol").distinct().crossJoin(quality.chunk_calendar(spark, fx.START - 7 * DAY, fx.END, DAY))
    q = quality.chunk_quality(t.where(F.col("time_ms") >= fx.START - 7 * DAY), chunks, gap_threshold=fx.GAP_LIMIT)
    return q.select("symbol", "chunk_start_ms", "tick_count", "out_of_order", "equal_times", "duplicates", "crossed", "nonpositive", "gaps", r("spread_median"), flags("hard_failures"), "valid")


@query
def repeated_ingest(spark, sf_dir):
    """Each chunk after three runs: what history and ledger say of it, and how many entries it has."""
    expected, files, entries = _repeated_ingest(spark, sf_dir)
    n = entries.groupBy("symbol", "chunk_start_ms").agg(F.count("*").alias("entries"), F.max("run").alias("last_run"))
    out = quality.chunk_coverage(expected, files, entries).join(n, ["symbol", "chunk_start_ms"], "left").na.fill(0, ["entries", "last_run"])
    return out.select("symbol", "chunk_start_ms", "file_ticks", "ledger_ticks", "chunk_status", "entries", "last_run")


@query
def ingest_coverage(spark, sf_dir):
    """Coverage by feed after three runs."""
    s = quality.coverage_summary(quality.chunk_coverage(*_repeated_ingest(spark, sf_dir)))
    return s.select("symbol", "expected", "completed", "closed", "missing", "mismatches", r("percent"), "severity")


@fx.shared
def _family_metrics(spark, sf_dir) -> DataFrame:
    return _family_facts(spark, sf_dir).groupBy("family", "policy", "scenario").agg(F.count("*").alias("trades"), F.round(F.avg("net_r"), 6).alias("net_expectancy_r"))


def _experiment(spark: SparkSession, sf_dir: str) -> str:
    path = fx.new_folder(spark, "experiment")
    metrics = _family_metrics(spark, sf_dir)
    sinks.write_experiment(_family_facts(spark, sf_dir), metrics, registry(metrics, fx.STUDY), path, ["net_expectancy_r", "trades"])
    return path


@query
def experiment_results(spark, sf_dir):
    """The facts of the family study as written, of one policy and scenario."""
    facts = scans.baseline_results(spark, f"{_experiment(spark, sf_dir)}/facts")
    return facts.select("family", "candidate_id", "policy", "scenario", "outcome", r("net_r"))


@query
def family_summaries(spark, sf_dir):
    s = scans.family_summaries(spark, f"{_experiment(spark, sf_dir)}/families")
    return s.select("family", "policy", "scenario", F.col("values.net_expectancy_r").alias("net_expectancy_r"), F.col("values.trades").cast("long").alias("trades"))


@query
def failure_report(spark, sf_dir):
    """The failure analysis as written, read back: trades, geometry, correlation and slices of each family."""
    path = fx.new_folder(spark, "failures")
    facts = _family_facts(spark, sf_dir)
    sinks.write_failure_analysis(failure_analysis(facts, _named_ideas(spark, sf_dir), fx.all_bars(spark, sf_dir).where("timeframe = 'BASE'"), fx.HORIZON), registry(_family_metrics(spark, sf_dir), fx.STUDY), path)
    a = scans.failure_analysis(spark, path)
    return a.select("family", "oos_trades", F.col("geometry.paths").alias("paths"), r("geometry.hit_1_0r", "hit_1r"), r("geometry.ambiguity_rate", "ambiguity_rate"), r(F.col("correlations")["impulse"], "impulse_correlation"), F.size("slices").cast("long").alias("slices"))


@query
def bar_manifest(spark, sf_dir):
    """Bars written in two parts, the manifest being kept up after each: files, rows, unusable bars and range of each symbol and timeframe."""
    path, manifest = fx.new_folder(spark, "manifest-bars"), fx.new_folder(spark, "manifest")
    b = fx.all_bars(spark, sf_dir)
    early = F.col("bar_start_ms") < fx.START + 15 * DAY
    for part in (early, ~early):
        b.where(part).repartition("symbol", "timeframe").write.mode("append").partitionBy("symbol", "timeframe").parquet(path)
        files = sinks.update_manifest(spark, path, manifest)
    m = sinks.manifest_of(files)
    return m.select("symbol", "timeframe", "files", "rows", "unusable", "start_ms", "end_ms", (F.col("bytes") > 0).alias("sized"), F.length("files_sha256").alias("digest_length"))


@query
def resumed_guard(spark, sf_dir):
    """The regime guard in three runs, each from the snapshot of the one before it and over all observations so far."""
    path = fx.new_folder(spark, "guard")
    o = _observations(spark, sf_dir)
    parts = [advance_guard(spark, o.where(F.col("ts_ms") < fx.START + days * DAY), path) for days in (9, 20, 40)]
    v = reduce(DataFrame.unionByName, parts)
    return v.select("symbol", "ts_ms", "event", "valid", *(r(c, None, 5) for c in ("signal", "confidence", "change_probability", "expected_run")), "suggested_multiplier", "applied_multiplier")


@query
def best_family(spark, sf_dir):
    """The one family, policy and scenario with the highest expectancy."""
    s = scans.family_summaries(spark, f"{_experiment(spark, sf_dir)}/families")
    return scans.best_family(s.where("policy = 'FIXED_RR' AND scenario = 'BASELINE_1X'")).select("family", "policy", "scenario", "score")


@query
def nested_study(spark, sf_dir):
    """The session study as JSON by event, and within it by period and horizon, read back as rows."""
    path = fx.new_folder(spark, "session-study")
    s = _session_study(spark, sf_dir).withColumn("slot", F.concat_ws(":", "period", "horizon")).withColumn("median_pips", F.round("median_pips", 6))
    sinks.write_json(sinks.nested(s, "event", "slot", ["n", "median_pips"]), path)
    back = spark.read.schema("event string, by_slot map<string,struct<n:long,median_pips:double>>").json(path)
    return back.select("event", F.explode("by_slot").alias("slot", "found")).select("event", "slot", "found.n", "found.median_pips")

