"""Sinks: gated tick history, bars, reports and the chunk ledger."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..operators import quality
from ..schemas import LINEAGE, TICK
from . import scans


def write_ticks(ticks: DataFrame, path: str, mode: str = "append", known: DataFrame | None = None) -> DataFrame:
    """Write the feeds that pass the hard gate, by symbol and day, less the ticks whose (symbol, day, seq) is ``known``; returns the quality table with the verdicts. Refused feeds are not written."""
    report = quality.feed_quality(ticks).cache()
    good = quality.gate(ticks, report)
    out = good.withColumn("day", clock.day_number(F.col("time_ms"))).withColumn("ts", F.timestamp_millis("time_ms"))
    if known is not None:
        out = out.join(known, ["symbol", "day", "seq"], "left_anti")
    out.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "seq").write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(path)
    return report


def replace_days(ticks: DataFrame, path: str) -> None:
    """Write ticks by symbol and day, in place of what these partitions held before; all others stay. Tasks get ranges of rows, so a busy day is several files."""
    placed = ticks.select(*TICK.fieldNames(), clock.day_number(F.col("time_ms")).alias("day"), F.timestamp_millis("time_ms").alias("ts"))
    keys = ["symbol", "day", "seq"]
    out = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "zstd").partitionBy("symbol", "day").parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    bars.repartition("symbol", "timeframe").write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)


def update_manifest(spark: SparkSession, bars_path: str, manifest_path: str) -> DataFrame:
    """Enter the files of a bar history that its manifest does not know yet, by name, size and time of change, and return the manifest's rows for the files that are there now.

    Only new files are read; entries of files that are gone or were written anew stay in the manifest and are left out of what is returned.
    """
    listed = [re.sub("^file:///", "file:/", f) for f in spark.read.parquet(bars_path).inputFiles()]  # what the driver lists for any scan, in the form of the metadata
    names = spark.createDataFrame([(f,) for f in listed], "file string")
    known = spark.read.parquet(manifest_path).select("file") if scans.exists(spark, manifest_path) else names.limit(0)
    new = [r.file for r in names.join(known, "file", "left_anti").collect()]
    if new:
        scans.bar_files(spark, bars_path, new).write.mode("append").parquet(manifest_path)
    return spark.read.parquet(manifest_path).join(names, "file", "left_semi").dropDuplicates(["file"])


def manifest_of(files: DataFrame) -> DataFrame:
    """One row per symbol and timeframe of a manifest of files: rows, unusable bars, range of time, and the digest of its files' names and sizes."""
    per = files.groupBy("symbol", "timeframe").agg(
        F.sum("rows").alias("rows"), F.sum("unusable").alias("unusable"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "file", "bytes", "changed_ms"))), ","), 256).alias("files_sha256"),
    )
    return per


def with_self_hash(report: DataFrame, name: str = "report_sha256") -> DataFrame:
    """Columns in order of name, then the digest of the row's JSON: what :func:`write_json` writes of it can be checked by its text."""
    names = sorted(report.columns)
    return report.select(*names, F.sha2(F.to_json(F.struct(*names)), 256).alias(name))


def write_bar_build(bars: DataFrame, report: DataFrame, path: str) -> None:
    """Bars under ``path/bars``, then their report with its digest under ``path/report``."""
    write_bars(bars, f"{path}/bars")
    write_json(with_self_hash(report, "payload_sha256"), f"{path}/report")


def iso_utc(at: Column) -> Column:
    """A time as ISO 8601 in UTC with a Z; a fraction only where there is one, in microseconds."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_trunc("second", at) == at, "").otherwise(F.date_format(at, ".SSSSSS")), F.lit("Z"))


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return iso_utc(c)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_safe(c[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), _safe(e["value"], kind.valueType).alias("value"))))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """The rows with what plain JSON has: times as ISO text in UTC, keys of maps as text, no number that isn't finite; at any depth."""
    return df.select(*(_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def write_json(report: DataFrame, path: str) -> None:
    json_safe(report).write.mode("overwrite").json(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Entries are appended after their data: a chunk counts as done only with both."""
    entries.select("symbol", "chunk_start_ms", "chunk_end_ms", "tick_count", "status").write.mode("append").json(path)


def append_lineage(entries: DataFrame, path: str) -> None:
    """Entries of one run, each with a digest that names it by all it says but its run. Later entries of a chunk stand for it; earlier ones stay readable."""
    told = [c for c in LINEAGE.fieldNames() if c not in ("run", "lineage_id")]
    entries.withColumn("lineage_id", F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256)).select(*LINEAGE.fieldNames()).write.mode("append").json(path)


def nested(df: DataFrame, outer: str, inner: str, values: list[str]) -> DataFrame:
    """One row per ``outer`` with a map from ``inner`` to a struct: the shape of a nested JSON report."""
    return df.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), F.struct(*values))))).alias("by_" + inner))


def write_families(metrics: DataFrame, path: str, values: list[str]) -> None:
    """One JSON object of families, each with a map ``policy:scenario`` to its values: what :func:`tickspark.sources.scans.family_summaries` reads. Families, policies and scenarios are few by design."""
    of_key = F.map_from_entries(F.array(*(F.struct(F.lit(v), F.col(v).cast("double")) for v in values)))
    keyed = metrics.select("family", F.struct(F.concat_ws(":", "policy", "scenario").alias("key"), of_key.alias("values")).alias("entry"))
    bodies = keyed.groupBy("family").agg(F.struct(F.map_from_entries(F.collect_list("entry")).alias("metrics")).alias("body"))
    whole = bodies.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("family", "body")))).alias("value"))
    whole.write.mode("overwrite").text(path)


def write_experiment(facts: DataFrame, metrics: DataFrame, registry: DataFrame, path: str, values: list[str]) -> None:
    """A study's facts as Parquet, then the summary of its families and the register of its hypotheses as JSON."""
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    write_families(metrics, f"{path}/families", values)
    write_json(registry, f"{path}/registry")


def write_failure_analysis(analysis: DataFrame, registry: DataFrame, path: str) -> None:
    """A JSON object per family with its slices, correlations and geometry, then the register of hypotheses."""
    write_json(analysis, f"{path}/failure_analysis")
    write_json(registry, f"{path}/registry")


def research_markdown(report: DataFrame, title: str, arm: list[str] = ["policy"], none: str = "NOT_RECORDED") -> str:
    """A report of arms as Markdown: the table with intervals, then lineage, and the mean under each cost scenario. A row per arm goes through the driver, no trade does."""
    rows = sorted(report.collect(), key=lambda r: [str(r[c]) for c in arm])
    name = lambda r: " ".join(str(r[c]) for c in arm)
    number = lambda v, kind=".3f": "n/a" if v is None else format(v, kind)
    head = ["Arm", "Trades", "Net expectancy R (95% interval)", "Gross R", "Win rate", "Max drawdown R", "Losing run", "Trades a week"]
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    for r in rows:
        interval = f"{number(r.expectancy_r)} [{number(r.lower_95)}, {number(r.upper_95)}]"
        lines.append("| " + " | ".join([name(r), str(r.trades), interval, number(r.gross_ev_r), number(r.win_rate, ".1%"), number(r.max_drawdown_r), str(r.longest_losing_run), number(r.trades_per_week, ".2f")]) + " |")
    lines += ["", "## Lineage", "", *(f"- {name(r)}: {r.lineage or none}" for r in rows), "", "## Cost scenarios", ""]
    for r in rows:
        told = ", ".join(f"{k} {number(v)}" for k, v in sorted((r.stress or {}).items())) or none
        lines.append(f"- {name(r)}: {told}; fragile: {str(r.execution_fragile).lower()}")
    return "\n".join(lines) + "\n"


def arm_report(metrics: DataFrame) -> DataFrame:
    """A row per policy of its plain scenario, with the mean under 1.25 times the cost and whether that makes it fragile."""
    plain = metrics.where("scenario = 'BASELINE_1X'")
    stress = metrics.where("scenario = 'BASELINE_1.25X'").select("symbol", "policy", F.col("expectancy_r").alias("stress_ev_r"))
    return plain.join(stress, ["symbol", "policy"], "left").withColumn("execution_fragile", F.coalesce(F.col("stress_ev_r") <= 0, F.lit(False)))


def markdown(rows: DataFrame, title: str) -> str:
    """A small report as Markdown; for tables with a row per arm."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join(lines) + "\n"
