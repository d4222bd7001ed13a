"""Resumable ingest by chunks: what the ledger has is not read again, and a chunk is done only with its data and its entry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..operators import quality, regime
from ..operators.quality import CHUNK_KEY
from ..schemas import TICK
from ..sources import scans, sinks

DONE = ("COMPLETED", "EXPECTED_MARKET_CLOSED")


def pending_chunks(expected: DataFrame, ledger: DataFrame, retry_missing: bool = True) -> DataFrame:
    """Expected chunks whose last entry does not settle them; a chunk without history settles itself unless ``retry_missing``."""
    done = DONE if retry_missing else (*DONE, "NO_BROKER_HISTORY")
    settled = quality.latest_entries(ledger).where(F.col("status").isin(*done)).select(*CHUNK_KEY)
    return expected.join(settled, CHUNK_KEY, "left_anti")


def _beside(spark: SparkSession, path: str, todo: DataFrame, start_ms: int, step: int) -> DataFrame:
    """Ticks of the history that stand in a pending chunk's days and are of no pending chunk; none if chunks are whole days."""
    day = clock.day_number
    days = todo.select("symbol", F.explode(F.sequence(day(F.col("chunk_start_ms")), day(F.col("chunk_end_ms") - 1))).alias("day")).distinct()
    shared = spark.read.schema(T.StructType([*TICK.fields, T.StructField("day", T.LongType())])).parquet(path).join(days, ["symbol", "day"], "left_semi").select(*TICK.fieldNames())
    return quality.with_chunk(shared, start_ms, step).join(todo.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")


def advance_guard(spark: SparkSession, observations: DataFrame, path: str, change: float = 0.55, missing: float = 0.02, shadow: bool = True, **options) -> DataFrame:
    """Verdicts of the regime guard on the sound observations that it has not seen, from the snapshot in ``path`` on.

    Points and snapshots of a run are written together as one version, so a run that stops leaves the version before it; the next one takes up there.
    """
    sound = regime.quarantine(observations)[0].select("symbol", "ts_ms", "missing_ratio", *regime.OBSERVATION)
    written = spark.read.schema(f"{regime.STEP_SCHEMA}, version long")
    steps = written.parquet(path) if scans.exists(spark, path) else None
    version = (steps.agg(F.max("version")).first()[0] or 0) if steps is not None else 0
    columns = [c.split()[0] for c in regime.SNAPSHOT_SCHEMA.split(", ")]
    before = steps.where((F.col("version") == version) & F.col("last_ms").isNotNull()).select(*columns) if steps is not None else spark.createDataFrame([], regime.SNAPSHOT_SCHEMA)
    made = regime.resumed_points(sound, before, **options)
    made.withColumn("version", F.lit(version + 1)).write.mode("append").partitionBy("version").parquet(path)
    points = written.parquet(path).where((F.col("version") == version + 1) & F.col("last_ms").isNull())
    return regime.guard_verdicts(points.drop("version", "last_ms", *columns[2:]), change, missing, shadow)


def ingest(
    spark: SparkSession,
    ticks: DataFrame,
    expected: DataFrame,
    ledger: DataFrame,
    step: int,
    start_ms: int,
    data_path: str,
    ledger_path: str,
    verdict_path: str | None = None,
    source: str | None = None,
    calendar_snapshot_id: str | None = None,
    config_sha256: str | None = None,
    retry_missing: bool = True,
    record_missing: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Bring the pending chunks in: a verdict on each, then the data of the sound ones, then their entries. Returns the new entries.

    Every (symbol, chunk) is judged on its own, so a bad tick loses its chunk and no other. A refused chunk gets a verdict and no
    entry, and is pending again; ``strict`` makes it an error once the sound chunks are in. A chunk without ticks is entered as an
    expected closure if it lies wholly in the weekend, else as one without history (not ``record_missing``: refused as empty).

    Data replaces whole partitions of a symbol and day: a run that stopped between data and entries is made good by the next one and
    doubles no tick. Of the history only days that a pending chunk shares with a settled one are read. Entries carry the number of their run; readers take the last one of a chunk.
    """
    known = quality.latest_entries(ledger)
    run = (ledger.agg(F.max("run")).first()[0] or 0) + 1 if "run" in ledger.columns else 1
    todo = pending_chunks(expected, known, retry_missing)
    own = quality.with_chunk(ticks, start_ms, step).join(todo.select(*CHUNK_KEY), CHUNK_KEY, "left_semi").select(*TICK.fieldNames(), "chunk_start_ms")

    # verdicts are written down first: they decide twice, on the data and on the entries
    verdict_path = verdict_path or ledger_path.rstrip("/") + "-verdicts"
    attempt = uuid.uuid4().hex  # a run that stopped here may have left verdicts under the same number
    verdicts = quality.chunk_quality(own, todo).join(todo, CHUNK_KEY).withColumn("run", F.lit(run).cast("long")).withColumn("attempt", F.lit(attempt))
    verdicts.write.mode("append").parquet(verdict_path)
    verdicts = spark.read.schema(verdicts.schema).parquet(verdict_path).where(F.col("attempt") == attempt)
    good = quality.gate(own, verdicts, feed=CHUNK_KEY)
    sinks.replace_days(good.unionByName(_beside(spark, data_path, todo, start_ms, step)) if scans.exists(spark, data_path) else good, data_path)

    closed = clock.inside_weekend(F.col("chunk_start_ms"), F.col("chunk_end_ms"))
    empty = F.col("tick_count") == 0
    status = F.when(F.col("valid"), "COMPLETED").when(empty & closed, "EXPECTED_MARKET_CLOSED").when(empty & F.lit(record_missing), "NO_BROKER_HISTORY")
    said = {"source": source, "calendar_snapshot_id": calendar_snapshot_id, "config_sha256": config_sha256}
    judged = verdicts.withColumn("status", status).withColumns({k: F.lit(v).cast("string") for k, v in said.items()})
    sinks.append_lineage(judged.where("status IS NOT NULL"), ledger_path)
    if strict and (refused := judged.where("status IS NULL").orderBy(*CHUNK_KEY).first()):
        raise ValueError(f"chunk refused: {refused.symbol} {refused.chunk_start_ms}: {', '.join(refused.hard_failures)}")
    return scans.lineage_json(spark, ledger_path).where(F.col("run") == run)
