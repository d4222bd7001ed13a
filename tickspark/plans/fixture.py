"""Parameters and small dimensions of the registered queries. The ``events`` ticks are minutes apart, so widths and limits are scaled up from market ones."""

from __future__ import annotations

import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, candidates, labels, splits
from ..schemas import CALENDAR, COST, DAY, HOUR
from ..sources import scans

GAP_LIMIT, STRIDE, LOOKBACK, HORIZON = 2 * HOUR, 3, 12, 12
MIN_TRAIN, VALIDATION, EMBARGO = 20, 10, 12 * HOUR
#: January 2024.
START, END = 1_704_067_200_000, 1_704_067_200_000 + 31 * DAY
SAMPLES, BLOCK = 200, 5
#: Configuration of the family study, for its digest.
STUDY = f"lookback={LOOKBACK};stride={STRIDE};horizon={HORIZON};train={MIN_TRAIN};validation={VALIDATION};embargo={EMBARGO}"

#: (event_id, code, currency, hours after START, impact, as_of hours after START)
RELEASES = [
    ("r01", "US_NFP", "USD", 109.5, "HIGH", 0.0), ("r02", "EU_CPI", "EUR", 106.0, "HIGH", 0.0), ("r03", "US_CPI", "USD", 253.5, "HIGH", 0.0), ("r04", "EU_PMI", "EUR", 561.0, "MEDIUM", 0.0),
    ("r05", "ECB_RATE", "EUR", 589.25, "HIGH", 0.0), ("r06", "US_GDP", "USD", 589.5, "HIGH", 0.0), ("r07", "US_PCE", "USD", 613.5, "HIGH", 0.0), ("r08", "FOMC", "USD", 735.0, "HIGH", 900.0),
    ("r09", "US_RETAIL", "USD", 397.5, "LOW", 0.0), ("r10", "EU_SENTIMENT", "EUR", 370.0, "HIGH", 0.0), ("r11", "US_CLAIMS", "USD", 445.5, "MEDIUM", 0.0), ("r12", "EU_TRADE", "EUR", 300.0, "HIGH", 200.0),
]
#: (session, regime, direction, entry, exit, latency, commission, stop, rollover, event)
COSTS = [
    ("ASIA", "BULL", "LONG", 0.3, 0.4, 120.0, 0.01, 0.5, 0.002, 0.6), ("ASIA", "BEAR", "SHORT", 0.35, 0.45, 120.0, 0.01, 0.6, 0.002, 0.7), ("LONDON", "BULL", "LONG", 0.1, 0.2, 60.0, 0.005, 0.2, 0.001, 0.3),
    ("LONDON", "BULL", "SHORT", 0.15, 0.2, 60.0, 0.005, 0.25, 0.001, 0.3), ("LONDON", "BEAR", "SHORT", 0.12, 0.22, 60.0, 0.005, 0.3, 0.001, 0.35), ("NY", "BULL", "LONG", 0.12, 0.25, 80.0, 0.006, 0.3, 0.001, 0.4),
    ("NY", "BEAR", "LONG", 0.18, 0.28, 80.0, 0.006, 0.35, 0.0015, 0.4), ("NY", "BEAR", "SHORT", 0.2, 0.3, 80.0, 0.006, 0.4, 0.0015, 0.45),
]


def calendar(spark: SparkSession) -> DataFrame:
    rows = [(f"s{int(a)}", START + int(a * HOUR), "fixture", i, code, code, cur, START + int(h * HOUR), impact) for i, code, cur, h, impact, a in RELEASES]
    return spark.createDataFrame(rows, CALENDAR)


def cost_buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COSTS, COST)


def calendar_sql() -> str:
    rows = ", ".join(f"('{i}', '{code}', '{cur}', {START + int(h * HOUR)}::BIGINT, '{impact}', {START + int(a * HOUR)}::BIGINT)" for i, code, cur, h, impact, a in RELEASES)
    return f"calendar AS (SELECT * FROM (VALUES {rows}) v(event_id, event_code, currency, scheduled_ms, impact, as_of_ms))"


def costs_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in COSTS)
    return f"costs AS (SELECT * FROM (VALUES {rows}) v(session, regime, direction, entry_slip, exit_slip, latency_ms, commission_r, stop_slip, rollover_r, event_slip))"


_SHARED: dict[tuple, DataFrame] = {}


def _scratch(spark: SparkSession) -> str:
    """Folder that the driver and all executors see; a local master gets one of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def shared(f):
    """Write down a stage that many queries start from, once for the session and folder.

    A written table cuts the plan: queries over stages over stages would else carry, and print, the plans of all of them many times over.
    """

    @wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f.__name__)
        if key not in _SHARED:
            made = f(spark, sf_dir)
            path = new_folder(spark, f.__name__)
            made.write.parquet(path)
            _SHARED[key] = spark.read.schema(made.schema).parquet(path)
        return _SHARED[key]

    return get


def forget() -> None:
    """Delete the shared stages, so that the next query writes its own anew."""
    for table in _SHARED.values():
        context = table.sparkSession.sparkContext
        if context._jsc is None:  # a session that has ended
            continue
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _SHARED.clear()


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.event_ticks(spark, sf_dir)


@shared
def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.rollup_bars(bars.with_gaps(ticks(spark, sf_dir), GAP_LIMIT))


@shared
def ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.generate(all_bars(spark, sf_dir), lookback=LOOKBACK, stride=STRIDE)


@shared
def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ideas(spark, sf_dir).select("symbol", F.col("candidate_id").alias("event_id"), F.col("available_ms").alias("start_ms"), (F.col("available_ms") + HORIZON * HOUR).alias("label_end_ms"))
    return splits.numbered(made)


@shared
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = all_bars(spark, sf_dir).where("timeframe = 'BASE'")
    return labels.bar_outcomes(ideas(spark, sf_dir), base, cost_buckets(spark), HORIZON)
