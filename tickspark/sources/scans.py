"""Scans with fixed schemas. Nothing is inferred, and a bad cell is an error or a reported row, never a silent null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.bars import usable
from ..operators.labels import GEOMETRY
from ..schemas import CALENDAR, CANDIDATE, DAY, LEDGER, LINEAGE, TICK, _struct

_CALENDAR_TOP = ("snapshot_id", "as_of", "source", "events")
_CALENDAR_EVENT = ("event_id", "event_code", "name", "currency", "scheduled_at", "impact", "source")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote ticks from the ``events`` table: the event type is the symbol, the id the place in the feed, the value a bid near one, and ``k`` of the properties sets spread and flags."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    pips = F.when(k < 5, 0.0).when(k == 99, 6.0).otherwise(0.2 + 0.02 * k)
    bid = 1 + F.col("value") / 10000
    flags = (k % 2) * 2 + (F.floor(k / 2) % 2) * 4
    return events.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"), bid.alias("bid"), (bid + 0.0001 * pips).alias("ask"), flags.cast("int").alias("flags"))


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The column orders met in the files of ``path``, with their files; only the first line of each file is kept."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("at", "i")).alias("head"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.collect():
        names = tuple(c.strip().strip('"') for c in r.head.lstrip("\ufeff").split(","))
        out.setdefault(names, []).append(r.file)
    return out


def csv_ticks(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Ticks of one symbol from CSV with a header: time_ms, bid and ask in any order among other columns, flags optional (0). A byte-order mark is fine, a missing column an error, and so is a bad cell, which is told with its file, line and column.

    Files may differ in the order of their columns. ``seq`` is the place in the feed: by file name, then by place in the file. The header is line 1; blank lines count neither as rows nor as lines.
    """
    kinds = {"time_ms": "long", "bid": "double", "ask": "double", "flags": "int"}
    parts = []
    for names, files in csv_headers(spark, path).items():
        missing = {"time_ms", "bid", "ask"} - set(names)
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        rows = spark.read.schema(_struct(" ".join(f"{n}:string" for n in names))).option("header", True).option("enforceSchema", True).csv(files)
        flags = F.col("flags") if "flags" in names else F.lit(None).cast("string")
        parts.append(rows.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__i"), "time_ms", "bid", "ask", F.coalesce(F.nullif(flags, F.lit("")), F.lit("0")).alias("flags")))
    if not parts:
        raise ValueError(f"no rows in {path}")
    rows = reduce(DataFrame.unionByName, parts)
    # rows of a block are numbered in a row; blocks are few and shifted by the rows before them
    blocks = rows.groupBy("__file", "__at").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda w: F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first")
    in_file = Window.partitionBy("__file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("__file", "__at", earlier(before).alias("__shift"), earlier(in_file).alias("__lines"))
    placed = rows.join(shifts, ["__file", "__at"])
    value = {n: F.col(n).try_cast(kind) for n, kind in kinds.items()}
    bad = F.concat_ws(", ", *(F.when(v.isNull(), F.concat(F.lit(f"{n} = "), F.coalesce(n, F.lit("")))) for n, v in value.items()))
    told = F.concat(F.lit("bad cell in "), "__file", F.lit(" line "), F.col("__i") + F.col("__lines") + 2, F.lit(": "), bad)
    checked = placed.where(F.when(bad == "", True).otherwise(F.raise_error(told).cast("boolean")))
    return checked.select(F.lit(symbol).alias("symbol"), (F.col("__i") + F.col("__shift")).alias("seq"), *(v.alias(n) for n, v in value.items()))


def csv_bad_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows that :func:`csv_ticks` would refuse: what could be read of them, and ``bad_line`` as it stands in the file."""
    kinds = {"time_ms": "long", "bid": "double", "ask": "double", "flags": "int"}
    schema = _struct(" ".join(f"{n}:{kinds.get(n, 'string')}" for n in names) + " bad_line:string")
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").csv(path).where("bad_line IS NOT NULL")


def parquet_ticks(spark: SparkSession, path: str, symbols: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Ticks of a written history (partitioned by symbol and day), pruned by partition and pushed down by time."""
    df = spark.read.parquet(path)
    wanted = set(TICK.fieldNames())
    if wanted - set(df.columns):
        raise ValueError(f"columns missing: {sorted(wanted - set(df.columns))}")
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if start_ms is not None:
        df = df.where((F.col("day") >= start_ms // DAY) & (F.col("time_ms") >= start_ms))
    if end_ms is not None:
        df = df.where((F.col("day") <= (end_ms - 1) // DAY) & (F.col("time_ms") < end_ms))
    return df.select(*TICK.fieldNames())


def bar_dataset(spark: SparkSession, path: str, symbol: str, timeframes: tuple[str, ...], start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Bars of a symbol in a half-open time range; an error if a timeframe is missing or nothing of the first one is left."""
    df = spark.read.parquet(path).where(F.col("symbol") == symbol)
    have = {r[0] for r in df.select("timeframe").distinct().collect()}
    if set(timeframes) - have:
        raise ValueError(f"timeframes missing: {sorted(set(timeframes) - have)}")
    if start_ms is not None:
        df = df.where(F.col("bar_start_ms") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("bar_start_ms") < end_ms)
    if df.where(F.col("timeframe") == timeframes[0]).limit(1).count() == 0:
        raise ValueError("no bars selected")
    return df


def candidates_json(spark: SparkSession, path: str) -> DataFrame:
    """Trade ideas from JSON lines, with defaults for holding time (90 minutes), risk, pair and timeframe."""
    df = spark.read.schema(CANDIDATE).option("mode", "FAILFAST").json(path)
    defaults = {"max_holding_ms": 90 * 60_000, "risk_fraction": 0.005, "pair": "EUR_USD", "timeframe": "BASE"}
    return df.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in CANDIDATE.fieldNames()))


def _iso_ms(c: Column) -> Column:
    return F.unix_millis(F.to_timestamp(c))


def calendar_json(spark: SparkSession, path: str) -> DataFrame:
    """Release calendar snapshots, one JSON object per file. Unknown fields, empty required ones, unknown impacts or an unsorted list are errors; an event's source is the snapshot's unless it has one."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    events = F.from_json(F.get_json_object("value", "$.events"), "array<string>")
    top = raw.select("file", F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, _CALENDAR_TOP))).alias("odd"), F.get_json_object("value", "$.snapshot_id").alias("snapshot_id"), _iso_ms(F.get_json_object("value", "$.as_of")).alias("as_of_ms"), F.get_json_object("value", "$.source").alias("top_source"), F.posexplode(events).alias("pos", "event"))
    odd = F.concat("odd", F.array_except(F.json_object_keys("event"), F.array(*map(F.lit, _CALENDAR_EVENT))))
    field = lambda n: F.get_json_object("event", f"$.{n}")
    rows = top.select("file", "pos", odd.alias("odd"), "snapshot_id", "as_of_ms", F.coalesce(field("source"), F.col("top_source")).alias("source"), field("event_id").alias("event_id"), field("event_code").alias("event_code"), field("name").alias("name"), field("currency").alias("currency"), _iso_ms(field("scheduled_at")).alias("scheduled_ms"), field("impact").alias("impact"))
    before = F.lag("scheduled_ms").over(Window.partitionBy("file").orderBy("pos"))
    fault = F.concat_ws(
        "; ", F.when(F.size("odd") > 0, F.concat(F.lit("unknown fields "), F.array_join("odd", ","))), F.when(~F.col("impact").isin("LOW", "MEDIUM", "HIGH"), "unknown impact"), F.when(before > F.col("scheduled_ms"), "events out of order"),
        *(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"empty {c}") for c in ("snapshot_id", "as_of_ms", "source", "event_id", "event_code", "name", "currency", "scheduled_ms", "impact")),
    )
    checked = rows.withColumn("fault", fault)
    return checked.where(F.when(F.col("fault") != "", F.raise_error(F.concat(F.lit("calendar refused: "), "fault")).cast("boolean")).otherwise(True)).select(*CALENDAR.fieldNames())


def ledger_json(spark: SparkSession, path: str) -> DataFrame:
    """Lineage entries; a line that is no JSON gives a row of nulls, which covers nothing."""
    return spark.read.schema(LEDGER).option("mode", "PERMISSIVE").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever store it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def lineage_json(spark: SparkSession, path: str) -> DataFrame:
    """All entries of all runs that an ingest has made, with their lineage; none if nothing was ever entered."""
    if not exists(spark, path):
        return spark.createDataFrame([], LINEAGE)
    return spark.read.schema(LINEAGE).option("mode", "PERMISSIVE").json(path).where("symbol IS NOT NULL")


def signed_json(spark: SparkSession, path: str, schema: str | StructType, name: str = "report_sha256") -> DataFrame:
    """Rows written with a digest of their own, and ``intact``: whether it is that of the text beside it."""
    lines = spark.read.text(path)
    bare = F.regexp_replace("value", f',"{name}":"[0-9a-f]{{64}}"\\}}$', "}")
    given = F.get_json_object("value", f"$.{name}")
    return lines.select(F.from_json("value", schema).alias("row"), F.coalesce(F.sha2(bare, 256) == given, F.lit(False)).alias("intact")).select("row.*", "intact")


def baseline_results(spark: SparkSession, path: str, policy: str = "FIXED_RR", scenario: str = "BASELINE_1X") -> DataFrame:
    """Result rows of one policy and scenario; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where((F.col("policy") == policy) & (F.col("scenario") == scenario))


def family_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Rows (family, policy, scenario, metric values) from a JSON object of families that hold a map ``policy:scenario`` to metrics."""
    raw = spark.read.option("wholetext", True).text(path)
    metrics = "map<string,map<string,double>>"
    families = raw.select(F.explode(F.from_json("value", f"map<string,struct<metrics:{metrics}>>")).alias("family", "body"))
    rows = families.select("family", F.explode("body.metrics").alias("key", "values"))
    parts = F.split("key", ":", 2)
    return rows.select("family", parts[0].alias("policy"), parts[1].alias("scenario"), "values")


def failure_analysis(spark: SparkSession, path: str) -> DataFrame:
    """A written failure analysis: a row per family with slices, correlations and geometry."""
    hits = ", ".join(f"hit_{str(t).replace('.', '_')}r: double" for t in GEOMETRY)
    slices = "array<struct<dimension: string, value: string, n: long, gross_ev_r: double, net_ev_r: double, win_rate: double>>"
    return spark.read.schema(f"family string, oos_trades long, slices {slices}, correlations map<string,double>, geometry struct<paths: long, {hits}, ambiguity_rate: double>").json(f"{path}/failure_analysis")


def bar_files(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """A row per Parquet file of a bar history (of ``files`` only, if given): symbol, timeframe, file, bytes, time of change, rows, unusable ones, and the range of time."""
    bars = spark.read.option("basePath", path).parquet(*(files or [path]))
    meta = F.col("_metadata")
    own = bars.select("symbol", "timeframe", meta["file_path"].alias("file"), meta["file_size"].alias("bytes"), F.unix_millis(meta["file_modification_time"]).alias("changed_ms"), "bar_start_ms", "bar_end_ms", usable().alias("usable"))
    return own.groupBy("symbol", "timeframe", "file", "bytes", "changed_ms").agg(F.count("*").alias("rows"), F.count_if(~F.col("usable")).alias("unusable"), F.min("bar_start_ms").alias("start_ms"), F.max("bar_end_ms").alias("end_ms"))


def best_family(summaries: DataFrame, metric: str = "net_expectancy_r") -> DataFrame:
    return summaries.withColumn("score", F.col("values")[metric]).orderBy(F.desc_nulls_last("score"), "family").limit(1)
