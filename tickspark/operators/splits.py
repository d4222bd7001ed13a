"""Chronological splits: purged walk-forward folds and the locked holdout, per symbol."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DAY
from .sequence import interval_join


def numbered(events: DataFrame) -> DataFrame:
    """Events (symbol, event_id, start_ms, label_end_ms) with ``idx``, their place in time."""
    w = Window.partitionBy("symbol").orderBy("start_ms", "event_id")
    return events.withColumn("idx", F.row_number().over(w) - 1)


def final_holdout(indexed: DataFrame, fraction: float = 0.2) -> DataFrame:
    """The last events of each symbol, a fraction of them and one at least; none of a symbol with two events or fewer."""
    sized = indexed.withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    k = F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    return sized.where((F.col("n") > 2) & (F.col("idx") >= F.col("n") - k)).drop("n")


def walk_forward_ranges(indexed: DataFrame, min_train: int, validation: int, embargo_ms: int, step: int | None = None, usual_ms: int = DAY) -> tuple[DataFrame, DataFrame]:
    """The folds (symbol, fold_id, lo, hi, valid_start_ms, n_train) and their purged events (symbol, fold_id, idx, event_id).

    Places ``lo`` to ``hi`` are validated; all places before ``lo`` train but the purged ones, whose labels end at or after the
    block's start less the embargo. Only events near a block's start can be purged, so nothing grows with events times folds; ``usual_ms`` is near the usual time from start to free.
    Folds with too few training events are left out, the others numbered in order.
    """
    step = step or validation
    size = indexed.groupBy("symbol").agg(F.count("*").alias("n"))
    first = F.explode(F.when(F.col("n") > min_train, F.sequence(F.lit(min_train).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>")))
    blocks = size.select("symbol", "n", first.alias("lo")).withColumn("hi", F.least(F.col("lo") + validation, F.col("n")) - 1)
    starts = indexed.select("symbol", F.col("idx").cast("long").alias("lo"), F.col("start_ms").alias("valid_start_ms"))
    blocks = blocks.join(starts, ["symbol", "lo"]).select("symbol", "lo", "hi", "valid_start_ms")
    # an event meets the blocks that start from its own start until its label and the embargo have ended
    spans = indexed.select("symbol", "idx", "event_id", "start_ms", (F.col("label_end_ms") + embargo_ms).alias("free_ms"))
    met = interval_join(spans, blocks.select("symbol", "lo", "valid_start_ms"), "start_ms", "free_ms", "valid_start_ms", usual_ms).where("idx < lo").select("symbol", "lo", "idx", "event_id")
    lost = met.groupBy("symbol", "lo").agg(F.count("*").alias("purged"))
    kept = blocks.join(lost, ["symbol", "lo"], "left").withColumn("n_train", F.col("lo") - F.coalesce("purged", F.lit(0))).where(F.col("n_train") >= min_train)
    folds = kept.withColumn("fold_id", F.row_number().over(Window.partitionBy("symbol").orderBy("lo")) - 1).select("symbol", "fold_id", "lo", "hi", "valid_start_ms", "n_train")
    return folds, met.join(folds.select("symbol", "lo", "fold_id"), ["symbol", "lo"]).select("symbol", "fold_id", "idx", "event_id")


def walk_forward(indexed: DataFrame, min_train: int, validation: int, embargo_ms: int, step: int | None = None, roles: tuple[str, ...] = ("TRAIN", "VALIDATION")) -> DataFrame:
    """Rows (symbol, fold_id, idx, event_id, role) of the folds of :func:`walk_forward_ranges`. Rows of TRAIN are as many as events times folds by their nature: leave the role out where ranges will do."""
    folds, purged = walk_forward_ranges(indexed, min_train, validation, embargo_ms, step)
    places = {"TRAIN": F.sequence(F.lit(0).cast("long"), F.col("lo") - 1), "VALIDATION": F.sequence(F.col("lo"), F.col("hi"))}
    listed = [folds.select("symbol", "fold_id", F.explode(places[role]).alias("idx"), F.lit(role).alias("role")) for role in roles]
    if "TRAIN" in roles:
        listed[roles.index("TRAIN")] = listed[roles.index("TRAIN")].join(purged, ["symbol", "fold_id", "idx"], "left_anti")
    rows = listed[0].unionByName(listed[1]) if len(listed) > 1 else listed[0]
    return rows.join(indexed.select("symbol", F.col("idx").cast("long").alias("idx"), "event_id"), ["symbol", "idx"]).select("symbol", "fold_id", "idx", "event_id", "role")
