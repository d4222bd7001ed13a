"""Sharding along a Hilbert curve (operator 10).

Size, language and source are quantised to a cube, a Hilbert curve runs
through it, and the rows sorted by their place on it are cut into runs of near
equal bytes. Rows of one shard are then close in every dimension, so the
minimum and maximum of a file prune on any of them. Codes of languages and
sources follow the order of their values: a value's code is the share of all
bytes that stand before its middle, so neighbours on an axis are neighbours in
order, heavy values lie far apart, and light ones share a code with those
beside them. Sizes go by their logarithm.

Law ``bytes``: a row goes to the shard in which its middle byte falls. Rows of
equal texts stand together (their place comes from the least source and
language among them), and a group of at most ``WHOLE`` of a shard's bytes goes
to one shard by the group's middle byte; larger groups are cut like other rows.

Defined results: a null text counts as empty; null languages and sources have a
place of their own; rows that share everything take neighbouring slots; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._common import buckets_for, materialize, text_or_empty

BITS, WHOLE, OVERHEAD = 6, 0.10, 16
_GROUP = ["text_hash", "size", "text_crc32"]


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points (n, dims) with coordinates under ``2**bits`` on the Hilbert curve of that order.

    Going down the bits, a coordinate's bit either inverts the lower bits of the first axis or swaps them with that
    axis; Gray decoding and interleaving the bits then give the place.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            on = (x[d] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = place << 1 | (x[d] >> b) & 1
    return place


@F.pandas_udf(LongType())
def _place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], axis=1)))


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """Metadata of each document; texts stay behind."""
    body = text_or_empty(F.col(text))
    return docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"),
    )


def codes(described: DataFrame, column: str) -> DataFrame:
    """Rows (__value, code) for each value of ``column`` (in a struct, so that null is a value like others, and the first): the code under ``2**BITS`` of its middle byte when all bytes are ordered by value.

    Running sums are by ranges of values, so there may be any number of them.
    """
    sums = described.groupBy(column).agg(F.sum("size").alias("b"))
    ranges = materialize(sums.repartitionByRange(buckets_for(sums.count()), column).withColumn("__part", F.spark_partition_id()), "shard-values")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.groupBy("__part").agg(F.sum("b").alias("b")).select("__part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__before"), F.sum("b").over(Window.partitionBy()).alias("__all"))
    inside = Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("__before") + F.sum("b").over(inside) - F.col("b") / 2
    return ranges.join(parts, "__part").select(F.struct(F.col(column).alias("v")).alias("__value"), F.floor(middle / F.col("__all") * (1 << BITS)).cast("long").alias("code"))


def assign_shards(described: DataFrame, shards: int = 40) -> DataFrame:
    """Add ``law``, ``shard``, ``slot`` and ``grown_shard`` to a written table of :func:`describe`."""
    top = (1 << BITS) - 1
    totals = described.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, total = totals["n"], max(totals["bytes"], 1)
    groups = described.groupBy(*_GROUP).agg(F.min(F.struct("source", "lang")).alias("__least"), F.count("*").alias("__copies"))
    log_size = F.least(F.floor(4 * F.log2(F.col("size") / OVERHEAD)), F.lit(top)).cast("long")
    for c in ("lang", "source"):
        groups = groups.withColumn("__value", F.struct(F.col(f"__least.{c}").alias("v"))).join(codes(described, c).withColumnRenamed("code", f"__{c}"), "__value").drop("__value")
    places = groups.select(*_GROUP, "__copies", _place(F.col("__lang"), F.col("__source"), log_size).alias("place"))
    keys = ["place", *_GROUP, "__tie", "doc_id"]
    rows = described.join(places, _GROUP).withColumn("__tie", F.xxhash64("doc_id"))
    ranges = materialize(rows.repartitionByRange(buckets_for(n, 20_000, 16), *keys).withColumn("__part", F.spark_partition_id()), "shard-ranges")

    # running bytes and rows: within a range, and of the ranges before it
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.groupBy("__part").agg(F.sum("size").alias("b"), F.count("*").alias("r")).select(
        "__part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("__rows")
    )
    inside = Window.partitionBy("__part").orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    ordered = ranges.withColumn("__to", F.sum("size").over(running)).withColumn("__k", F.row_number().over(inside)).join(shifts, "__part")
    ordered = materialize(
        ordered.select("doc_id", *_GROUP, "__copies", (F.col("__bytes") + F.col("__to") - F.col("size")).alias("__at"), (F.col("__rows") + F.col("__k") - 1).alias("__row")), "shard-order"
    )
    limit = WHOLE * total / shards
    small = F.col("__copies") * F.col("size") <= limit
    # a group that two or more rows share and that stays whole needs its first byte
    starts = ordered.where((F.col("__copies") > 1) & small).groupBy(*_GROUP).agg(F.min("__at").alias("__first"))
    single = ordered.where((F.col("__copies") == 1) | ~small).withColumn("__middle", 2 * F.col("__at") + F.col("size"))
    grouped = ordered.where((F.col("__copies") > 1) & small).join(starts, _GROUP).withColumn("__middle", 2 * F.col("__first") + F.col("__copies") * F.col("size")).drop("__first")
    cut = single.unionByName(grouped).withColumn("shard", F.least(F.floor(F.col("__middle") * shards / (2 * total)), F.lit(shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("__row").alias("__first"))  # a row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__row") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
