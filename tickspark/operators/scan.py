"""Running sums, peaks, drawdowns and losing runs of a long series, by segments whose summaries merge.

A series is cut into segments of time. Within a segment plain windows do; a segment's summary (length, sum, greatest and least
prefix, greatest drop from an earlier prefix, losing runs at its ends and inside) merges with the one before it, so what a segment
starts from follows from a table with a row per segment. No window holds a whole series, and a key with most of the rows is shared
by as many tasks as it has segments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Add what a row knows of its own segment: ``__seg``, place ``__i`` (from 1), running ``__sum``, its running greatest ``__max``, ``__lost`` and the number ``__kept`` of values so far that are no loss.

    ``order`` starts with a time in the unit of ``width``; rows whose time is null are a segment before all others.
    """
    seg = F.coalesce(F.floor(F.col(order[0]) / width).cast("long"), F.lit(-(1 << 62)))
    w = Window.partitionBy(*keys, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("__seg", seg).withColumn("__lost", F.coalesce((F.col(value) < 0).cast("long"), F.lit(0).cast("long")))
    own = own.withColumn("__sum", F.sum(value).over(w)).withColumn("__i", F.count("*").over(w)).withColumn("__kept", F.count("*").over(w) - F.sum("__lost").over(w))
    return own.withColumn("__max", F.max("__sum").over(w))


def summaries(local: DataFrame, keys: list[str], more: dict[str, tuple[Column, Callable[[str], Column]]] = {}) -> DataFrame:
    """A row per key and segment of :func:`local_sums`, by way of a row per run of losses. ``more`` adds columns: what is made of a run's rows, and how those of a segment's runs are put together."""
    at = [*keys, "__seg"]
    runs = local.groupBy(*at, "__kept").agg(
        F.count("*").alias("__n"), F.sum("__lost").alias("__run"), F.max("__i").alias("__last"), F.max_by("__sum", "__i").alias("__s"), F.max("__max").alias("__high"), F.min("__sum").alias("__low"),
        F.max(F.col("__max") - F.col("__sum")).alias("__drop"), *(c.alias(name) for name, (c, _) in more.items()),
    )
    return runs.groupBy(*at).agg(
        F.sum("__n").alias("__n"), F.max_by("__s", "__last").alias("__s"), F.max("__high").alias("__high"), F.min("__low").alias("__low"), F.max("__drop").alias("__drop"),
        F.max("__run").alias("__inside"), F.coalesce(F.max(F.when(F.col("__kept") == 0, F.col("__run"))), F.lit(0)).alias("__lead"), F.max_by("__run", "__kept").alias("__tail"), F.max("__kept").alias("__wins"),
        *(merge(name).alias(name) for name, (_, merge) in more.items()),
    )


def carried(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add what comes into each segment and what follows for it: ``__base`` (sum before it, null without values), ``__before`` (rows before it), ``__top`` (greatest equity before it, at least 0), ``__drawdown`` and ``__longest`` losing run that ends in it."""
    w = Window.partitionBy(*keys).orderBy("__seg")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("__base", F.sum("__s").over(earlier)).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    base = F.coalesce("__base", F.lit(0.0))
    out = out.withColumn("__reach", base + F.col("__high")).withColumn("__top", F.greatest(F.lit(0.0), F.max("__reach").over(earlier)))
    out = out.withColumn("__drawdown", F.greatest(F.col("__drop"), F.col("__top") - base - F.col("__low")))
    # losses that run into a segment: those at the end of the last segment with a value that is none, and all since
    mark = F.when(F.col("__wins") > 0, F.struct((F.col("__before") + F.col("__n") - F.col("__tail")).alias("upto")))
    since = F.last(mark, ignorenulls=True).over(earlier)["upto"]
    into = F.col("__before") - F.coalesce(since, F.lit(0))
    return out.withColumn("__longest", F.greatest(F.col("__inside"), into + F.col("__lead"))).drop("__reach")


def attach(local: DataFrame, parts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of :func:`local_sums` with ``columns`` of their segment; null keys are equal to each other."""
    names = {k: f"__p{i}" for i, k in enumerate([*keys, "__seg"])}
    right = parts.select(*(F.col(k).alias(n) for k, n in names.items()), *columns)
    match = F.lit(True)
    for k, n in names.items():
        match = match & F.col(k).eqNullSafe(F.col(n))
    return local.join(right, match).drop(*names.values())
