"""Exact order statistics and percentiles of any number of values per key.

A first pass sketches each key's distribution and takes a narrow bracket around every wanted place. The ends of the brackets cut
the line into buckets (an end is a bucket of its own, as many rows may be equal to it); exact counts of the buckets tell in which
one a place lies and how many values stand before it, and only the values of such buckets are ranked. Counts decide, so results do
not depend on how well the sketch did: a poor bracket only makes a bucket larger. Equal values are counted before anything else,
and with ``ACCURACY`` of 10,000 a bracket holds some 0.06 % of a key's rows: no buffer, sort or window holds a key's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def order_statistics(rows: DataFrame, keys: list[str], value: str, shares: list[float], places: Column | None = None) -> DataFrame:
    """Rows (keys, place, size, value): for each key the values at ``places``, an array of places from 0 that may use the column ``size`` (how many values there are).

    ``shares`` says about where on the line from 0 to 1 the places lie; without ``places`` they are those just below and above the shares.
    Null values do not count, null keys are a key of their own, NaN stands above infinity. Without ``keys`` all rows are one key.
    """
    if places is None:
        at = [(F.col("size") - 1) * F.lit(float(q)) for q in shares]
        places = F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in at)))
    names = [f"__k{i}" for i in range(len(keys))] or ["__k"]
    of = [F.struct(F.col(k)) for k in keys] or [F.struct(F.lit(0))]  # a struct is never null, so that null keys join
    own = rows.where(F.col(value).isNotNull()).select(*(c.alias(n) for c, n in zip(of, names)), F.col(value).cast("double").alias("__v"))
    around = sorted({min(1.0, max(0.0, q + d)) for q in shares for d in (-2 / ACCURACY, 2 / ACCURACY)})
    finite = F.when(~F.isnan("__v") & (F.abs("__v") < float("inf")), F.col("__v"))
    ends = own.groupBy(*names).agg(F.count("*").alias("size"), F.coalesce(F.percentile_approx(finite, around, ACCURACY), F.array().cast("array<double>")).alias("__ends"))

    count_of = lambda test: F.size(F.filter("__ends", test))
    bucket = count_of(lambda x: x < F.col("__v")) + count_of(lambda x: x <= F.col("__v"))
    counted = own.groupBy(*names, "__v").agg(F.count("*").alias("__n"))
    # buckets are ranges of values, two for each end and one; from here on their least and greatest value stand for them
    buckets = counted.join(ends, names).groupBy(*names, bucket.alias("__b")).agg(F.sum("__n").alias("__in"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.first("size").alias("size"))
    reach = buckets.withColumn("__to", F.sum("__in").over(Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
    here = F.array_sort(F.array_distinct(F.filter(places, lambda k: (k < F.col("__to")) & (k >= F.col("__to") - F.col("__in")))))
    wanted = reach.withColumn("__places", here).where(F.size("__places") > 0).select(*names, "__low", "__high", "size", (F.col("__to") - F.col("__in")).alias("__before"), "__places")
    few = counted.join(wanted, names).where("__v BETWEEN __low AND __high")
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*names, "__low").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = few.withColumn("__upto", upto).withColumn("__hit", F.filter("__places", lambda k: (k < F.col("__upto")) & (k >= F.col("__upto") - F.col("__n"))))
    found = ranked.select(*names, F.explode("__hit").alias("place"), "size", F.col("__v").alias("value"))
    return found.select(*(F.col(n)[k].alias(k) for n, k in zip(names, keys)), "place", "size", "value")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per key that has values, with named percentiles by linear interpolation, and their number as ``n``."""
    at = {name: (F.col("size") - 1) * F.lit(float(q)) for name, q in shares.items()}
    found = order_statistics(rows, keys, value, list(shares.values()))
    of = lambda place: F.max(F.when(F.col("place") == place, F.col("value")))
    out = []
    for name, p in at.items():
        low, high, part = of(F.floor(p)), of(F.ceil(p)), F.max(p - F.floor(p))
        out.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    return found.groupBy(*keys).agg(*out, F.max("size").alias("n"))


def medians(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Rows (keys, feature, median, n) of several columns at once; nulls do not count."""
    long = rows.select(*keys, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(keys, features, "feature", "__x")
    return percentiles(long, [*keys, "feature"], "__x", {"median": 0.5})


def median_deviations(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Rows (keys, feature, median, mad, n): the median and the median distance from it. Keys must not be null."""
    middle = medians(rows, keys, features).cache()  # few rows, and exact: computed anew after a loss they are the same
    long = rows.select(*keys, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(keys, features, "feature", "__x").where("__x IS NOT NULL")
    away = long.join(middle.select(*keys, "feature", "median"), [*keys, "feature"]).select(*keys, "feature", F.abs(F.col("__x") - F.col("median")).alias("__d"))
    return middle.join(percentiles(away, [*keys, "feature"], "__d", {"mad": 0.5}).drop("n"), [*keys, "feature"])
