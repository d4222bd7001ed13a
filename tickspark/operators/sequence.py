"""Order along a feed: previous ticks, row numbers and as-of matches without one task per symbol."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ticks of one symbol that a task orders at a time.
CHUNK = 500_000


def with_previous(ticks: DataFrame, columns: list[str], chunk: int = CHUNK, prefix: str = "prev_", ahead: bool = False, feed: list[str] = ["symbol"]) -> DataFrame:
    """Add the previous tick's ``columns`` (``ahead``: the next one's) in feed order, per symbol or whatever names a ``feed``.

    A busy feed is cut into runs of ``chunk`` places; the tick at the edge of a run looks up the nearest tick of the
    run beside it, from a table with one row per run.
    """
    beside, nearest = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    runs = ticks.withColumn("__run", F.floor(F.col("seq") / chunk).cast("long"))
    per_run = runs.groupBy(*feed, "__run").agg(nearest(F.struct(*columns), "seq").alias("__near"))
    edges = per_run.select(*feed, "__run", beside("__near").over(Window.partitionBy(*feed).orderBy("__run")).alias("__edge"))
    inside = Window.partitionBy(*feed, "__run").orderBy("seq")
    joined = runs.withColumn("__beside", beside(F.struct(*columns)).over(inside)).join(edges, [*feed, "__run"])
    found = F.coalesce("__beside", "__edge")
    return joined.select(*ticks.columns, *(found[c].alias(prefix + c) for c in columns))


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, keep: list[str], backward: bool = True, bucket_ms: int | None = None, order: str | None = None) -> DataFrame:
    """Add ``value``: the struct ``keep`` of the last ``right`` row at or before (``backward``) or the first at or after each left row, per symbol.

    Rows of both sides are merged in time order; ties in time go by ``order``. With ``bucket_ms`` a symbol is cut into time buckets and
    a row that finds nothing in its own bucket takes the edge of the nearest filled bucket, so a busy symbol is shared by many tasks.
    """
    names = left.columns
    tie = F.col(order) if order else F.lit(0).cast("long")
    # equal times match: right rows stand before left rows looking back, after them looking ahead
    a = left.select("symbol", F.col(left_time).alias("__t"), F.lit(1 if backward else 0).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*names).alias("__row"), F.lit(None).cast(right.select(F.struct(*keep)).schema[0].dataType).alias("__value"))
    b = right.select("symbol", F.col(right_time).alias("__t"), F.lit(0 if backward else 1).alias("__side"), tie.cast("long").alias("__tie"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"), F.struct(*keep).alias("__value"))
    both = a.unionByName(b)
    keys = ["symbol"]
    if bucket_ms:
        both = both.withColumn("__bucket", F.floor(F.col("__t") / bucket_ms).cast("long"))
        keys.append("__bucket")
    # looking ahead is looking back along the reversed order: a frame that only grows is kept up row by row, one that only shrinks is read anew for each row
    order_by = [F.col(c) if backward else F.col(c).desc() for c in ("__t", "__side", "__tie")]
    along = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__value", ignorenulls=True).over(along)
    out = both.withColumn("__found", found)
    if bucket_ms:
        # the edge of each filled bucket serves the empty stretch beside it, listed bucket by bucket; beyond the outermost one it serves all
        pick = F.max_by if backward else F.min_by
        filled = right.select("symbol", F.floor(F.col(right_time) / bucket_ms).cast("long").alias("__bucket"), F.struct(F.col(right_time).alias("t"), tie.cast("long").alias("o")).alias("__at"), F.struct(*keep).alias("__v"))
        filled = filled.groupBy("symbol", "__bucket").agg(pick("__v", "__at").alias("__edge"))
        order_b = Window.partitionBy("symbol").orderBy("__bucket")
        beside = F.lead("__bucket").over(order_b) if backward else F.lag("__bucket").over(order_b)
        filled = filled.withColumn("__beside", beside)
        stretch = F.sequence(F.col("__bucket") + 1, F.col("__beside")) if backward else F.sequence(F.col("__beside"), F.col("__bucket") - 1)
        near = filled.where("__beside IS NOT NULL").select("symbol", F.explode(stretch).alias("__bucket"), "__edge")
        outer = filled.where("__beside IS NULL").select("symbol", F.col("__bucket").alias("__last"), F.col("__edge").alias("__outer"))
        beyond = F.col("__bucket") > F.col("__last") if backward else F.col("__bucket") < F.col("__last")
        out = out.where("__row IS NOT NULL").join(near, keys, "left").join(outer, "symbol", "left").withColumn("__found", F.coalesce("__found", "__edge", F.when(beyond, F.col("__outer"))))
    return out.where("__row IS NOT NULL").select("__row.*", F.col("__found").alias(value))


#: Cells that an interval is listed under at most, but for one; wider ones are listed under wider cells.
CELLS = 8


def interval_join(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, bucket: int, length: Column | int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Rows of ``intervals`` with each ``points`` row of the symbol that has start <= at <= end.

    Both sides are listed under cells, so that the match is an equi-join with a residual range. Cells have the widths ``bucket`` times
    a power of two; an interval takes the narrowest one that ``CELLS`` of cover it, so it is listed ``CELLS`` + 1 times at most however
    long it is, and a point once for each width in use. ``length`` says how long an interval is at most (by default just as long), a
    number if all are alike; ``sizes`` is a smaller table with the same lengths, from which the widths in use are taken.
    """
    span = F.col(end) - F.col(start) if length is None else F.lit(length) if isinstance(length, int) else length
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(1)).cast("double") / (bucket * CELLS)))).cast("int")
    cell = lambda c: F.floor(c / (bucket * F.pow(F.lit(2.0), F.col("__level")))).cast("long")
    listed = intervals.withColumn("__level", level)
    spread = listed.withColumn("__cell", F.explode(F.when(F.col(end) >= F.col(start), F.sequence(cell(F.col(start)), cell(F.col(end)))).otherwise(F.array().cast("array<long>"))))
    if isinstance(length, int):
        at_levels = points.withColumn("__level", level)
    else:  # at most one width for each power of two
        at_levels = points.crossJoin(F.broadcast((intervals if sizes is None else sizes).select(level.alias("__level")).distinct()))
    right = at_levels.withColumn("__cell", cell(F.col(at))).withColumnRenamed("symbol", "__symbol").withColumnRenamed("__level", "__level_of")
    match = (F.col("symbol") == F.col("__symbol")) & (F.col("__level") == F.col("__level_of")) & (spread["__cell"] == right["__cell"]) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    return spread.join(right, match).drop("__cell", "__symbol", "__level", "__level_of")


def run_lengths(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Rows (keys, run, length) for every unbroken run of rows with ``flag``, by the difference of two row numbers."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__flag", flag)
    numbered = marked.withColumn("__i", F.row_number().over(w)).withColumn("__run", F.col("__i") - F.sum(F.col("__flag").cast("int")).over(w))
    return numbered.where("__flag").groupBy(*keys, F.col("__run").alias("run")).agg(F.count("*").alias("length"))
