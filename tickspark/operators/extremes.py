"""First touches by an index of extremes: least and greatest quotes of cells of time, level by level.

A candidate's time from entry to barrier is covered by few cells of several widths. The index tells which of them hold a quote
beyond a barrier; the earliest one is opened into its parts, and the earliest of these again, down to the narrowest cells. Only the
ticks of that cell, and those of the two cells that entry and barrier cut, are read: rows joined grow with the candidates and not
with how long they are held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prices

#: Parts of a cell, and levels of cells.
FAN, LEVELS = 8, 4


def index(ticks: DataFrame, width: int) -> DataFrame:
    """Rows (symbol, level, cell, low_bid, high_bid, low_ask, high_ask, least_seq) for all cells with ticks; those of level 0 are ``width`` wide, those above ``FAN`` times as wide as the ones below."""
    cell = F.floor(F.col("time_ms") / width).cast("long")
    own = ticks.groupBy("symbol", cell.alias("cell")).agg(F.min("bid").alias("low_bid"), F.max("bid").alias("high_bid"), F.min("ask").alias("low_ask"), F.max("ask").alias("high_ask"), F.min("seq").alias("least_seq"))
    up = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("cell") / FAN**k).cast("long").alias("at")) for k in range(LEVELS))))
    wide = own.withColumn("u", up).groupBy("symbol", F.col("u.level").alias("level"), F.col("u.at").alias("cell"))
    return wide.agg(F.min("low_bid").alias("low_bid"), F.max("high_bid").alias("high_bid"), F.min("low_ask").alias("low_ask"), F.max("high_ask").alias("high_ask"), F.min("least_seq").alias("least_seq"))


def cover(first: Column, end: Column) -> Column:
    """Array of (level, cell): the cells of level 0 from ``first`` up to ``end`` (exclusive), with whole wider cells in their place."""
    parts, lo, hi, going = [], first, end, F.lit(True)
    run = lambda k, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda c: F.struct(F.lit(k).alias("level"), c.alias("cell")))).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))
    none = F.array().cast("array<struct<level:int,cell:bigint>>")
    for k in range(LEVELS):
        up, down = F.ceil(lo / FAN).cast("long"), F.floor(hi / FAN).cast("long")
        wider = (up < down) if k < LEVELS - 1 else F.lit(False)
        parts.append(F.when(going, F.when(wider, F.concat(run(k, lo, up * FAN), run(k, down * FAN, hi))).otherwise(run(k, lo, hi))).otherwise(none))
        lo, hi, going = up, down, going & wider
    return F.concat(*parts)


def touched() -> Column:
    """Whether a cell of the index holds a quote at or beyond one of the barriers."""
    at_bid = (F.col("high_bid") >= F.col("take_profit")) | (F.col("low_bid") <= F.col("stop_loss"))
    at_ask = (F.col("low_ask") <= F.col("take_profit")) | (F.col("high_ask") >= F.col("stop_loss"))
    return F.when(prices.is_long(), at_bid).otherwise(at_ask)


def _earliest(listed: DataFrame, cells: DataFrame, ident: list[str]) -> DataFrame:
    """Of the listed cells (level, cell) of each candidate the first one that is touched."""
    met = listed.join(cells, ["symbol", "level", "cell"]).where(touched())
    begins = F.col("cell") * F.pow(F.lit(float(FAN)), F.col("level"))
    return met.groupBy(*ident).agg(F.min_by(F.struct("level", "cell", "least_seq"), begins).alias("c")).select(*ident, "c.*")


def touching_ticks(live: DataFrame, ticks: DataFrame, width: int) -> DataFrame:
    """Rows of ``live`` with the ticks after entry that can decide them: those of the cells that entry and barrier lie in, and of the first whole cell between with a touch.

    ``live`` has candidate_id, symbol, direction, stop_loss, take_profit, entry_ms, entry_seq and barrier_ms; ``ticks`` has symbol, seq,
    time_ms, bid and ask. In a feed out of order the touch of a whole cell may be by a tick that stands before the entry; the ticks of
    all cells from there on are listed then, so that none is missed.
    """
    ident = ["candidate_id", "symbol", "direction", "stop_loss", "take_profit", "entry_ms", "entry_seq", "barrier_ms"]
    live = live.select(*ident)
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    cells = index(ticks, width)
    listed = live.select(*ident, F.inline(cover(cell("entry_ms") + 1, cell("barrier_ms"))))
    found = _earliest(listed, cells, ident)
    for _ in range(LEVELS - 1):  # a cell of level 0 stays as it is
        inner = F.when(F.col("level") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long")), lambda k: F.struct((F.col("level") - 1).alias("level"), (F.col("cell") * FAN + k).alias("cell"))))
        inner = F.coalesce(inner, F.array(F.struct(F.col("level").alias("level"), F.col("cell").alias("cell"))))
        found = _earliest(found.select(*ident, F.inline(inner)), cells, ident)
    until = F.when(F.col("least_seq") <= F.col("entry_seq"), cell("barrier_ms")).otherwise(F.col("cell"))
    wanted = live.select(*ident, F.explode(F.array_distinct(F.array(cell("entry_ms"), cell("barrier_ms")))).alias("__cell")).unionByName(found.select(*ident, F.explode(F.sequence(F.col("cell"), until)).alias("__cell"))).distinct()
    own = ticks.withColumn("__at", cell("time_ms")).withColumnRenamed("symbol", "__symbol")
    near = wanted.join(own, (F.col("symbol") == F.col("__symbol")) & (F.col("__cell") == F.col("__at")))
    return near.where("time_ms BETWEEN entry_ms AND barrier_ms AND seq > entry_seq").select(*ident, "seq", "time_ms", "bid", "ask")
