"""Mixing sources to target weights by a low-discrepancy schedule (operator 6), in DataFrame functions only.

Every source gets a word target: weights ``WEIGHTS`` repeat over the sources in
code point order (null last) and share ``SHARE`` times all words; a target
stops at ``CAP`` times its source and the excess goes to the others by weight.

The schedule is a row of slots of ``block`` words each. Slot ``i`` takes the
golden-ratio point ``i * phi mod 1``, which falls into one source's part of the
cumulative slot shares. The k-th slot of a source is filled with the k-th block
of that source's documents, laid end to end in a shuffled order and repeated
where the target exceeds the source; the last block is cut at the target.
Slots beyond a source's need are left out, and the few that the points fall
short of come last, so each source gives exactly its target, rounded to words.
What the mix is, then, is an order: read slot by slot, it holds every source near
its share after any number of slots. ``mix_documents`` says for each document
where it first stands in that order and in how many pieces it does.

Nothing here depends on a group fitting into a task: running sums and ranks
are taken within ranges whose number follows the input, then shifted by the
sums of the ranges before.

Defined results: a null or blank text has size 0 and takes nothing; a null
source is a source; rows that share a ``doc_id`` are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import buckets_for, materialize, words_of

WEIGHTS, SHARE, CAP, BLOCK = (5, 2, 1), 1.5, 2.0, 2048
_GOLDEN, _RING, _SLOT_RANGE = 2654435769, 1 << 32, 1024


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.size(words_of(F.col(text))).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: ``sid`` (its place), ``source_size``, ``target`` and ``words``, the target rounded.

    The resharing ends at one level of words per weight: the sources that stop
    are the first ones by cap over weight, and the level is what is left over the weights that are left.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "sid")
    filled = (
        placed.withColumn("weight", weight.cast("double"))
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("stopped", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("stopped")) / F.col("heavy"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(whole)["level"])
        .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
    )
    return filled.select("source", "sid", "source_size", "target", F.round("target").cast("long").alias("words"))


def lay_out(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Each document's place ``start`` in its source's shuffled row of words."""
    n = buckets_for(sized.count(), 2000, 64)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    of_source = targets.select("sid", "source_size", "target", "words", F.col("source").alias("__source"))
    keyed = sized.join(of_source, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__o", order)
    keyed = keyed.withColumn("__b", (F.conv(F.substring("__o", 1, 6), 16, 10).cast("long") * n / (1 << 24)).cast("int"))
    before = Window.partitionBy("sid").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = keyed.groupBy("sid", "__b").agg(F.sum("size").alias("__n")).select("sid", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("sid", "__b").orderBy("__o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("__end", F.sum("size").over(inside)).join(shifts, ["sid", "__b"])
    return placed.withColumn("start", F.col("__shift") + F.col("__end") - F.col("size")).drop("__o", "__b", "__end", "__shift")


def schedule(spark: SparkSession, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (slot, sid, k): the k-th block of source sid fills this slot."""
    need = targets.withColumn("need", F.ceil(F.col("words") / F.lit(block)).cast("long")).where("need > 0")
    totals = need.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    n, grid = totals["n"], max(1024, 4 * totals["sources"])
    cum = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    spans = need.withColumn("hi", F.sum("need").over(cum)).withColumn("lo", F.col("hi") - F.col("need"))
    # a source's part of the unit interval, listed under every grid cell that it touches
    cell = lambda x: F.floor(x * grid / max(n, 1)).cast("long")
    parts = spans.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    point = ((F.col("slot") % (1 << 31)) * _GOLDEN % _RING).cast("double") / _RING * n
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("at", point).withColumn("cell", F.floor(F.col("at") * grid / max(n, 1)).cast("long"))
    hit = slots.join(parts, "cell").where("lo <= at AND at < hi").select("slot", "sid", F.floor(F.col("slot") / _SLOT_RANGE).alias("r"))
    counts = hit.groupBy("sid", "r").agg(F.count("*").alias("c"))
    shift = counts.select("sid", "r", F.coalesce(F.sum("c").over(Window.partitionBy("sid").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    ranked = hit.withColumn("k", F.row_number().over(Window.partitionBy("sid", "r").orderBy("slot")) - 1).join(shift, ["sid", "r"])
    dealt = ranked.select("slot", "sid", (F.col("k") + F.col("shift")).alias("k")).join(need.select("sid", "need"), "sid").where("k < need").select("slot", "sid", "k")
    got = counts.groupBy("sid").agg(F.sum("c").alias("got"))
    short = need.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    # the points fall short by a number that grows with the logarithm of the slots: a few rows, dealt in turns after all others
    late = short.select("sid", "got", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("k"))
    late = late.select((F.lit(n) + F.row_number().over(Window.orderBy(F.col("k") - F.col("got"), "sid")) - 1).alias("slot"), "sid", "k")
    return dealt.unionByName(late)


def laid_copies(placed: DataFrame) -> DataFrame:
    """Rows (..., copy, a, b): each copy of a document that the mix takes words from, and its words' places ``a`` to ``b`` in the source's row of words. Documents without words have none."""
    whole = placed.where("size > 0 AND words > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size")).cast("int"))))
    return whole.withColumn("a", F.col("start") + F.col("copy") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words"))).where("a < b")


def mix(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows (slot, sid, start, copy, doc_id, from_word, to_word): which words of which copy of which document fill a slot.

    ``placed`` comes from :func:`lay_out`.
    """
    inside = laid_copies(placed.select("sid", "start", "doc_id", "size", "source_size", "words"))
    cut = inside.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / block).cast("long"), F.floor((F.col("b") - 1) / block).cast("long"))))
    joined = cut.join(slots, ["sid", "k"])
    first = F.greatest(F.col("a"), F.col("k") * block)
    last = F.least(F.col("b"), (F.col("k") + 1) * block)
    return joined.select("slot", "sid", "start", "copy", "doc_id", (first - F.col("a")).alias("from_word"), (last - F.col("a")).alias("to_word"))


def taken_words(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """Add what the mix has of each document: ``taken``, its words, repeats counted, ``first_slot``, the slot where it begins (null: nowhere), and ``pieces``, how many stretches of it stand in slots."""
    per = mixed.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("__taken"), F.min_by("slot", F.struct("copy", "from_word")).alias("__first"), F.count("*").alias("__pieces"))
    # documents without words share a start with the next one but take nothing
    same = (F.col("sid") == F.col("__sid")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0)
    right = per.withColumnsRenamed({"sid": "__sid", "start": "__start"})
    counted = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return placed.join(right, same, "left").withColumns({"taken": counted("__taken"), "first_slot": F.col("__first"), "pieces": counted("__pieces")}).drop("__sid", "__start", "__taken", "__first", "__pieces")


def mix_documents(sized: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """``sized`` (a written table with doc_id, source, size and maybe more) with ``source_size``, ``target``, ``taken``, ``first_slot`` and ``pieces``."""
    spark = sized.sparkSession
    targets = materialize(source_targets(sized), "mix-targets")
    placed = materialize(lay_out(sized, targets, seed), "mix-places")
    return taken_words(placed, mix(placed, schedule(spark, targets, block), block))


def copy_slots(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (name, start, slot, offset) of the whole copies that a mix of whole documents has: those of which it takes half the words or more, at the slot where they begin."""
    begun = laid_copies(placed).where(2 * (F.col("b") - F.col("a")) >= F.col("size")).withColumn("k", F.floor(F.col("a") / block).cast("long"))
    return begun.join(slots, ["sid", "k"]).select("name", "start", "slot", (F.col("a") - F.col("k") * block).alias("offset"))


def repeat_documents(docs: DataFrame, text: str = "text", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, in whole copies, laid out in the order of their slots: file by file and row by row, each source stays near its share.

    Rows alike in id, source and text are told apart by their number among them, so each gets its own copies. Working columns begin with ``__mix``.
    """
    own = F.xxhash64("doc_id", "source", text)
    sized = materialize(measure(docs.select("doc_id", "source", text, own.alias("name")), text).drop(text), "mix-sizes")
    targets = materialize(source_targets(sized), "mix-targets")
    placed = materialize(lay_out(sized, targets, seed), "mix-places")
    numbered = placed.withColumn("twin", F.row_number().over(Window.partitionBy("name").orderBy("start", "size"))).select("name", "start", "twin", "sid", "size", "source_size", "words")
    copies = copy_slots(numbered, schedule(docs.sparkSession, targets, block), block)
    copies = copies.join(numbered.where("size > 0").select("name", "start", "twin"), ["name", "start"]).select(F.col("name").alias("__mix_name"), F.col("twin").alias("__mix_at"), "slot", "offset")
    copies = materialize(copies.select("__mix_name", "__mix_at", F.col("slot").alias("__mix_slot"), F.col("offset").alias("__mix_offset")), "mix-copies")
    rows = docs.withColumn("__mix_key", own).withColumn("__mix_twin", F.row_number().over(Window.partitionBy("__mix_key").orderBy(F.xxhash64(*docs.columns))))
    # twins are matched beside the join's key: as part of it they would make the texts move once more
    met = rows.join(copies, F.col("__mix_key") == F.col("__mix_name")).where(F.col("__mix_twin").between(F.col("__mix_at"), F.col("__mix_at")))
    return met.repartitionByRange("__mix_slot", "__mix_offset").sortWithinPartitions("__mix_slot", "__mix_offset").select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
), w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s
), r AS (
  SELECT *, most / weight AS ratio FROM w
), f AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), l AS (
  SELECT arg_min(level, ratio) FILTER (level <= ratio) AS level FROM f
), t AS (
  SELECT f.source, f.sid, f.source_size, least(f.most, coalesce(l.level * f.weight, f.most)) AS target FROM f, l
), p AS (
  SELECT d.rid, d.doc_id, d.size, t.sid, t.source_size, t.target, round(t.target)::BIGINT AS words,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(d.doc_id::VARCHAR, '-')), d.doc_id, d.size
      ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), need AS (
  SELECT sid, ceil(round(target) / 2048)::BIGINT AS need, sum(ceil(round(target) / 2048)::BIGINT) OVER (ORDER BY sid)::BIGINT AS hi FROM t WHERE round(target) > 0
), points AS (
  SELECT slot, n, ((slot % 2147483648) * 2654435769 % 4294967296)::DOUBLE / 4294967296::DOUBLE * n AS point FROM (SELECT n, unnest(range(n)) AS slot FROM (SELECT sum(need)::BIGINT AS n FROM need))
), hits AS (
  SELECT slot, sid, need, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS k FROM points JOIN need ON hi - need <= point AND point < hi
), short AS (
  SELECT need.sid, need.need, coalesce(got, 0) AS got FROM need LEFT JOIN (SELECT sid, count(*) AS got FROM hits GROUP BY sid) USING (sid)
), late AS (
  SELECT sid, got, unnest(range(got, need)) AS k FROM short WHERE got < need
), slots AS (
  SELECT slot, sid, k FROM hits WHERE k < need
  UNION ALL SELECT (SELECT sum(need) FROM need)::BIGINT + row_number() OVER (ORDER BY k - got, sid) - 1, sid, k FROM late
), laid AS (
  SELECT rid, sid, size, copy, a, least(a + size, words) AS b FROM (SELECT *, e - size + copy * source_size AS a FROM p, (VALUES (0), (1)) v(copy)) WHERE size > 0 AND a < words
), pieces AS (
  SELECT rid, copy, greatest(a, k * 2048) AS lo, least(b, (k + 1) * 2048) AS hi, sid, k FROM (SELECT *, unnest(range(a // 2048, (b - 1) // 2048 + 1)) AS k FROM laid)
), per AS (
  SELECT rid, sum(hi - lo)::BIGINT AS taken, arg_min(slot, (copy, lo)) AS first_slot, count(*) AS pieces FROM pieces JOIN slots USING (sid, k) GROUP BY rid
)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken, first_slot, coalesce(pieces, 0) AS pieces FROM p LEFT JOIN per USING (rid)
"""
