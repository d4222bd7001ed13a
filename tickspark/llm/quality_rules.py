"""Quality rules with adaptive thresholds (operator 9), in DataFrame functions only.

Measures of each text feed a mergeable quantile sketch per (lang, source): counts of
values in buckets whose bounds grow by the factor ``GAMMA``, so that a quantile is right
to ``ACCURACY`` of its value. Sketches merge by adding counts, in any order and with the
same result in every run (the engine's KLL sketches are random beyond some thousand rows).
They are merged upwards to a language and to the corpus, and each group's
cut is an upper fence (third quartile plus ``FENCE`` times the interquartile
range) of the narrowest level that has at least ``MIN_ROWS`` rows. Where the quartiles
are equal the fence starts from the group's ``TAIL`` quantile instead; a small spread
of ``SPREADS`` keeps fences off the ordinary rows. The cuts are joined back to the rows.

Defined results: a null or empty text has no words and fails the base rule; a
null ``lang`` or ``source`` is a group of its own; repeated rows are judged
one by one and alike; an empty table gives an empty result. Columns of the
input stay, and those of clashing names are replaced by the measures.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, WORD_CLASS, materialize, text_or_empty, words_of

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_ROWS, FENCE = 200, 3.0
#: Relative error of a quantile, the growth of bucket bounds that gives it, and the digits of a cut.
ACCURACY = 0.01
GAMMA, DIGITS = (1 + ACCURACY) / (1 - ACCURACY), 4

#: Where the fence of a group with equal quartiles starts, and measure -> the least interquartile range that a fence reckons with.
TAIL, SPREADS = 0.9, {"symbol_rate": 0.01, "dup_line_rate": 0.08, "repeat_rate": 0.08, "mean_word": 0.1}


def _repeat_words(with_windows: DataFrame, window: int) -> DataFrame:
    """Words covered by windows whose hash occurs twice or more: sort (hash, start), keep the starts of equal neighbours, add up the gaps between starts.

    Each step is a column of its own, so that a lambda reads an array instead of computing it anew for every element.
    """
    h, p, s = F.col("__h"), F.col("__p"), F.col("__s")
    same = lambda k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    return (
        with_windows.withColumn("__p", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .withColumn("__p", F.transform(p, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"])))
        .withColumn("__s", F.array_sort(F.array_compact(p)))
        .withColumn("__s", F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(s, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long"))
        .drop("__p", "__s", "__h", "__lines")
    )


def with_measures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the five base measures and ``n_lines`` as long columns; ``window`` is a power of two. Windows are compared by a 64-bit hash of word hashes."""
    body = text_or_empty(F.col(text))
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(WORD_CLASS))
    step1 = (
        docs.withColumn("word_chars", F.length(F.regexp_replace(body, SPACE_CLASS + "+", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("__lines", lines)
        .withColumn("__h", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    )
    h = F.col("__h")
    step2 = (
        step1.withColumn("n_words", F.size(h).cast("long"))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    )
    # hashes of windows of 2, 4, 8, ... words, each from two windows of half the width
    width = 1
    while width < window:
        left = F.greatest(F.size(h) - width, F.lit(0))
        step2 = step2.withColumn("__h", F.zip_with(F.slice(h, 1, left), F.slice(h, width + 1, left), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return _repeat_words(step2, window)


def _rates() -> dict[str, Column]:
    some = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / some,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col("n_repeat_words") / some,
        "mean_word": F.col("word_chars") / some,
    }


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, measure, bucket, n) under working names: how many texts of a group have a rate in a bucket. Zero has the bucket null, which is the least.

    Partial counts leave each task, at most some thousand per group and rate whatever the number of rows.
    """
    listed = measured.where(F.col("n_words") >= MIN_WORDS).select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.inline(F.array(*(F.struct(F.lit(name).alias("__measure"), x.alias("__x")) for name, x in _rates().items()))))
    bucket = F.when(F.col("__x") > 0, F.ceil(F.log("__x") / math.log(GAMMA)).cast("int"))
    return listed.groupBy("__lang", "__source", "__measure", bucket.alias("__bucket")).agg(F.count("*").alias("__n"))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source) with a cut per rate, its level (0 own, 1 language, 2 corpus) and, per rate, whether the group's own spread exceeds the least one; few rows, each made of sketches only."""
    own = materialize(sketches(measured, lang, source), "quality-sketches")
    nothing = F.lit(None).cast("string")
    keys = ["__level", "__lang", "__source"]

    def level(k: int, lang_key: Column, source_key: Column) -> DataFrame:
        return own.select(F.lit(k).alias("__level"), lang_key.cast("string").alias("__lang"), source_key.cast("string").alias("__source"), "__measure", "__bucket", "__n")

    merged = level(0, F.col("__lang"), F.col("__source")).unionByName(level(1, F.col("__lang"), nothing)).unionByName(level(2, nothing, nothing))
    merged = merged.groupBy(*keys, "__measure", "__bucket").agg(F.sum("__n").alias("__n"))
    whole = Window.partitionBy(*keys, "__measure")
    ranked = merged.withColumn("__upto", F.sum("__n").over(whole.orderBy(F.col("__bucket").asc_nulls_first()))).withColumn("__rows", F.sum("__n").over(whole))
    value = F.when(F.col("__bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("__bucket")) / (GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("__upto") >= F.ceil(q * F.col("__rows")), value))
    fences = ranked.groupBy(*keys, "__measure", "__rows").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), at(TAIL).alias("tail"))
    least = F.coalesce(*(F.when(F.col("__measure") == name, F.lit(x)) for name, x in SPREADS.items()))
    fences = fences.withColumn("cut", F.round(F.when(F.col("q3") > F.col("q1"), F.col("q3")).otherwise(F.col("tail")) + FENCE * F.greatest(F.col("q3") - F.col("q1"), least), DIGITS)).withColumn("wide", F.col("q3") - F.col("q1") > least)
    of = lambda c: F.struct(*(F.max(F.when(F.col("__measure") == name, F.col(c))).alias(name) for name in SPREADS))
    cuts = materialize(fences.groupBy(*keys).agg(F.max("__rows").alias("__rows"), of("cut").alias("__cut"), of("wide").alias("__wide")), "quality-cuts")

    # a group's cut comes from the narrowest level with enough rows
    def side(k: int, *names: str) -> DataFrame:
        return cuts.where(F.col("__level") == k).select(*names, F.col("__rows").alias(f"__rows_{k}"), F.struct("__cut", "__wide").alias(f"__f_{k}"))

    best = side(0, "__lang", "__source").join(side(1, F.col("__lang").alias("__lang2")), F.col("__lang").eqNullSafe(F.col("__lang2")), "left").join(F.broadcast(side(2)), F.lit(True), "left")
    place = F.when(F.col("__rows_0") >= MIN_ROWS, 0).when(F.col("__rows_1") >= MIN_ROWS, 1).otherwise(2)
    chosen = F.when(place == 0, F.col("__f_0")).when(place == 1, F.col("__f_1")).otherwise(F.col("__f_2"))
    return best.select("__lang", "__source", place.alias("__level"), chosen["__cut"].alias("__cut"), chosen["__wide"].alias("__wide"))


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows that have their measures. ``measured`` is read twice, so give a written table."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # a group in which every text is short has no cut
    outlier = F.coalesce(reduce(or_, (x > F.col("__cut")[name] for name, x in _rates().items())), F.lit(False))
    match = F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source"))
    joined = measured.join(thresholds(measured, lang, source), match, "left")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~outlier).drop("__lang", "__source", "__level", "__cut", "__wide")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    boxed = docs.select(F.struct("*").alias("__row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = materialize(with_measures(boxed).drop("text"), "quality-measures")
    return judge(measured).where("kept").select("__row.*")


_SQL_SPREADS = " ".join(f"WHEN '{name}' THEN {x}::DOUBLE" for name, x in SPREADS.items())
_SQL_RATES = {"symbol_rate": "n_symbols / greatest(n_words, 1)", "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)", "repeat_rate": "n_repeat_words / greatest(n_words, 1)", "mean_word": "word_chars / greatest(n_words, 1)"}
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), w AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), g AS (
  SELECT rid, i, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win, count(*) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n FROM w
), r AS (
  SELECT rid, i FROM g WHERE n = {WINDOW} QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), c AS (
  SELECT rid, sum(gap) AS n_repeat_words FROM (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS gap FROM r) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (rid)
), x AS (
  SELECT rid, lang, source, n_words, unnest({list(_SQL_RATES)}) AS measure, unnest([{", ".join(f"({v})::DOUBLE" for v in _SQL_RATES.values())}]) AS x FROM m
), k AS (
  SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / {math.log(GAMMA)!r}::DOUBLE)::INT END AS bucket FROM x WHERE n_words >= {MIN_WORDS}
), l AS (
  SELECT level, measure, bucket, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, count(*) AS n FROM k, (VALUES (0), (1), (2)) v(level) GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
    CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({GAMMA!r}::DOUBLE, bucket) / {GAMMA + 1!r}::DOUBLE END AS value FROM l
), f AS (
  SELECT level, lang, source, measure, total, min(value) FILTER (upto >= ceil(total / 4)) AS q1, min(value) FILTER (upto >= ceil(total * 3 / 4)) AS q3, min(value) FILTER (upto >= ceil({TAIL}::DOUBLE * total)) AS tail,
    CASE measure {_SQL_SPREADS} END AS least FROM u GROUP BY ALL
), t AS (
  SELECT *, round(CASE WHEN q3 > q1 THEN q3 ELSE tail END + {FENCE}::DOUBLE * greatest(q3 - q1, least), {DIGITS}) AS cut FROM f
), b AS (
  SELECT o.lang, o.source, o.measure, CASE WHEN o.total >= {MIN_ROWS} THEN o.cut WHEN g.total >= {MIN_ROWS} THEN g.cut ELSE a.cut END AS cut
  FROM t o JOIN t g ON g.level = 1 AND g.measure = o.measure AND g.lang IS NOT DISTINCT FROM o.lang JOIN t a ON a.level = 2 AND a.measure = o.measure WHERE o.level = 0
), o AS (
  SELECT x.rid, bool_or(x.x > b.cut) AS outlier FROM x JOIN b ON b.measure = x.measure AND b.lang IS NOT DISTINCT FROM x.lang AND b.source IS NOT DISTINCT FROM x.source GROUP BY x.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT coalesce(outlier, false) AS kept
FROM m LEFT JOIN o USING (rid)
"""
