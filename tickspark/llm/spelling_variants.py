"""Spelling variants of a corpus' words by a permuterm index (operator 11).

Words are counted per task first, so a frequent one is a row per task. Every counted word gets a terminator and all its
rotations; sorted, the rotations that start with the same letters stand together. With ``w = A x B``, the rotation that
begins behind ``x`` is ``B $ A x``: what starts with ``B $ A`` is the word without that letter (the rotation itself) and
every word with another letter there (the rotation and one letter). So each rotation is listed under itself and, unless it
ends with the terminator, under all but its last letter; a scan over the sorted keys meets the neighbours of all three
kinds of edit. A key has at most one row for each letter of the alphabet (90) and one more, whatever the corpus.

Two words are near if one inserted, deleted or replaced code point leads from one to the other. A word's form is its most
frequent near word (the smallest of equals) if that is at least ``RATIO`` times as frequent; forms get more frequent by
that factor at every step, so roots are found by a few rounds of doubling.

Defined results: a null or empty text has no words; runs of a document without id are counted as they stand; repeated rows
count each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CRC32_CTES, buckets_for, crc32_sql, materialize, text_or_empty

MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
MARK = "$"  # no letter, and before all letters
HELD = 200_000  # words that a task counts before it hands them on
_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)  # shorter runs never make a word


def words_in(doc_id: object, text: bytes) -> Iterator[tuple[str, int]]:
    """Words of a UTF-8 text with how often they occur; one run in ``EVERY`` loses a letter, by a hash of id and run."""
    head = None if doc_id is None else crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUNS.findall(text.lower().decode("utf-8", "replace"))).items():  # lower() of bytes changes A-Z only
        if head is not None and (h := crc32(run.encode(), head)) % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        yield run, n


def word_counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """A written table (word, n) of the words that occur ``least`` times or more in all texts of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                for word, n in words_in(doc_id, text.as_py()):
                    seen[word] += n
                if len(seen) > HELD:
                    yield flush()
                    seen.clear()
        yield flush()

    partial = docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).mapInArrow(count, "word string, n long")
    return materialize(partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "spelling-words")


def rotations(words: DataFrame) -> DataFrame:
    """Rows (key, word, n): every rotation of the marked word, and every rotation that ends with a letter without that letter."""
    marked = words.withColumn("m", F.concat("word", F.lit(MARK)))
    turned = marked.select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("m")), lambda i: F.concat(F.col("m").substr(i, F.length("m")), F.col("m").substr(F.lit(1), i - 1)))).alias("r"))
    skipped = F.when(~F.endswith("r", F.lit(MARK)), F.col("r").substr(F.lit(1), F.length("r") - 1))
    return turned.select(F.explode(F.array_compact(F.array("r", skipped))).alias("key"), "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """Rows (word, near, near_n), once for each ordered pair of near words of a written table (word, n)."""
    rows = rotations(words)
    ordered = rows.repartitionByRange(buckets_for(words.count(), 5_000), "key").sortWithinPartitions("key")
    groups = ordered.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("own")).where(F.size("own") > 1)
    pairs = groups.select("own", F.explode("own").alias("a")).select(F.col("a.word").alias("word"), F.explode("own").alias("b")).where("word <> b.word")
    return pairs.select("word", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for the words of ``forms`` (word, form), each link leading to a more frequent word; every round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for every word of the corpus."""
    words = word_counts(docs)
    best = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    judged = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("b.less") >= RATIO * F.col("n"), -F.col("b.less")))
    judged = materialize(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n", F.when(F.col("form_n").isNotNull(), F.col("b.near")).alias("form")), "spelling-forms")
    found = roots(judged.where("form IS NOT NULL"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE {CRC32_CTES}, r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), g AS (
  SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
), h AS (
  SELECT run, c, {crc32_sql("(doc_id || ':' || run)")} AS h FROM g, crc
), e AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h
), w AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}
), x AS MATERIALIZED (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.rest
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.rest
), b AS (
  SELECT word, count(*) AS n_near, max(n) AS top, arg_min(near, struct_pack(a := -n, b := near)) AS near FROM p GROUP BY word
), f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN near END AS form, CASE WHEN top >= {RATIO} * n THEN top END AS form_n FROM w LEFT JOIN b USING (word)
), c(word, here, k) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, k) AS root FROM c GROUP BY word) USING (word)
"""
