"""Repeated passages by a count-min prefilter and exact grouping (operator 12).

A window is ``WINDOW`` consecutive words of one document; a word goes if a window over it also starts in a document with a
smaller id.

1. Sketch. A window is counted under its anchor, the least hashed run of ``GRAM`` words in it, so that neighbouring windows
   share a counter and about one in thirteen positions counts. Every task counts its documents' anchors in a count-min sketch
   (``DEPTH`` rows, kept sparse); sketches merge by adding. An anchor's estimate is never below the number of documents that
   hold it, and equal windows have equal anchors, so no repeated window is lost.
2. Grouping. A second pass emits only windows estimated in two or more documents. Neighbours under one anchor travel as a
   chunk. Equal chunks are grouped exactly first: all but the least document's lose all their windows. Of the chunks left,
   those that share an anchor with a different chunk are opened, and their windows grouped one by one. A window's least
   document always has it in a chunk that is opened or alone, so the two levels give what grouping all windows would.
3. Cutting. Only documents that lose some of their words and keep others are joined with their texts again; the join moves
   all texts once, unless such documents are few.

The merged sketch is a bitmap of ``CELLS`` bits (cells that count two or more), 32 MiB whatever the input; it goes to the
tasks as a broadcast. When documents have more anchors than that can part (some 10 GB of text; give more ``cells`` there)
estimates grow, more windows are grouped exactly, and the results stay the same. Windows are compared by 128 bits (a hash
of the anchor and one of the window) over 64-bit hashes of words.

Defined results: a null or blank text has no words; texts under ``WINDOW`` words lose none; rows with one id are no smaller
than each other, so they never empty each other; a null id is neither smaller nor larger than any, so such rows stay whole
and empty nothing; an empty table gives an empty result. Other columns stay as they are in :func:`drop_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._common import materialize, text_or_empty

WINDOW, GRAM = 50, 25
DEPTH, CELLS = 2, 1 << 28
SLICE_BYTES, BLOCK_WORDS, HELD = 1 << 20, 1 << 20, 1 << 21

_U = np.uint64
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made longer when a word asks for it."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _BACK)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def _mix(a: np.ndarray, b: np.ndarray | np.uint64, seed: int) -> np.ndarray:
    """One hash of two; another family for each odd seed."""
    x = (a ^ (a >> _U(32))) * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(29))) * _U(seed)
    x ^= x >> _U(32)
    x *= _U(0x9FB21C651E98DF25)
    x ^= x >> _U(29)
    return x


_ANCHOR, _TEXT = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of ``data``: sums over bytes times powers, so that a word's is the difference of two running sums."""
    hashes, places, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + SLICE_BYTES, len(data))
        buf = np.frombuffer(data, np.uint8, hi - lo, lo)
        while hi < len(data) and not _SPACES[data[hi]]:  # to the end of the word
            step = np.frombuffer(data, np.uint8, min(SLICE_BYTES, len(data) - hi), hi)
            gap = np.flatnonzero(_SPACES[step])
            hi += int(gap[0]) if len(gap) else len(step)
            buf = np.frombuffer(data, np.uint8, hi - lo, lo)
        padded = np.concatenate(([True], _SPACES[buf], [True]))
        starts = np.flatnonzero(padded[:-1] & ~padded[1:])
        ends = np.flatnonzero(~padded[:-1] & padded[1:])
        _Powers.reach(len(buf) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * _Powers.up[: len(buf)])))
        h = (sums[ends] - sums[starts]) * _Powers.down[starts]
        hashes.append(_mix(h, (ends - starts).astype(np.uint64), _TEXT))
        places.append(starts + lo)
        lo = hi
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([none.astype(np.int64), *places])


def _grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words: runs of 2, 4, 8, ... from two halves, then two that overlap."""
    width = 1
    while 2 * width <= n:
        h, width = _mix(h[: len(h) - width], h[width:], seed), 2 * width
    return h if width == n else _mix(h[: len(h) - (n - width)], h[n - width :], seed)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Place of the least of every ``n`` neighbours, the first of equals."""
    at, width = np.arange(len(h)), 1
    while width < n:
        step = min(width, n - width)
        left, right = at[: len(at) - step], at[step:]
        at, width = np.where(h[right] < h[left], right, left), width + step
    return at


def chunks(h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows under one anchor, as arrays: anchor, first word, number of windows, and hashes of all the windows in order.

    ``h`` has the hashes of the words of several documents and ``doc`` their documents. Long input comes in blocks.
    """
    for lo in range(0, max(len(h) - WINDOW + 1, 0), BLOCK_WORDS):
        own = h[lo : lo + BLOCK_WORDS + WINDOW - 1]
        where = doc[lo : lo + BLOCK_WORDS + WINDOW - 1]
        whole = where[: len(own) - WINDOW + 1] == where[WINDOW - 1 :]
        if not whole.any():
            continue
        grams = _grams(own, GRAM, _ANCHOR)
        anchor = _least(grams, WINDOW - GRAM + 1)
        windows = _grams(own, WINDOW, _TEXT)
        first = np.flatnonzero(whole & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~whole[:-1])))
        n = np.add.reduceat(whole.astype(np.int64), first)
        yield grams[anchor[first]], first + lo, n, windows[whole]


def cells_of(anchors: np.ndarray, cells: int) -> np.ndarray:
    """Counter of each anchor in each row of the sketch, (DEPTH, n)."""
    each = cells // DEPTH
    return np.stack([(_mix(anchors, _U(k), 0x8EBC6AF09C88C6E3) >> _U(1)).astype(np.int64) % each + k * each for k in range(DEPTH)])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows of a batch in runs of about ``SLICE_BYTES``."""
    rows, texts, size = [], [], 0
    for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        rows.append(k)
        texts.append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the text that each is of."""
    h, at = word_hashes(b"\n".join(texts))
    return h, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), at, side="right")


def _bodies(docs: DataFrame) -> DataFrame:
    body = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def sketch(bodies: DataFrame, cells: int = CELLS) -> DataFrame:
    """The merged count-min sketch as rows (cell, n), without cells that count nothing: in how many documents anchors fall into the cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

        for batch in batches:
            for _, texts in _slices(batch):
                h, doc = _hashed(texts)
                for anchor, first, _, _ in chunks(h, doc):
                    of = doc[first]
                    order = np.lexsort((anchor, of))
                    of, anchor = of[order], anchor[order]
                    new = np.concatenate(([True], (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1])))  # once a document
                    held.append(cells_of(anchor[new], cells).ravel())
                    size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return bodies.where("doc_id IS NOT NULL").select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _bitmap(counted: DataFrame, cells: int) -> bytes:
    """A bit for each cell that counts two or more; ``cells`` bits, whatever the input."""
    full = counted.where("n >= 2")
    place = F.col("cell") + 1  # the engine's bitmaps count from one
    lines = full.groupBy(F.bitmap_bucket_number(place).alias("line")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(cells // 8)
    for row in lines.toLocalIterator():
        lo = (row["line"] - 1) * 4096
        out[lo : lo + 4096] = row["bits"][: len(out) - lo]
    return bytes(out)


_CHUNKS = pa.list_(pa.struct([("anchor", pa.int64()), ("span", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("windows", pa.list_(pa.int64()))]))


def candidates(bodies: DataFrame, cells: int = CELLS) -> DataFrame:
    """A written table (doc_id, text_key, n_words, words_sha256, chunks): per document its chunks that the sketch estimates in two or more documents."""
    shared = bodies.sparkSession.sparkContext.broadcast(_bitmap(sketch(bodies, cells), cells))

    def listed(texts: list[bytes]) -> pa.Array:
        bits = np.frombuffer(shared.value, np.uint8)
        h, doc = _hashed(texts)
        begins = np.searchsorted(doc, np.arange(len(texts)))
        parts = []
        for anchor, first, n, windows in chunks(h, doc):
            cell = cells_of(anchor, cells)
            seen = np.all(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1, axis=0)
            last = np.cumsum(n)
            span = _mix(_mix(windows[last - n], windows[last - 1], _TEXT), n.astype(np.uint64), _TEXT)
            parts.append((anchor[seen], span[seen], first[seen], n[seen], windows[np.repeat(seen, n)]))
        anchor, span, first, n, windows = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
        where = doc[first] if len(first) else first
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(windows.astype(np.int64)))
        columns = [pa.array(anchor.astype(np.int64)), pa.array(span.astype(np.int64)), pa.array((first - begins[where]).astype(np.int64)), pa.array(n.astype(np.int64)), inner]
        rows = pa.StructArray.from_arrays(columns, fields=list(_CHUNKS.value_type))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(len(texts) + 1)).astype(np.int32)), rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _slices(batch):
                words = [t.split() for t in texts]  # bytes split at the same six characters
                digests = [sha256(b" ".join(w)).hexdigest() for w in words]
                ids, keys = (batch.column(c).slice(rows[0], len(rows)) for c in ("doc_id", "text_key"))
                found = listed(texts)
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array([len(w) for w in words], pa.int64()), pa.array(digests, pa.string()), found], ["doc_id", "text_key", "n_words", "words_sha256", "chunks"])

    kind = bodies.schema["doc_id"].dataType.simpleString()
    made = bodies.mapInArrow(find, f"doc_id {kind}, text_key long, n_words long, words_sha256 string, chunks array<struct<anchor:long,span:long,start:long,n:long,windows:array<long>>>")
    return materialize(made, "substring-candidates")


def repeats(found: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, ranges, n_removed) for the documents of a table of :func:`candidates` that lose words; ``ranges`` has (start, end) of words in order."""
    rows = found.where("doc_id IS NOT NULL AND size(chunks) > 0").select("doc_id", "text_key", F.explode("chunks").alias("c"))
    key = ["anchor", "span"]
    flat = rows.select("doc_id", "text_key", F.col("c.anchor").alias("anchor"), F.col("c.span").alias("span"), F.col("c.start").alias("start"), F.col("c.n").alias("n"))
    owners = materialize(flat.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), "substring-owners")
    lost = flat.join(owners.where("owner < last").select(*key, "owner"), key).where("doc_id > owner").select("doc_id", "text_key", "start", "n")

    # chunks that meet a different chunk under their anchor, in their least document
    met = owners.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor")
    to_open = owners.join(met, "anchor").select(*key, F.col("owner").alias("doc_id"))
    opened = rows.select("doc_id", "text_key", "c.*").join(to_open, [*key, "doc_id"]).select("doc_id", "text_key", "anchor", F.posexplode("windows").alias("k", "window"), "start")
    opened = materialize(opened.select("doc_id", "text_key", "anchor", "window", (F.col("start") + F.col("k")).alias("start")), "substring-windows")
    least = opened.groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    single = opened.join(least, ["anchor", "window"]).where("doc_id > owner").select("doc_id", "text_key", "start", F.lit(1).cast("long").alias("n"))

    ends = F.col("start") + F.col("n") + (WINDOW - 1)
    taken = lost.unionByName(single).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", ends.alias("end")))).alias("ranges"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("upto"))
    grown = lambda a, r: F.struct((a["sum"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["start"], a["upto"]))).alias("sum"), F.greatest(a["upto"], r["end"]).alias("upto"))
    return taken.withColumn("n_removed", F.aggregate("ranges", zero, grown, lambda a: a["sum"]))


@F.pandas_udf(StringType())
def kept_words(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    """The words of each text outside its ranges, joined by one space."""
    out = []
    for text, own in zip(texts, ranges):
        words, at, kept = text.encode().split(), 0, []
        for r in own:
            if r["start"] > at:
                kept += words[at : r["start"]]
            at = max(at, r["end"])
        out.append(b" ".join(kept + words[at:]).decode())
    return pd.Series(out, dtype=object)


def digests(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``."""
    bodies = _bodies(docs)
    found = candidates(bodies, cells)
    gone = materialize(repeats(found), "substring-repeats")
    key = ["doc_id", "text_key"]
    facts = found.select(*key, "n_words", "words_sha256")
    judged = facts.join(gone.select(*key, "n_removed"), key, "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    part = judged.where("n_removed > 0 AND n_removed < n_words").select(*key).distinct()
    cut = bodies.join(gone.join(part, key), key).select(*key, F.sha2(kept_words("text", "ranges"), 256).alias("cut_sha256")).dropDuplicates(key)
    whole = F.when(F.col("n_removed") == F.col("n_words"), F.sha2(F.lit(""), 256)).otherwise(F.col("cut_sha256"))
    return judged.join(cut, key, "left").select("doc_id", "n_words", "n_removed", F.when(F.col("n_removed") == 0, F.col("words_sha256")).otherwise(whole).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """``docs`` with the repeated words cut from their texts; texts that lose none stay as they are, others have their kept words joined by one space."""
    gone = materialize(repeats(candidates(_bodies(docs), cells)), "substring-repeats")
    keys = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("ranges").alias("__ranges"))
    joined = docs.withColumn("__text", text_or_empty(F.col("text"))).join(keys, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("__text") == F.col("__key")), "left")
    ranges = F.coalesce("__ranges", F.array().cast(gone.schema["ranges"].dataType))
    return joined.withColumn("text", F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(kept_words("__text", ranges))).select(*docs.columns)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT rid, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM d WHERE len(words) >= {WINDOW})
), o AS (
  SELECT win, min(doc_id) AS owner FROM w GROUP BY win
), r AS (
  SELECT rid, i FROM w JOIN o USING (win) WHERE doc_id > owner
), g AS (
  SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS i FROM r
), x AS (
  SELECT rid, list(i) AS gone, count(*) AS n FROM g GROUP BY rid
), k AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d) ANTI JOIN g USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (rid) LEFT JOIN k USING (rid)
"""
