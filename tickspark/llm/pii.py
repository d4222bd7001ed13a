"""Personal data: fixed patterns, then information-theoretic sanitisation (operator 2).

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their
values are the protected entities. Over the corpus, a term t (a word) tells of
an entity e

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 + log(n(t, e) / n(t)) / log(N / n(e))

where N counts the documents, n(e) and n(t) those that hold e or t, and n(t, e)
those in which t stands within ``REACH`` words of e. At 1 the term gives the
entity away. A term counts if it stands by the entity in at least
``MIN_CONTEXTS`` different surroundings (copies of a text are one). From
``GENERALISE`` on a term is generalised and from ``REMOVE`` on removed, wherever it occurs, outside
the base spans.

The terms are never gathered on the driver: a bitmap of fixed size lets the
tasks skip words that can't be candidates, and joins decide.

Defined results: a null text counts as empty and has no spans; rows that share
an id or a text are judged alike; an empty table gives an empty result. ``sanitise`` adds
working columns named ``__key`` and ``__found``, which an input must not have.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
REACH, MIN_CONTEXTS, GENERALISE, REMOVE, MIN_TERM = 6, 3, 0.8, 0.97, 4
BITMAP_BITS = 1 << 22

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """The local part is what stands before an @ back to the first other character or the last address, so no text is read twice."""
    low = 0
    for m in _DOMAIN.finditer(text):
        start = low + len(text[low : m.start()].rstrip(_LOCAL))
        if start < m.start():
            yield "email", start, m.end()
            low = m.end()
        else:
            low = m.start() + 1  # no local part reaches back over an @


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost spans per kind that do not overlap, in the order of kind and start; matches that fail their test are dropped."""
    out = list(emails(text)) if "@" in text else []
    # a number of over three digits after its zeros is over 255; int() of endless digits is not needed
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> int:
    value = value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


class Outside:
    """Words of a text, in lower case with their places, that touch none of the spans."""

    def __init__(self, text: str, spans: list[Span]) -> None:
        self.text = text
        taken = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in taken]
        self.reach = [*accumulate((b for _, b in taken), max)]

    def words(self, lo: int, hi: int) -> list[tuple[int, int, str]]:
        out = []
        for m in _WORD.finditer(self.text, lo, hi):
            k = bisect_right(self.starts, m.end() - 1) - 1
            if k < 0 or self.reach[k] <= m.start():
                out.append((m.start(), m.end(), m[0].lower()))
        return out


def contexts(text: str, spans: list[Span]) -> Iterator[tuple[int, int, set[str]]]:
    """For each span: its entity, a hash of its surroundings, and the terms in them."""
    free = Outside(text, spans).words(0, len(text))
    starts, ends = [a for a, _, _ in free], [b for _, b, _ in free]
    for kind, a, b in spans:
        left, right = bisect_right(ends, a), bisect_left(starts, b)  # whole words, however far away
        words = [w for _, _, w in free[max(0, left - REACH) : left] + free[right : right + REACH]]
        yield entity(kind, text[a:b]), xxhash.xxh64_intdigest(" ".join(words).encode()) - (1 << 63), {w for w in words if len(w) >= MIN_TERM}


def _bit(term: str) -> int:
    return crc32(term.encode()) & (BITMAP_BITS - 1)


def _bitmap(terms: DataFrame) -> bytes | None:
    """A bit for each term of ``terms``, whose number has no bound; the bitmap's has. None if there are no terms."""
    places = F.pmod(F.crc32("term"), F.lit(BITMAP_BITS)).cast("int")
    lines = terms.select(places.alias("p")).distinct().groupBy(F.floor(F.col("p") / 65536).alias("line")).agg(F.collect_list("p").alias("p"))
    bits = np.zeros(BITMAP_BITS, bool)
    for row in lines.toLocalIterator():
        bits[row["p"]] = True
    return np.packbits(bits, bitorder="little").tobytes() if bits.any() else None


def _has(bitmap: bytes, term: str) -> bool:
    k = _bit(term)
    return bool(bitmap[k >> 3] >> (k & 7) & 1)


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """A written table (term, disclosure): terms from ``GENERALISE`` on, each with its largest disclosure. ``docs`` has ``text``."""
    spark = docs.sparkSession

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                spans = base_spans(text)
                if spans:
                    # per document: a term by an entity once for each surrounding, and once for the count of documents
                    own = {(e, c, t) for e, c, terms in contexts(text, spans) for t in (*terms, "")}
                    first = set()
                    for e, c, t in own:
                        seen[e, c, t, (e, t) not in first] += 1
                        first.add((e, t))
            rows = [(*k, n) for k, n in seen.items()]
            yield pd.DataFrame(rows, columns=["entity", "context", "term", "first", "n"])

    bodies = docs.select(text_or_empty(F.col("text")).alias("text"))
    near = bodies.mapInPandas(around, "entity long, context long, term string, first boolean, n long")
    one = near.groupBy("entity", "term", "context").agg(F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("docs"))
    both = materialize(one.groupBy("entity", "term").agg(F.sum("docs").alias("n_both"), F.count("*").alias("contexts")), "pii-pairs")
    of_entity = both.where("term = ''").select("entity", F.col("n_both").alias("n_entity"))
    pairs = materialize(both.where(f"term <> '' AND contexts >= {MIN_CONTEXTS}").join(of_entity, "entity"), "pii-candidates")
    bitmap = _bitmap(pairs.select("term"))
    empty = spark.createDataFrame([], "term string, disclosure double")
    if bitmap is None:
        return empty
    shared = spark.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update(t for t in {w.lower() for w in _WORD.findall(text)} if len(t) >= MIN_TERM and _has(bits, t))
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    frequency = bodies.mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    total = docs.count()
    information = F.log(F.lit(float(total)) / F.col("n_entity"))
    shown = F.when(information > 0, 1 + F.log(F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))) / information).otherwise(0.0)
    scored = pairs.join(frequency, "term").withColumn("disclosure", shown)
    return materialize(scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= GENERALISE), "pii-terms")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame | None:
    """Rows (text_key, found), found being an array of (start, end, disclosure) in order, for the texts that hold disclosing terms; None if there are none."""
    bitmap = _bitmap(terms)
    if bitmap is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            rows = []
            for key, text in zip(batch["text_key"], batch["text"]):
                if any(len(t) >= MIN_TERM and _has(bits, t) for t in {w.lower() for w in _WORD.findall(text)}):
                    rows += [(key, t, a, b) for a, b, t in Outside(text, base_spans(text)).words(0, len(text)) if len(t) >= MIN_TERM and _has(bits, t)]
            yield pd.DataFrame(rows, columns=["text_key", "term", "start", "end"])

    bodies = docs.select(text_key(), text_or_empty(F.col("text")).alias("text"))
    hits = bodies.mapInPandas(find, "text_key string, term string, start long, end long").join(terms, "term")
    return hits.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "disclosure"))).alias("found"))


def text_key() -> Column:
    """What names a text: equal texts share their spans, whatever ids they have."""
    body = text_or_empty(F.col("text"))
    return F.concat_ws(":", F.hex(F.xxhash64(body)), F.crc32(body), F.octet_length(body)).alias("text_key")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for every row of ``docs``."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string")
    def based(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = base_spans(text)
                kinds = [k for k, _, _ in spans]
                rows.append((*map(kinds.count, KINDS[:4]), digest(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = term_spans(docs, disclosing_terms(docs))
    rows = docs.select("doc_id", text_key(), based(text_or_empty(F.col("text"))).alias("b")).select("doc_id", "text_key", "b.*")
    if found is None:
        rows = rows.withColumn("more", F.lit("")).withColumn("n_term", F.lit(0).cast("long"))
    else:
        told = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"])), ",")
        rows = rows.join(found.select("text_key", told.alias("more"), F.size("found").cast("long").alias("n_term")), "text_key", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more")))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.coalesce("n_term", F.lit(0).cast("long")).alias("n_term")
    )


def sanitise_text(text: str, found: list[tuple[int, int, float]]) -> str:
    """Put ``[EMAIL]`` and the like for base spans, ``[TERM]`` for generalised terms and nothing for removed ones. Overlapping base spans are one, named by the first kind."""
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)] + [(a, b, "" if d >= REMOVE else "[TERM]") for a, b, d in found]
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], mark]
        at = b
    out.append(text[at:])
    return "".join(out)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every text sanitised; null texts stay null, other columns stay as they are."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sanitise_text(t, [] if f is None else [(r["start"], r["end"], r["disclosure"]) for r in f]) for t, f in zip(texts, found)], dtype=object)

    found = term_spans(docs, disclosing_terms(docs))
    names = docs.columns
    if found is None:
        rows = docs.withColumn("__found", F.lit(None).cast("array<struct<start:long,end:long,disclosure:double>>"))
    else:
        keyed = docs.withColumn("__key", text_key())
        rows = keyed.join(found.select(F.col("text_key").alias("__key"), F.col("found").alias("__found")), "__key", "left")
    return rows.withColumn("text", cleaned("text", "__found")).select(*names)
