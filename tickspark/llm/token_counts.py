"""Token counts by heap-and-linked-list byte-pair merging (operator 4).

Each pre-token starts as one symbol per UTF-8 byte. A heap holds the adjacent
pairs that have a merge rank; the lowest rank (leftmost on ties) is popped and
merged in a doubly linked list until no ranked pair is left. The count is the
number of bytes minus the number of merges, so no token identifiers are built.

Defined results: a null or empty text has 0 bytes and 0 tokens. The string of
an added special token inside a text counts as one token, as the tokenizer
library does by default. Other columns of the input stay; an existing column
called like an output column is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

#: Fixed value: how the vocabulary's byte-level pre-tokenizer cuts a text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s++"

#: A worker keeps the counts of at most so many distinct strings in each of two caches, none of them longer than the second bound.
CACHE_ENTRIES, CACHE_LENGTH = 1_000_000, 64
UNSAFE = -(1 << 60)


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes printable Latin-1 bytes as themselves and the others as code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        shown[chr(256 + k)] = b
    return shown


class Counts(dict):
    """Counts by string, made when first asked for; of bounded size."""

    def __init__(self, count: Callable[[str], int]) -> None:
        self.make = count

    def __missing__(self, piece: str) -> int:
        n = self.make(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = n
        return n


class PairMerger:
    """Merge ranks of one vocabulary file, and counts by them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        self.byte_id = [0] * 256
        for shown, b in letters.items():
            self.byte_id[b] = vocab[shown]
        # a pair of ids is one integer; the rank names the pair, so the heap needs no more than rank and place
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = r
            self.merged.append(vocab[left + right])
        self.special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.pieces = Counts(self.merge_count)
        self.chunks = Counts(self.chunk_count)

    def merge_count(self, piece: str) -> int:
        """Tokens of one pre-token: symbols minus merges."""
        byte_id, rank, merged = self.byte_id, self.rank, self.merged
        ids = [byte_id[b] for b in piece.encode()]
        n = count = len(ids)
        heap = []
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        if not heap:
            return n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(heap)
        while heap:
            key = heappop(heap)
            i = key & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or rank.get(ids[i] << 32 | ids[j]) != key >> 32:
                continue  # one of the two was merged meanwhile
            new = ids[i] = merged[key >> 32]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(new << 32 | ids[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(ids[h] << 32 | new)
                if r is not None:
                    heappush(heap, r << 32 | h)
            count -= 1
        return count

    def chunk_count(self, chunk: str) -> int:
        """Tokens of a space and ``chunk``; far below zero if white space at an end could reach over the cut."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return UNSAFE
        return sum(map(self.pieces.__getitem__, self.find(" " + chunk)))

    def plain_count(self, text: str) -> int:
        """A pre-token holds a space only as its first character, so a space between two visible characters always starts one and the texts between such spaces count on their own."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            total = sum(map(self.chunks.__getitem__, rest), sum(map(self.pieces.__getitem__, self.find(first))))
            if total >= 0:
                return total
        return sum(map(self.pieces.__getitem__, self.find(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special_re is None or not any(s in text for s in self.special):
            return self.plain_count(text)
        parts = self.special_re.split(text)
        return len(parts) - 1 + sum(map(self.plain_count, parts))


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    """One per Python worker and vocabulary file."""
    return PairMerger(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row, without a shuffle.

    ``tokenizer_path`` names a byte-level BPE file that every executor can open.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = merger(tokenizer_path).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    body = text_or_empty(F.col(text))
    return (
        docs.withColumn("n_tokens", n_tokens(body))
        .withColumn("n_bytes", F.octet_length(body).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
