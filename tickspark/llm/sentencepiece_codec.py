"""SentencePiece encoding and decoding by suffix-array matching (operator 3).

A text is cut before every run of word marks that follows other characters (no
piece of the vocabulary crosses such a place; a vocabulary for which that does
not hold is refused). The distinct chunks of a batch that were not met before
are laid end to end, and a suffix array over them, sorted to the
length of the longest piece, is searched by bisection for all pieces at once. The ranges found
are the edges (start, end, piece) of the chunks' lattices. Sorted by position,
they are relaxed from left to right.

The vocabulary is of the byte-pair kind, so relaxing does not add up scores: the
library's segmentation of a prefix extended by a piece is its
segmentation of the longer prefix exactly if the last piece and the new one
are what the merges make of the two pieces' own text. That is checked by undoing the two
pieces' merges from the latest to the earliest; of all edges into a place,
one passes. Characters without a piece become byte pieces.

Defined results: a null or empty text has no pieces and decodes to the empty
text; a literal U+2581 decodes to a space, as in the library. Other columns stay.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ._common import text_or_empty

MARK = "▁"
#: Code points indexed at a time, and slots of the table of checked pairs.
INDEX_CHARS, PAIR_SLOTS = 200_000, 1 << 20
#: Chunks and bytes of them and their ids that a worker remembers between calls (a call may pass them by what it adds), and the longest one.
CACHE_ENTRIES, CACHE_BYTES, CACHE_LENGTH = 300_000, 64 << 20, 64
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_LANE = 4  # 16-bit symbols in a 64-bit key


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, message[at : at + size]
        at += size


def check_model(path: str) -> None:
    """Refuse a model that this operator would cut otherwise than the library: other than byte pairs, or with a normaliser that changes the text."""
    with open(path, "rb") as file:
        parts = dict(f for f in _fields(file.read()) if f[0] in (2, 3))
    trainer, normaliser = (dict(_fields(parts.get(k, b""))) for k in (2, 3))
    if trainer.get(3, 1) != 2:
        raise ValueError("not a model of byte pairs")
    if normaliser.get(1) != b"identity" or normaliser.get(2, b""):
        raise ValueError("the model normalises its texts")
    if not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("the model treats white space in another way")


class PieceModel:
    """The vocabulary as arrays. Pieces are numbered by rank: the earlier merged, the lower."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        check_model(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        piece_text = [sp.id_to_piece(i) for i in range(size)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        normal.sort(key=lambda i: (-sp.get_score(i), i))
        self.ids = np.array(normal, dtype=np.int32)
        self.pieces = [piece_text[i] for i in normal]
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece reaches over a word mark")
        rank = {p: r for r, p in enumerate(self.pieces)}
        n = len(self.pieces)
        self.left, self.right = np.arange(n), np.arange(n)
        usable = np.ones(n, bool)
        pairs: dict[int, int] = {}
        for r, p in enumerate(self.pieces):
            for k in range(1, len(p)):
                a, b = rank.get(p[:k]), rank.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = r
        for r, p in enumerate(self.pieces):
            if len(p) > 1:
                usable[r], self.left[r], self.right[r] = self._last_merge(p, rank)
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        # symbols: 1 and up in order of code point; 0 ends a chunk or has no piece
        letters = sorted({c for p in self.pieces for c in p})
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.longest = max(map(len, self.pieces))
        self.lanes = -(-self.longest // _LANE)
        matched = np.flatnonzero(usable)
        self.matched, self.lengths = matched, np.array([len(self.pieces[r]) for r in matched], dtype=np.int64)
        low = np.zeros((len(matched), self.lanes * _LANE), np.uint16)
        for row, r in enumerate(matched):
            low[row, : self.lengths[row]] = self.symbol[[ord(c) for c in self.pieces[r]]]
        high = np.where(np.arange(low.shape[1])[None, :] < self.lengths[:, None], low, 0xFFFF).astype(np.uint16)
        self.low, self.high = self._keys(low), self._keys(high)
        self.seen_pair, self.seen_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _last_merge(piece: str, rank: dict[str, int]) -> tuple[bool, int, int]:
        """Whether the merges make the whole piece of its characters, and the two parts joined last."""
        parts: list[str | None] = list(piece)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[s], i, s) for i in range(len(parts) - 1) if (s := parts[i] + parts[i + 1]) in rank]
        heapify(heap)
        last = ("", "")
        while heap:
            _, i, s = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != s:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j] = s, None
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (s2 := s + parts[k]) in rank:
                    heappush(heap, (rank[s2], i, s2))
            h = before[i]
            if h >= 0 and (s2 := parts[h] + s) in rank:
                heappush(heap, (rank[s2], h, s2))
        if parts[0] != piece or any(x not in rank for x in last):
            return False, rank[piece], rank[piece]
        return True, rank[last[0]], rank[last[1]]

    @staticmethod
    def _keys(symbols: np.ndarray) -> list[np.ndarray]:
        """Rows of symbols as unsigned integers of four symbols each, the first ones the highest."""
        wide = symbols.astype(np.uint64).reshape(len(symbols), -1, _LANE)
        return [wide[:, k, 0] << 48 | wide[:, k, 1] << 32 | wide[:, k, 2] << 16 | wide[:, k, 3] for k in range(wide.shape[1])]

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do pieces a and b stay as they are when they stand side by side? Undo the later of their last merges, again and
        again; they do not if the parts that meet would have merged before that one (or, on the right side, with it: equal merges go left first)."""
        n = len(self.pieces)
        fits = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        a, b, at = a.copy(), b.copy(), np.arange(len(a))
        while len(at):
            place = np.minimum(np.searchsorted(self.pair_keys, key := a * n + b), len(self.pair_keys) - 1)
            bad = (self.pair_keys[place] == key) & (self.pair_ranks[place] < limit)
            fits[at[bad]] = False
            # single characters were never merged
            open_a, open_b = self.left[a] != a, self.left[b] != b
            go = ~bad & (open_a | open_b)
            a, b, limit, at, open_a, open_b = a[go], b[go], limit[go], at[go], open_a[go], open_b[go]
            undo_a = open_a & (~open_b | (a > b))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return fits

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_fits` behind a table of pairs checked before; -1 is a character without a piece, which fits anything."""
        out = np.ones(len(a), bool)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[both] * len(self.pieces) + b[both]
        slot = (key * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
        known = self.seen_pair[slot] == key
        out[both[known]] = self.seen_fits[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            pairs = np.unique(key[new])
            value = self._fits(pairs // len(self.pieces), pairs % len(self.pieces))
            out[both[new]] = value[np.searchsorted(pairs, key[new])]
            where = (pairs * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
            self.seen_pair[where], self.seen_fits[where] = -1, False
            # of pairs that share a slot the last one stays, with its own value
            keep = np.unique(where[::-1], return_index=True)
            last = len(where) - 1 - keep[1]
            self.seen_pair[keep[0]], self.seen_fits[keep[0]] = pairs[last], value[last]
        return out

    def _edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of all pieces: start, length, rank."""
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(self.lanes * _LANE, np.uint16)]).astype(np.uint64)
        four = padded[: n + (self.lanes - 1) * _LANE] << 48 | padded[1 : n + 1 + (self.lanes - 1) * _LANE] << 32 | padded[2 : n + 2 + (self.lanes - 1) * _LANE] << 16 | padded[3 : n + 3 + (self.lanes - 1) * _LANE]
        starts = np.flatnonzero(symbols)
        keys = [four[starts + k * _LANE] for k in range(self.lanes)]
        order = np.lexsort(keys[::-1])
        suffixes, keys = starts[order], [k[order] for k in keys]

        def bound(want: list[np.ndarray], after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), len(suffixes))
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(suffixes) - 1)
                less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
                for have, w in zip(keys, want):
                    x = have[mid]
                    less |= same & (x < w)
                    same &= x == w
                right = (less | same if after else less) & (lo < hi)
                lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
            return lo

        first, end = bound(self.low, False), bound(self.high, True)
        count = end - first
        total = int(count.sum())
        which = np.repeat(np.arange(len(count)), count)
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + first[which]
        # numbers of 32 bits from here on: the edges are the largest arrays
        return suffixes[at].astype(np.int32), self.lengths[which].astype(np.int32), self.matched[which].astype(np.int32)

    def _index(self, chunks: list[str]) -> None:
        """Segment new chunks together and remember them."""
        text = "\0".join(MARK + c for c in chunks) + "\0"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(c) + 1 for c in chunks])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        symbols = self.symbol[code]
        inside = np.ones(len(code), bool)
        inside[begin + size] = False
        symbols[~inside] = 0
        start, length, piece = self._edges(symbols)
        lone = np.flatnonzero((symbols == 0) & inside).astype(np.int32)
        start, length, piece = np.concatenate([start, lone]), np.concatenate([length, np.ones(len(lone), np.int32)]), np.concatenate([piece, np.full(len(lone), -1, np.int32)])
        offset = (start - np.repeat(begin, size + 1)[start]).astype(np.int32)
        order = np.argsort(offset, kind="stable")
        start, length, piece, offset = start[order], length[order], piece[order], offset[order]
        last, back = np.full(len(code) + 1, -2, np.int64), np.zeros(len(code) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(offset, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(offset)]):
            s, p = start[a:b], piece[a:b]
            if offset[a] == 0:
                ok = slice(None)
            else:
                ok = np.flatnonzero(last[s] > -2)
                ok = ok[self.fits(last[s[ok]], p[ok].astype(np.int64))]
            end = s[ok] + length[a:b][ok]
            last[end], back[end] = p[ok], s[ok]
        # walk back from every chunk's end
        who, at, found_who, found_piece, found_at = np.arange(len(chunks)), begin + size, [], [], []
        while len(who):
            if (last[at] == -2).any():
                raise AssertionError("a chunk has no segmentation")
            found_who.append(who)
            found_piece.append(last[at])
            at = back[at]
            found_at.append(at)
            more = at > begin[who]
            who, at = who[more], at[more]
        who, piece, at = map(np.concatenate, (found_who, found_piece, found_at))
        order = np.lexsort((at, who))
        who, piece, at = who[order], piece[order], at[order]
        ids = np.where(piece >= 0, self.ids[piece], -1).astype(np.int32)
        ends = np.cumsum(np.bincount(who, minlength=len(chunks)))
        raw = ids.tobytes()
        odd = set(who[piece < 0].tolist())
        lo = 0
        for k, hi in enumerate(ends.tolist()):
            value = raw[4 * lo : 4 * hi]
            if k in odd:
                out: list[int] = []
                for i, x in zip(ids[lo:hi].tolist(), at[lo:hi].tolist()):
                    out += [i] if i >= 0 else [self.byte_ids[b] for b in chr(int(code[x])).encode("utf-8", "surrogatepass")]
                value = np.array(out, dtype=np.int32).tobytes()
            self.chunks[chunks[k]] = value
            lo = hi

    @staticmethod
    def chunks_of(text: str) -> list[str]:
        """The chunks of a text, each without its first mark."""
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        texts = list(texts)
        cut = list(map(self.chunks_of, texts))
        new: dict[str, None] = {}
        waiting = 0
        known = self.chunks
        fresh: list[str] = []
        if len(known) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        for chunks in cut:
            for c in chunks:
                if c not in known and c not in new:
                    new[c] = None
                    waiting += len(c) + 2
            if waiting >= INDEX_CHARS:
                self._index(list(new))
                fresh += new
                new, waiting = {}, 0
        if new:
            self._index(list(new))
            fresh += new
        out = [np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32) for chunks in cut]
        for c in fresh:
            if len(c) > CACHE_LENGTH:
                del known[c]
            else:
                self.held += sys.getsizeof(c) + sys.getsizeof(known[c])
        return out


class PieceBytes:
    """What each piece id stands for; all that decoding needs."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def plain(i: int) -> bytes:
            if sp.is_byte(i):
                return bytes([int(sp.id_to_piece(i)[3:5], 16)])
            return b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).encode()

        self.bytes_of = [plain(i) for i in range(sp.get_piece_size())]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> PieceBytes:
    return PieceBytes(path)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One per Python worker and model file."""
    return PieceModel(path)


#: Texts encoded together: their new chunks share suffix arrays, and so many rows leave a worker at a time.
_BATCH = 500


def _pieces_of(texts: pd.Series) -> Iterator[pd.Series]:
    return (texts.iloc[i : i + _BATCH] for i in range(0, len(texts), _BATCH))


def encode_documents(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``ids``, the piece ids of each whole text, without begin or end pieces. ``model_path`` names a file that every executor can open."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = model(model_path)
        for texts in batches:
            for part in _pieces_of(texts):
                yield pd.Series(codec.encode(part), dtype=object)

    return docs.withColumn("ids", ids(text_or_empty(F.col(text))))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """Add ``decoded``, the text of each row's ``ids``; a null array gives the empty text."""

    @F.pandas_udf(StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = piece_bytes(model_path)
        for rows in batches:
            for part in _pieces_of(rows):
                yield pd.Series([codec.decode(x.tolist()) for x in part], dtype=object)

    return encoded.withColumn("decoded", decoded(F.coalesce(F.col("ids"), F.array().cast("array<int>"))))


def encode_and_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``decoded`` as the two functions above do, in one pass of one worker."""

    @F.pandas_udf("ids array<int>, decoded string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec, back = model(model_path), piece_bytes(model_path)
        for texts in batches:
            for part in _pieces_of(texts):
                ids = codec.encode(part)
                yield pd.DataFrame({"ids": ids, "decoded": [back.decode(x.tolist()) for x in ids]})

    own = docs.withColumn("__coded", coded(text_or_empty(F.col(text))))
    return own.withColumn("ids", F.col("__coded.ids")).withColumn("decoded", F.col("__coded.decoded")).drop("__coded")
