"""SimHash near-duplicates by vantage-point trees (operator 7).

A fingerprint has a bit for each bit that is set in over half of the XXH64
hashes of the text's word shingles. Copies of a fingerprint are one node. A
vantage-point tree over a bounded sample cuts the Hamming space into shards: at
each inner node the fingerprints within ``mu`` of the vantage point go left and
the others right. A fingerprint is a member of one shard and a visitor of the
later shards that the triangle bound can't exclude: members left of a vantage
point v are within ``mu`` of it, so a visitor with d(x, v) > mu + radius has no
partner there, and on the right one with d(x, v) <= mu - radius has none. Each shard
compares its members with each other and with its visitors, exactly.

Shards are dealt as packed blocks of bounded size and compared block by block,
so a shard that cannot be split (near copies by the thousand) costs more block
pairs, not a larger task. A block pair returns only links that join parts that
were apart before, not all links, so a dense group gives no square of links.

Defined results: a null or blank text has fingerprint zero, which links like any
other; a null ``doc_id`` is never the component's name while another id is there.

On fingerprints that lie at random the bound keeps 87 of 100 shards per level
at radius 4, so the search costs about n**1.8; no metric tree does better there. The tree
is ``MAX_DEPTH`` levels deep at most, enough for 500 million distinct fingerprints in shards of
``SHARD_ROWS``; beyond, shards are larger and their blocks more, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._common import materialize, text_or_empty
from .components import connected_components, named_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members aimed at per shard, fingerprints in a block, most levels of the tree and sampled fingerprints per shard: the sample is at most 524,288 fingerprints, 4 MB.
SHARD_ROWS, BLOCK_ROWS, MAX_DEPTH, SAMPLE_PER_SHARD = 8192, 16384, 16, 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # of bytes: lower() changes A-Z only, split() cuts at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = [*accumulate(map(len, words), lambda a, n: a + 1 + n)]
        starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fp``, the fingerprint's 64 bits as a long."""
    return docs.withColumn("fp", _fingerprints(text_or_empty(F.col(text))))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class VantageTree:
    """Vantage points of a complete binary tree in heap order; shards are its leaves from left to right."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        inner = (1 << depth) - 1
        self.points, self.mu = np.zeros(inner, np.uint64), np.zeros(inner, np.int64)
        parts = {0: sample}
        for node in range(inner):
            part = parts.pop(node)
            if len(part):
                tries = part[: min(len(part), 8)]  # of a few, the point that spreads the others widest
                spread = [np.bitwise_count(part ^ p).std() for p in tries]
                self.points[node] = tries[int(np.argmax(spread))]
                d = np.bitwise_count(part ^ self.points[node]).astype(np.int64)
                self.mu[node] = int(np.median(d))
                left = d <= self.mu[node]
            else:
                left = np.zeros(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = part[left], part[~left]

    def route(self, fps: np.ndarray, radius: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """Members and visitors of each shard, as positions in ``fps``."""
        members: dict[int, np.ndarray] = {}
        visitors: dict[int, np.ndarray] = {}
        none = np.zeros(0, np.int64)
        todo = [(0, np.arange(len(fps)), none)]
        while todo:
            node, home, guest = todo.pop()
            if node >= len(self.points):
                shard = node - len(self.points)
                if len(home):
                    members[shard] = home
                if len(guest):
                    visitors[shard] = guest
                continue
            d_home = np.bitwise_count(fps[home] ^ self.points[node]).astype(np.int64)
            d_guest = np.bitwise_count(fps[guest] ^ self.points[node]).astype(np.int64)
            mu = self.mu[node]
            over = home[(d_home <= mu) & (d_home > mu - radius)]  # at home on the left, near enough to visit the right
            for child, own, near in ((2 * node + 1, d_home <= mu, guest[d_guest <= mu + radius]), (2 * node + 2, d_home > mu, np.concatenate([guest[d_guest > mu - radius], over]))):
                if own.any() or len(near):
                    todo.append((child, home[own], near))
        return members, visitors


def joining_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` from block a to block b that suffice to connect what all such links connect. ``same``: a is b."""
    part = np.arange(len(b))  # which of b are connected already
    out_u: list[np.ndarray] = []
    out_v: list[np.ndarray] = []
    for i in range(0, len(a), 64):
        rows, base = a[i : i + 64], i if same else 0  # within one block each pair is looked at once
        near = np.empty((len(rows), len(b) - base), bool)
        for j in range(0, near.shape[1], 4096):
            np.less_equal(np.bitwise_count(rows[:, None] ^ b[None, base + j : base + j + 4096]), radius, out=near[:, j : j + 4096])
        if same:
            near[np.tril_indices(len(rows), 0, near.shape[1])] = False
        for k in np.flatnonzero(near.any(axis=1)):
            hits = np.flatnonzero(near[k]) + base
            parts, first = np.unique(part[hits], return_index=True)
            mine = part[i + k] if same else -1
            new = parts != mine
            if not new.any():
                continue
            out_u.append(np.full(int(new.sum()), rows[k]))
            out_v.append(b[hits[first[new]]])
            joined = np.append(parts, mine) if same else parts
            if len(joined) > 1:
                part[np.isin(part, joined)] = joined.min()
    if not out_u:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_u), np.concatenate(out_v)


def _packed(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.uint64)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between distinct fingerprints, enough of them to give the same components as all links.

    ``nodes`` is a written table with distinct longs ``fp``.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    depth = max(1, min(MAX_DEPTH, int(np.ceil(np.log2(n / SHARD_ROWS))))) if n > SHARD_ROWS else 0
    # a bounded sample, by a hash order that no run changes
    sample = nodes.select("fp").orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(max(64, SAMPLE_PER_SHARD << depth)).toPandas()["fp"]
    tree = spark.sparkContext.broadcast(VantageTree(sample.to_numpy(np.int64).view(np.uint64), depth))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for kind, found in zip(("m", "v"), tree.value.route(fps, radius)):
                if found:
                    yield pd.DataFrame({"shard": list(found), "kind": kind, "n": [len(x) for x in found.values()], "fps": [fps[x].tobytes() for x in found.values()]})

    dealt = materialize(nodes.select("fp").mapInPandas(deal, "shard int, kind string, n long, fps binary"), "simhash-shards")

    # pieces of a shard go to blocks by a running count; the pieces are few, each from one batch of rows
    running = F.sum("n").over(Window.partitionBy("shard", "kind").orderBy(F.xxhash64("fps"), "fps").rowsBetween(Window.unboundedPreceding, 0))
    blocks = dealt.withColumn("block", F.floor((running - 1) / BLOCK_ROWS)).groupBy("shard", "kind", "block").agg(F.collect_list("fps").alias("fps"))
    blocks = materialize(blocks, "simhash-blocks")
    b = blocks.where("kind = 'm'").select("shard", F.col("block").alias("block_b"), F.col("fps").alias("b"))
    a = blocks.select("shard", "kind", F.col("block").alias("block_a"), F.col("fps").alias("a"))
    pairs = a.join(b, "shard").where("kind = 'v' OR block_a <= block_b").withColumn("same", F.col("kind").eqNullSafe("m") & (F.col("block_a") == F.col("block_b")))
    spread = max(spark.sparkContext.defaultParallelism, 1 << depth)
    pairs = pairs.repartition(spread, "shard", "kind", "block_a", "block_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y, same in zip(batch["a"], batch["b"], batch["same"]):
                u, v = joining_links(_packed(x), _packed(y), bool(same), radius)
                if len(u):
                    yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.select("a", "b", "same").mapInPandas(compare, "u long, v long")


def component_ids(fingerprinted: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (fp, root, component_id) for every fingerprint of a written table with ``doc_id`` and ``fp``; ``root`` is the least fingerprint and the id the least ``doc_id`` that links reach."""
    nodes = materialize(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = connected_components(fingerprint_links(nodes, radius), "simhash-components")
    named = materialize(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left"), "simhash-named")
    return named_components(named, "least").select("fp", F.coalesce("root", "fp").alias("root"), "component_id")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) for every row of ``docs``."""
    printed = materialize(with_fingerprints(docs.select("doc_id", F.col(text).alias("__text")), "__text").select("doc_id", "fp"), "simhash-fingerprints")
    return printed.join(component_ids(printed), "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component: the one whose ``doc_id`` names it. Of rows that share that id (or have none) the least text stays, once."""
    printed = materialize(with_fingerprints(docs.select("doc_id", F.col(text).alias("__text")), "__text").select("doc_id", "fp"), "simhash-fingerprints")
    names = materialize(component_ids(printed), "simhash-names")
    if printed.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() == 0:
        # ids name rows: only the ids to drop travel, not the texts
        lost = printed.join(names, "fp").where("doc_id <> component_id").select("doc_id")
        return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
    # ids don't name rows, and components may share one: the root names the component
    boxed = with_fingerprints(docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.col(text).alias("__text")), "__text").join(names, "fp")
    own = boxed.where(F.col("__id").eqNullSafe(F.col("component_id")))
    first = Window.partitionBy("root").orderBy("__text", F.xxhash64("__row"))
    return own.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__row.*")
