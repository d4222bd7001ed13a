"""Near-duplicate embeddings by cover trees and dual traversal (operator 1).

Vectors of one label link when their cosine is at least the threshold, which
on unit vectors is a distance of at most ``sqrt(2 - 2 * threshold)``.

Equal vectors of a label are one node. A cover tree over a bounded sample gives the
upper levels: nested nets of halving radii. Each node walks down it, level by
level to the nearest child, until the tree's node gets about a block's worth of its label;
that is its cell, whose covering radius is measured. A cell that the sample can't part further
is cut into blocks at random. Pairs of blocks whose cells the radii keep apart are pruned before
any vector moves. Every block gets its own cover tree once (levels with halving radii,
each node with its covering radius), and for each pair of blocks left a task walks both
trees down together, pruning pairs of nodes with d(p, q) > radius(p) + radius(q) + r;
pairs of leaves are compared exactly in double precision.

A pair of blocks returns a link count per vector and only as many links as
connect the same vectors as all links do, never the square of a dense group.

Defined results: a vector that is null, zero, or holds null or non-finite
components, and a row with a null label or id, has no links and is its own component (null for a null id);
vectors of different lengths never link; rows that share an id are vectors of their own, each with its own links and component.

Cost: every vector is read once per level of the sample's tree. Unrelated vectors of one label in
many dimensions lie about equally far from one another, so no metric bound prunes their blocks and the
comparisons of such a label grow with its square; results stay exact. Beyond ``SAMPLE / LEAF_SAMPLE`` cells
of a label (some four million vectors) blocks are random parts of a cell, and pruning goes on inside them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .components import connected_components, named_components

THRESHOLD = 0.98
#: Nodes aimed at per block, points in a leaf of a block's tree, rows sampled for the upper tree (a fixed number, so a bounded broadcast) and sampled points in one of its leaves.
BLOCK_ROWS, LEAF, SAMPLE, LEAF_SAMPLE = 4096, 64, 16_384, 16
#: Bounds are loosened by this much, far above rounding, so that only the exact comparison decides.
SLACK = 1e-6


def usable(vector: Column, label: Column) -> Column:
    parts = vector.cast("array<double>")
    fine = F.coalesce(F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return fine & label.isNotNull() & F.coalesce(F.exists(parts, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    big = np.abs(rows).max(axis=1, keepdims=True)  # first to the size of one, so that squares neither overflow nor vanish
    rows = rows / big
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class CoverTree:
    """Points are sorted so that a node owns a slice, of which the first point is its centre, and its children are numbered in a row.

    A node within ``dense`` of its centre stays whole: its points are about as near to one another as links reach, so no bound would part them.
    """

    FIELDS = ("radius", "lo", "hi", "first", "count")

    def __init__(self, points: np.ndarray, dense: float = 1e-3, leaf: int = LEAF) -> None:
        self.order, self.points = np.arange(len(points)), points
        nodes: list[list] = []  # radius, lo, hi, first child, number of children
        nodes.append(self._node(0, len(points)))
        todo = [(0, 1.0)]
        while todo:
            node, radius = todo.pop()
            own, lo, hi = nodes[node][:3]
            if hi - lo <= leaf or own <= dense:
                continue
            while radius >= own:
                radius /= 2
            cuts = self._net(lo, hi, radius)
            nodes[node][3:] = len(nodes), len(cuts)
            todo += [(len(nodes) + i, radius / 2) for i in range(len(cuts))]
            nodes += [self._node(x, y) for x, y in zip(cuts, [*cuts[1:], hi])]
        self.points = points[self.order]
        columns = [*zip(*nodes)]
        self.radius = np.array(columns[0], dtype=np.float64)
        self.lo, self.hi, self.first, self.count = (np.array(c, dtype=np.int64) for c in columns[1:])

    def _node(self, lo: int, hi: int) -> list:
        own = self.points[self.order[lo:hi]]
        far = float(np.sqrt(max(0.0, 2 - 2 * float((own @ own[0]).min())))) + SLACK if hi - lo > 1 else 0.0
        return [far, lo, hi, 0, 0]

    def _net(self, lo: int, hi: int, radius: float) -> list[int]:
        """Sort a slice into balls of this radius; each starts with its centre, the first one with the node's own."""
        left, done, cuts = self.order[lo:hi], [], []
        least = 1 - radius * radius / 2
        at = lo
        while len(left):
            inside = self.points[left] @ self.points[left[0]] >= least
            inside[0] = True
            cuts.append(at)
            done.append(left[inside])
            at += len(done[-1])
            left = left[~inside]
        self.order[lo:hi] = np.concatenate(done)
        return cuts

    def pack(self) -> bytes:
        """The shape of the tree, without its points."""
        return b"".join(np.asarray(getattr(self, f), dtype=np.float64).tobytes() for f in self.FIELDS)

    @classmethod
    def unpack(cls, points: np.ndarray, shape: bytes) -> CoverTree:
        """A tree from its points in the tree's order and its packed shape."""
        tree = cls.__new__(cls)
        tree.points = points
        table = np.frombuffer(shape, dtype=np.float64).reshape(len(cls.FIELDS), -1)
        tree.radius = table[0]
        tree.lo, tree.hi, tree.first, tree.count = table[1:].astype(np.int64)
        return tree

    def descend(self, vectors: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector of a label with so many ``rows``, a node on its way down that gets about ``most`` of them, and the distance to its centre.

        Where a level has more children than blocks are wanted (far vectors in many dimensions are each other's neighbours), only
        the first ones of its net take part, and the way ends there.
        """
        cell, share = np.zeros(len(vectors), np.int64), (self.hi - self.lo) / len(self.points)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, own = todo.pop()
            cell[own] = node
            wanted = np.ceil(share[node] * rows[own] / most).astype(np.int64)
            for m in np.unique(wanted[wanted > 1]) if self.count[node] else ():
                on = own[wanted == m]
                kids = self.first[node] + np.arange(min(m, self.count[node]))
                nearest = (vectors[on] @ self.points[self.lo[kids]].T).argmax(axis=1)
                cell[on] = kids[nearest]
                if m > self.count[node]:
                    todo += [(int(kids[k]), on[nearest == k]) for k in np.unique(nearest)]
        dots = np.einsum("ij,ij->i", vectors, self.points[self.lo[cell]])
        return cell, np.sqrt(np.maximum(0, 2 - 2 * dots))


def compare_trees(a: CoverTree, b: CoverTree, threshold: float, same: bool, weight_a: np.ndarray, weight_b: np.ndarray):
    """Weighted link counts of both sides, and joining links as positions (i in a, j in b); positions and weights are in the trees' orders."""
    reach = np.sqrt(2 - 2 * threshold) + SLACK
    count_a, count_b = np.zeros(len(weight_a), np.int64), np.zeros(len(weight_b), np.int64)
    part, links = np.arange(len(weight_b)), []

    def leaves(x: int, y: int) -> None:
        cols = np.arange(b.lo[y], b.hi[y])
        for i in range(int(a.lo[x]), int(a.hi[x]), 256):
            own = np.arange(i, min(i + 256, int(a.hi[x])))
            near = a.points[own[0] : own[-1] + 1] @ b.points[cols[0] : cols[-1] + 1].T >= threshold
            if same:
                near &= own[:, None] != cols[None, :]
            if not near.any():
                continue
            count_a[own] += near @ weight_b[cols]
            if not same:
                count_b[cols] += weight_a[own] @ near
            for k in np.flatnonzero(near.any(axis=1)):
                hits = cols[near[k]]
                parts, first = np.unique(part[hits], return_index=True)
                new = parts != part[own[k]] if same else np.ones(len(parts), bool)
                if new.any():
                    links.extend((own[k], j) for j in hits[first[new]])
                    joined = np.append(parts, part[own[k]]) if same else parts
                    if len(joined) > 1:
                        part[np.isin(part, joined)] = joined.min()

    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        if not a.count[x] and not b.count[y]:
            leaves(x, y)
            continue
        # the two sides go down a level together; a leaf waits for the other side
        xs = a.first[x] + np.arange(a.count[x]) if a.count[x] else np.array([x])
        ys = b.first[y] + np.arange(b.count[y]) if b.count[y] else np.array([y])
        for i in range(0, len(xs), 512):
            own = xs[i : i + 512]
            d = np.sqrt(np.maximum(0, 2 - 2 * a.points[a.lo[own]] @ b.points[b.lo[ys]].T))
            near = d <= a.radius[own, None] + b.radius[ys] + reach
            todo += [(int(own[p]), int(ys[q])) for p, q in zip(*np.nonzero(near))]
    return count_a, count_b, links


def _vectors(parts) -> np.ndarray:
    return unit(np.array([*map(np.asarray, parts)], dtype=np.float64))


_BLOCK = "ids binary, copies binary, points binary, shape binary"


def _tree(block) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    ids, copies = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["copies"], np.int64)
    return CoverTree.unpack(np.frombuffer(block["points"], np.float64).reshape(len(ids), -1), block["shape"]), ids, copies


def link_counts(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """Rows (u, v, n): node u links directly with n more vectors; where v is not null, u and v are connected.

    ``vectors`` is a written table (node, label, vector, copies) of usable, distinct vectors.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    by_length: dict[int, list] = {}
    for r in vectors.select("vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect():
        by_length.setdefault(len(r[0]), []).append(r[0])
    upper = spark.sparkContext.broadcast({k: CoverTree(_vectors(x), reach, LEAF_SAMPLE) for k, x in by_length.items()})

    @F.pandas_udf("cell int, far double")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for column, rows in batches:
            cell, far = np.zeros(len(column), np.int32), np.full(len(column), 2.0)  # a length that the sample has not: one cell
            lengths = column.map(len).to_numpy()
            for k in np.unique(lengths):
                if k in upper.value:
                    at = np.flatnonzero(lengths == k)
                    cell[at], far[at] = upper.value[k].descend(_vectors(column.iloc[at]), rows.to_numpy()[at], block_rows)
            yield pd.DataFrame({"cell": cell, "far": far})

    keys = ["label", "dim", "cell", "salt"]
    sized = vectors.withColumn("dim", F.size("vector"))
    per = sized.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    placed = sized.join(per, ["label", "dim"]).withColumn("at", place("vector", "rows")).select("node", "label", "dim", "vector", "copies", "at.cell", "at.far")
    placed = materialize(placed, "cover-cells")
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("salts"))
    salted = placed.join(cells, ["label", "dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    blocks = salted.groupBy(*keys).agg(F.max("far").alias("far"), F.collect_list(F.struct("node", "copies", "vector")).alias("items"))  # block_rows on average by the salt

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                items = row.pop("items")
                tree = CoverTree(_vectors([x["vector"] for x in items]), reach, leaf)
                ids, copies = (np.array([x[c] for x in items], np.int64)[tree.order].tobytes() for c in ("node", "copies"))
                yield pd.DataFrame([{**row, "ids": ids, "copies": copies, "points": tree.points.tobytes(), "shape": tree.pack()}])

    kinds = dict(blocks.dtypes)
    blocks = materialize(blocks.mapInPandas(plant, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "far")) + ", " + _BLOCK), "cover-blocks")

    @F.pandas_udf("double")
    def between(dim: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        out = np.zeros(len(dim))
        for k in dim.unique():
            if k in upper.value:
                tree, at = upper.value[k], np.flatnonzero(dim == k)
                dots = np.einsum("ij,ij->i", *(tree.points[tree.lo[c.to_numpy()[at]]] for c in (p, q)))
                out[at] = np.sqrt(np.maximum(0, 2 - 2 * dots))
        return pd.Series(out)

    # first the blocks' summaries only: the upper levels of the traversal
    short = blocks.select(*keys, "far")
    other = short.select("label", "dim", F.col("cell").alias("cell_b"), F.col("salt").alias("salt_b"), F.col("far").alias("far_b"))
    met = short.join(other, ["label", "dim"]).where("cell < cell_b OR (cell = cell_b AND salt <= salt_b)")
    met = met.withColumn("apart", between("dim", "cell", "cell_b")).where(F.col("apart") <= F.col("far") + F.col("far_b") + F.lit(reach))
    met = materialize(met.select(*keys, "cell_b", "salt_b"), "cover-pairs")
    # each block goes once to every pair that it is in
    twin = ((F.col("cell") == F.col("cell_b")) & (F.col("salt") == F.col("salt_b"))).alias("twin")
    pair = {"cell_1": "cell", "salt_1": "salt", "cell_2": "cell_b", "salt_2": "salt_b"}
    named = [F.col(c).alias(name) for name, c in pair.items()]
    left = met.select(*keys, *named, twin, F.lit(0).alias("side"))
    right = met.where("cell <> cell_b OR salt <> salt_b").select("label", "dim", F.col("cell_b").alias("cell"), F.col("salt_b").alias("salt"), *named, twin, F.lit(1).alias("side"))
    sides = blocks.join(left.unionByName(right), keys).select("label", "dim", *pair, "side", "twin", "ids", "copies", "points", "shape")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, *rest = pdf.sort_values("side").to_dict("records")
        tree_a, ids_a, weight_a = _tree(one)
        tree_b, ids_b, weight_b = _tree(rest[0]) if rest else (tree_a, ids_a, weight_a)
        n_a, n_b, links = compare_trees(tree_a, tree_b, threshold, bool(one["twin"]), weight_a, weight_b)
        out = [pd.DataFrame({"u": ids[n > 0], "v": pd.array([None] * int((n > 0).sum()), dtype="Int64"), "n": n[n > 0]}) for ids, n in ((ids_a, n_a), (ids_b, n_b))]
        if links:
            i, j = np.array(links).T
            out.append(pd.DataFrame({"u": ids_a[i], "v": pd.array(ids_b[j], dtype="Int64"), "n": np.zeros(len(i), np.int64)}))
        return pd.concat(out)

    return sides.groupBy("label", "dim", *pair).applyInPandas(compare, "u long, v long, n long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label)."""
    fine = usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull()
    # two hashes of 64 bits stand for label and vector, so that vectors need not move to find their equals again
    mark = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit("other"), "embedding", "label").alias("k2")]
    rows = table.select("vec_id", "embedding", "label", fine.alias("fine")).select("*", *mark)
    nodes = rows.where("fine").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("embedding").alias("vector"), F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "cover-nodes")
    found = materialize(link_counts(nodes.select("node", "label", "vector", "copies"), threshold, block_rows, leaf), "cover-links")
    roots = connected_components(found.where("v IS NOT NULL").select("u", "v"), "cover-components")
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    known = nodes.select("node", "k1", "k2", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    named = named_components(materialize(known, "cover-known"), "least")
    facts = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.where("fine").select("vec_id", "k1", "k2").join(facts, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), f AS (
  SELECT rid, vec_id, label, e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), n AS (
  SELECT rid, vec_id, label, list_transform(e, lambda x: x / sqrt(s)) AS e FROM (SELECT *, list_sum(list_transform(e, lambda x: x * x)) AS s FROM f)
), links AS (
  SELECT a.rid AS u, b.rid AS w, b.vec_id FROM n a JOIN n b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) >= {THRESHOLD}::DOUBLE
), reach AS (
  SELECT rid AS u, rid AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w
), c AS (
  SELECT u, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = w GROUP BY u
), d AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c ON c.u = v.rid LEFT JOIN d ON d.u = v.rid
"""
