"""Merkle manifest of a dataset (operator 13), in DataFrame functions and one recursive query.

Every row is a leaf. The leaves of a language stand in order of id; runs of ``FAN`` nodes are hashed into one until a
language has one node, its subroot; the subroots make a tree of their own, up to the root. Every level is written down,
and the built levels become parent-linked node rows: a run with the digests of its nodes, the run above it and the place
in that run. A recursive query then climbs from every leaf: each step appends a row with the leaf's siblings in the run
and the hash folded so far. Siblings are kept per step, not as one growing text, so a leaf costs as much as its depth.

Leaves of a language are numbered by ranges of ids and running counts over the ranges, so no task needs a whole language.
Everyone climbs through the upper runs, so a run over more than ``BLOCK`` leaves is listed once for each block of them:
at most ``BLOCK`` leaves meet in a key of the climb's join, whatever the size of the tree.

Defined results: nulls count as ``-`` and stand first; rows with one id stand in order of their leaves (equal rows are
interchangeable); an empty text is ``0:``; a null id is never tampered with; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import CRC32_CTES, buckets_for, crc32_sql, materialize

FAN, BLOCK = 8, 8**4
_TOP = -1  # the tree of the subroots
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def tampered() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def leaves(docs: DataFrame) -> DataFrame:
    """A written table (tree, place, size, doc_id, leaf, start): ``place`` counts the leaves of a language, ``start`` is the leaf that the climb starts from."""
    text = F.col("text").cast("string")
    changed = leaf(F.translate(text, _UPPER, _LOWER))
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(text).alias("leaf"), F.when(tampered(), changed).alias("start"), F.monotonically_increasing_id().alias("tie"))
    own = materialize(own.withColumn("start", F.coalesce("start", "leaf")), "merkle-leaves")
    order = ["lang", "doc_id", "leaf", "tie"]
    ranges = materialize(own.repartitionByRange(buckets_for(own.count()), *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")

    # a row per part and language; few of them, as a part is a range
    counts = ranges.groupBy("part", "lang").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy("lang")))
    shifts = shifts.withColumn("tree", F.dense_rank().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1)
    shifts = shifts.select(F.col("part").alias("__part"), F.col("lang").alias("__lang"), "before", "size", F.col("tree").cast("long").alias("tree"))
    inside = Window.partitionBy("part", "lang").orderBy("doc_id", "leaf", "tie")
    placed = ranges.withColumn("k", F.row_number().over(inside) - 1).join(shifts, (F.col("part") == F.col("__part")) & F.col("lang").eqNullSafe(F.col("__lang")))
    return materialize(placed.select("tree", (F.col("before") + F.col("k")).alias("place"), "size", "doc_id", "leaf", "start"), "merkle-places")


def levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hash ``nodes`` (tree, place, size, digest) upwards, ``size`` being the number of nodes in the tree.

    Returns the runs of all levels (tree, level, run, of, children), ``of`` being how many runs the level has, and what
    remains of every tree (tree, depth, digest). Levels are written down one by one and shrink by ``FAN``.
    """
    runs, tops, level = [], [], 0
    now = nodes
    while True:
        tops.append(now.where("size = 1").select("tree", F.lit(level).alias("depth"), "digest"))
        found = now.agg(F.max("size").alias("most"), F.count("*").alias("n")).first()
        if (found["most"] or 0) <= 1:
            break
        level += 1
        members = now.where("size > 1").groupBy("tree", F.floor(F.col("place") / FAN).alias("run"), F.ceil(F.col("size") / FAN).alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("m"))
        made = members.select("tree", F.lit(level).alias("level"), "run", "of", F.col("m.digest").alias("children"))
        made = materialize(made.coalesce(buckets_for(found["n"], 20_000, 1)), "merkle-level")  # small levels need few tasks
        runs.append(made)
        now = made.select("tree", F.col("run").alias("place"), F.col("of").alias("size"), F.sha2(F.array_join("children", ""), 256).alias("digest"))
    none = "tree long, level int, run long, of long, children array<string>"
    every = nodes.sparkSession.createDataFrame([], none)
    for r in runs:
        every = every.unionByName(r)
    remains = tops[0]
    for t in tops[1:]:
        remains = remains.unionByName(t)
    return every, materialize(remains, "merkle-tops")


def node_rows(runs: DataFrame, trees: DataFrame, top_runs: DataFrame, top_depth: int) -> DataFrame:
    """A written table of runs as a climb from a leaf meets them: (tree, block, level, run, children, up, place).

    ``trees`` has (tree, size, depth). Levels of the subroots' tree follow those of a language's own; ``up`` is the run
    of the next level and ``place`` the place in it, both null at the root. A run is listed for each block of leaves under it.
    """
    width = F.pow(F.lit(float(FAN)), F.col("level")) / BLOCK  # blocks that a run covers, or which part of one
    last = F.floor((F.col("size") - 1) / BLOCK)
    own = runs.join(trees, "tree")
    own = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("run") * width), F.least(F.greatest(F.floor((F.col("run") + 1) * width) - 1, F.floor(F.col("run") * width)), last))))
    ends = F.col("level") == F.col("depth")
    at = F.when(ends, F.col("tree")).otherwise(F.col("run"))  # where the run stands among its own kind
    own = own.select("tree", "block", "level", "run", "children", F.when(~ends | F.lit(top_depth > 0), F.floor(at / FAN)).alias("up"), F.when(~ends | F.lit(top_depth > 0), at % FAN).alias("place"))
    blocks = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    above = blocks.withColumn("__step", F.explode(F.sequence(F.lit(1), F.lit(max(top_depth, 1))))).withColumn("__run", F.floor(F.col("tree") / F.pow(F.lit(float(FAN)), F.col("__step"))))
    shared = top_runs.select(F.col("level").alias("__step"), F.col("run").alias("__run"), "children")
    more = F.col("__step") < top_depth
    above = above.join(shared, ["__step", "__run"]).select(
        "tree", "block", (F.col("depth") + F.col("__step")).alias("level"), F.col("__run").alias("run"), "children", F.when(more, F.floor(F.col("__run") / FAN)).alias("up"), F.when(more, F.col("__run") % FAN).alias("place")
    )
    return materialize(own.unionByName(above), "merkle-nodes")


_CLIMB = """
WITH RECURSIVE climb(tree, place, block, level, run, k, folded, siblings) AS (
  SELECT tree, place, block, 0, run, k, start, CAST('' AS BINARY) FROM {starts}
  UNION ALL
  SELECT c.tree, c.place, c.block, c.level + 1, n.up, n.place,
    sha2(array_join(transform(n.children, (x, i) -> if(i = c.k, c.folded, x)), ''), 256),
    unhex(array_join(filter(n.children, (x, i) -> i <> c.k), ''))
  FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.block = c.block AND n.level = c.level + 1 AND n.run = c.run
)
SELECT tree, place, level, folded, siblings FROM climb
"""


#: A climb makes a row per leaf and level, and the engine's guard against endless recursion counts rows. All levels come in as
#: many partitions as the last, which is empty and would be made one.
_CONF = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@contextmanager
def _climbing(spark: SparkSession):
    was = {name: spark.conf.get(name) for name in _CONF}
    for name, value in _CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def climb(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """A written table (tree, place, folded_root, proof_sha256) for every row of ``starts`` (tree, place, block, run, k, start).

    The steps of the recursive query (level 0 for the leaf, one for each run above it) go into these rows as they are; they are not written down.
    """
    spark = starts.sparkSession
    names = {"starts": "merkle_starts", "nodes": "merkle_nodes"}
    starts.createOrReplaceTempView(names["starts"])
    nodes.createOrReplaceTempView(names["nodes"])
    try:
        with _climbing(spark):
            steps = spark.sql(_CLIMB.format(**names))
            proofs = steps.groupBy("tree", "place").agg(F.max_by("folded", "level").alias("folded_root"), F.array_sort(F.collect_list(F.struct("level", "siblings"))).alias("s"))
            told = F.sha2(F.array_join(F.transform("s", lambda x: F.lower(F.hex(x["siblings"]))), ""), 256)
            return materialize(proofs.select("tree", "place", "folded_root", told.alias("proof_sha256")), "merkle-proofs")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def manifest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``."""
    placed = leaves(docs)
    runs, subroots = levels(placed.select("tree", "place", "size", F.col("leaf").alias("digest")))
    trees = materialize(subroots.join(placed.groupBy("tree").agg(F.max("size").alias("size")), "tree").select("tree", "size", "depth", F.col("digest").alias("subroot")), "merkle-trees")
    n_trees = trees.count()
    top_runs, remains = levels(trees.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("size"), F.col("subroot").alias("digest")))
    top = remains.first()
    root, top_depth = (top["digest"], top["depth"]) if top else (None, 0)
    nodes = node_rows(runs, trees.drop("subroot"), top_runs, top_depth)

    alone = F.col("size") == 1  # a lone leaf stands among the subroots
    at = F.when(alone, F.col("tree")).otherwise(F.col("place"))
    starts = placed.select("tree", "place", F.floor(F.col("place") / BLOCK).alias("block"), F.floor(at / FAN).alias("run"), (at % FAN).alias("k"), "start")
    proofs = climb(starts, nodes)
    return (
        placed.join(proofs, ["tree", "place"])
        .join(trees.select("tree", "subroot"), "tree")
        .select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
    )


def _sql(own_levels: int = 7, top_levels: int = 3) -> str:
    """The same rows for trees of at most ``FAN ** own_levels`` leaves and ``FAN ** top_levels`` languages, level by level."""
    bytes_of = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    hashed = lambda t: "sha256(" + " || ".join(map(bytes_of, ("doc_id", "source", "lang", "n_chars", t))) + ")"
    ctes = [
        CRC32_CTES,
        f"h AS (SELECT doc_id, lang, {hashed('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {hashed(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM documents, crc)",
        "d AS (SELECT *, coalesce(changed, leaf) AS folded, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, coalesce(changed, leaf)) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM h)",
        "n0 AS (SELECT tree, place, size, leaf AS digest FROM d)",
        "c0 AS (SELECT doc_id, leaf, tree, tree AS own, place, folded, '' AS proof FROM d)",
    ]

    def rise(k: int) -> None:
        ctes.append(f"r{k} AS (SELECT tree, place // {FAN} AS run, ceil(size / {FAN})::BIGINT AS size, list(digest ORDER BY place) AS m FROM n{k - 1} WHERE size > 1 GROUP BY ALL)")
        ctes.append(f"n{k} AS (SELECT tree, run AS place, size, sha256(array_to_string(m, '')) AS digest FROM r{k})")
        ctes.append(
            f"""c{k} AS (SELECT doc_id, leaf, c.tree, own, coalesce(run, place) AS place,
    CASE WHEN m IS NULL THEN folded ELSE sha256(array_to_string(list_transform(m, lambda x, i: CASE WHEN i = place % {FAN} + 1 THEN folded ELSE x END), '')) END AS folded,
    CASE WHEN m IS NULL THEN proof ELSE proof || array_to_string(m[:place % {FAN}] || m[place % {FAN} + 2:], '') END AS proof
  FROM c{k - 1} c LEFT JOIN r{k} r ON r.tree = c.tree AND r.run = c.place // {FAN})"""
        )

    for k in range(1, own_levels + 1):
        rise(k)
    ctes.append("s AS (" + " UNION ALL ".join(f"SELECT tree, digest FROM n{k} WHERE size = 1" for k in range(own_levels + 1)) + ")")
    first = own_levels + 1
    ctes.append(f"n{first} AS (SELECT {_TOP} AS tree, tree AS place, count(*) OVER () AS size, digest FROM s)")
    ctes.append(f"c{first} AS (SELECT doc_id, leaf, {_TOP} AS tree, own, own AS place, folded, proof FROM c{own_levels})")
    for k in range(first + 1, first + top_levels + 1):
        rise(k)
    last = first + top_levels
    ctes.append("t AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM n{k} WHERE size = 1" for k in range(first, last + 1)) + ")")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM c{last} c JOIN s ON s.tree = c.own, t"


ORACLE_SQL = _sql()
