"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, root) for every node that has a link; ``root`` is the least node of its component.

    ``edges`` has long columns ``u`` and ``v``, in any direction, repeats allowed. Each round runs in the cluster and is
    written down; the rounds end when a round changes nothing, that is when every component is a star.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, name)
    mark = _mark(now)
    while mark[0]:
        before, now = now, materialize(_small_star(_large_star(now)), name)
        was, mark = mark, _mark(now)
        discard(before)  # the next round is written down whole
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def named_components(nodes: DataFrame, least: str, parts: int = 16) -> DataFrame:
    """``nodes`` (a written table with ``root``, null for a node without links, and an id column ``least``) with ``component_id``, the least id of the component.

    A component may hold a third of all nodes, so its rows are dealt to ``parts`` parts, each of which gets the component's name.
    """
    linked, alone = nodes.where("root IS NOT NULL"), nodes.where("root IS NULL")
    names = linked.groupBy("root").agg(F.min(least).alias("component_id")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = linked.withColumn("__part", F.pmod(F.xxhash64(*[c for c in nodes.columns if c != "root"]), F.lit(parts)).cast("int"))
    return dealt.join(names, ["root", "__part"]).drop("__part").unionByName(alone.withColumn("component_id", F.col(least)))
