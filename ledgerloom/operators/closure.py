"""Transitive closure of a tree or graph by joins that double the reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import materialised


class Cyclic(ValueError):
    """A node is its own ancestor."""


def closure(edges: DataFrame, parent: str = "parent", child: str = "child", cycles: str = "error") -> DataFrame:
    """(ancestor, descendant, depth): all pairs with a way down, and the fewest steps it takes.

    After k rounds all pairs up to 2**k steps are known: a shortest way of more steps begins with
    one of exactly 2**k. So a chain of a million takes twenty rounds, each two joins, and each is
    written once. Edges with a null end and repeated edges don't count. A node that is its own
    ancestor is an error; with ``cycles='keep'`` it is a row with the length of its shortest circle.
    """
    pairs = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"), F.lit(1).cast("long").alias("depth"))
    known = materialised(pairs.where("ancestor is not null and descendant is not null").distinct())
    reach = 1
    while True:
        if cycles == "error" and (found := known.where("ancestor = descendant").head(1)):
            raise Cyclic(f"{found[0]['ancestor']} is its own ancestor")
        first = known.where(F.col("depth") == reach).select(F.col("ancestor").alias("from"), F.col("descendant").alias("via"))
        further = first.join(known.withColumnRenamed("ancestor", "via"), "via").select(F.col("from").alias("ancestor"), "descendant", (F.col("depth") + reach).alias("depth"))
        fresh = further.groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")).join(known, ["ancestor", "descendant"], "left_anti")
        fresh = materialised(fresh)
        if fresh.isEmpty():
            return known
        known = materialised(known.unionByName(fresh))
        reach *= 2


def with_root(pairs: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Add ``root`` (the topmost ancestor of a tree's node, itself if it has none) and ``level`` (from 0)."""
    top = pairs.groupBy(F.col("descendant").alias("_d")).agg(F.max_by("ancestor", "depth").alias("_root"), F.max("depth").alias("_level"))
    out = nodes.join(top, F.col(node) == F.col("_d"), "left")
    return out.withColumns({"root": F.coalesce("_root", node), "level": F.coalesce("_level", F.lit(0))}).drop("_d", "_root", "_level")
