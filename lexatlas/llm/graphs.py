"""Joins that hold up under hot keys, and connected components, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.sources.workspace import materialize

#: A key with more than 1 / HOT_PARTS of all rows is joined by broadcast: there are fewer than HOT_PARTS such keys.
HOT_PARTS = 1000


def join_counted(rows: DataFrame, unique: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once, and in column n how many rows have it.

    Keys that hold more than 1 / HOT_PARTS of the `total` rows would fill one task; they are broadcast instead, and
    arithmetic bounds their number. All other keys are joined by Spark's choice.
    """
    hot = max(1, total // HOT_PARTS)
    often = unique.where(F.col("n") > hot)
    seldom = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(often.drop("n")), keys).unionByName(seldom.join(unique.where(F.col("n") <= hot).drop("n"), keys))


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, root) of each node of the edges (a, b): nodes have the same root exactly if they are connected.

    Each round hooks every node to its smallest neighbour if that is smaller, shortens the chains, and replaces the
    edges by those between the images; at least half of the nodes that still have edges go in each round, so rounds are
    logarithmic in the largest component. Tables are written between steps; nothing but counts reaches the driver.
    """
    left = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "hooks")
        for _ in range(jumps):
            nearer = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            to = materialize(to.join(nearer, "root").select("node", F.col("next").alias("root")), "hooks")
        image = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
        mapped = left.join(image("a"), "a").join(image("b"), "b").where("a_ != b_")
        left = materialize(mapped.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct(), "edges")
        if labels is None:
            labels = to
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if labels is None else labels
