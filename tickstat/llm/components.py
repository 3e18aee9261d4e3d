"""Connected components of a link table, by contraction in random order.

In each round every node takes, of itself and its neighbours, the one with the
smallest hash of (node, round), and the links are rewritten between the nodes
taken. Fresh hashes each round make a path or a star shrink by half on average,
so the rounds grow with the logarithm of the number of nodes, whatever the shape
or the order of the ids. The smallest id that a node stands for is carried
along. A round is two joins and two aggregates, and no node's neighbours are
ever gathered in one place. The rounds' tables are chained back from the last
one to the first, each step written.

Links with a null end and of a node with itself count for nothing. An empty
table gives an empty result; repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has
    a link. ``links`` has two columns of one integer type."""
    a, b = links.columns
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    least = None  # (node, least): the smallest id that each node of this round stands for
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        near = edges.select(F.col("a").alias("node"), order("b").alias("o")).union(edges.select("b", order("a")))
        taken = near.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("o", order("node"))["id"].alias("label"))
        taken = taken.withColumn("least", F.col("node")) if least is None else taken.join(least, "node")
        labels = stored(taken, "labels")
        rounds.append(labels)
        # nodes whose group has no link left are complete with this round
        least = stored(labels.groupBy("label").agg(F.min("least").alias("least")).withColumnRenamed("label", "node"), "least")
        rounds[-1] = labels.select("node", "label")
        left, right = rounds[-1].toDF("a", "la"), rounds[-1].toDF("b", "lb")
        edges = stored(
            edges.join(left, "a").join(right, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        rounds[-1] = rounds[-1].join(least.toDF("label", "component"), "label").select("node", "label", "component")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1].select("node", "component")
    for labels in rounds[-2::-1]:  # a label that goes on takes the component of its own row in the next round
        later = stored(found, "found").toDF("label", "later")
        found = labels.join(later, "label", "left").select("node", F.coalesce("later", "component").alias("component"))
    return found
