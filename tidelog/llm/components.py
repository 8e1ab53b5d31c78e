"""Connected components of a distributed edge table by minimum-neighbour contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long): root is the smallest node it reaches.

    Each round points every node at its smallest neighbour, follows two pointers and replaces nodes by what they
    point at; the smallest node of a component never moves, so it is what remains. Minima are aggregated before
    their shuffle, so a hub of any degree is no hot task. Rounds grow with the logarithm of a component's size;
    every round is cut to the shared folder. No edges: no rows. Loops and repeated edges are ignored.
    """
    live = cut(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-near")
        step = near.alias("x").join(near.alias("y"), F.col("x.root") == F.col("y.node")).select("x.node", F.col("y.root").alias("root"))
        step = cut(step, "cc-step")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
            labels = cut(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-labels")
        to = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
        live = cut(live.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
                   .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "cc-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
