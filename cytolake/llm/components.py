"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star steps (Kiveris and others, 2014), each an
aggregation and an equi-join, until the edges are stars around the smallest node of
each component.  Nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm.common import dropped, staged


def _stars(edges: DataFrame) -> bool:
    """Whether the edges ``u, v`` are stars: every ``u`` has one, and is no other's ``v``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not ends.where(F.col("out") + F.col("into") > 1).where("out > 0").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, component`` of every node with an edge; ``edges`` has two bigint columns, without nulls.

    Rows with equal ends are allowed and ignored.  A node without another is not in the result.
    """
    a, b = edges.columns[:2]
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(nxt.sparkSession, now)
        now = nxt
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, component`` after further links ``a, b``, from those (:func:`connected_components`) before them.

    Only the graph of components is solved anew. Nodes without a label yet are components of their own.
    """
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    between = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    over = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    known = labels.join(over, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = over.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
    return staged(known.unionByName(new), "labels")
