"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b: long): root is the least node that can be reached.

    Each round, every node points to the least of its neighbours and itself, pointers are followed to the end by doubling, and the links
    between what is then still apart are those of the next, smaller round. Stars take one round, long chains a number that grows with
    the logarithm of their length. Every table is written to the shared folder; the driver learns only whether anything is left. Null
    ends and loops don't count, repeated links count once, no links give no rows.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = followed(cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))))
        rounds.append(up)
        side = lambda c: up.toDF(c, f"root_{c}")
        apart = edges.join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b")
        edges = cut(apart.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        if not edges.limit(1).count():
            break
    out = rounds.pop()
    while rounds:
        up = rounds.pop()
        out = cut(up.join(out.toDF("then", "last"), up.root == F.col("then"), "left").select("node", F.coalesce("last", "root").alias("root")))
    return out


def followed(up: DataFrame) -> DataFrame:
    """(node, root) with every pointer at its end. Pointers lead to lesser nodes, so they have ends."""
    while True:
        ahead = up.toDF("then", "last")
        now = cut(up.join(ahead, up.root == ahead.then).select("node", F.col("root").alias("was"), F.col("last").alias("root")))
        up = now.select("node", "root")
        if not now.where("root <> was").limit(1).count():
            return up
