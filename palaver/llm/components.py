"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v.

    Large: every neighbour above a node is linked to the least of its neighbourhood. Small: every neighbour
    below it, and the node itself, are. The least neighbour is an aggregate that combines on the map side, and the
    join back is many-to-one, so a node with very many neighbours is never gathered.
    """
    if large:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = around.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        linked = around.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the links (a, b); the component is the least id in it.

    Null ends and loops are left out. Each round is written out, so a lost executor repeats one round at most; the loop ends
    when a round changes nothing, which is compared by count and sum of hashes.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = durable(edges), None
    for _ in range(rounds):
        edges = durable(_star(_star(edges, large=True), large=False))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
