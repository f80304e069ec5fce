"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import hold


def components(links: DataFrame, links_a_task: int = 200_000) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b).

    The steps of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each node's neighbours are
    linked to its smallest one. Only minima are aggregated, so a node with very many links is no burden to one task.
    The links are held between rounds; the number of rounds grows as the logarithm of the longest chain.
    """
    edges = hold(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    last = None
    while True:
        # a checksum tells when a round changed nothing; the count sizes the next round's tasks
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
        if state == last:
            break
        last = state
        edges = hold(_round(edges, state["n"] // links_a_task + 1))
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.unionByName(roots).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))


def _round(edges: DataFrame, tasks: int) -> DataFrame:
    """A large-star and a small-star step over links (a, b) with a > b; few links need few tasks."""
    fit = lambda df: df.coalesce(tasks)
    edges = fit(edges)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = fit(both.groupBy("a").agg(F.min("b").alias("m"))).select("a", F.least("a", "m").alias("m"))
    # large star: larger neighbours of each node go to its smallest neighbour
    large = fit(fit(both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
    # small star: smaller neighbours and the node itself go to the smallest
    least = fit(large.groupBy("a").agg(F.min("b").alias("m")))
    small = fit(large.join(least, "a")).select(F.col("b").alias("x"), "m").where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b"))
    return fit(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
