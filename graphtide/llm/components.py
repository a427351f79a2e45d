"""Connected components of a link table by alternating large-star and small-star steps, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphtide.llm.common import Store


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) beside m, the least of u and all its v. The least is pre-aggregated, and the join back can be split at a hot u."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the greater neighbours of each node to its least; repeated links are left to the small star."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Takes links with u > v."""
    found = _least(edges)
    return found.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of `links` (a, b) the least node that it reaches. Nodes without a link to another are left out.

    A step is one query, which also counts and sums up its links, so that the end is noticed without reading them again.
    """
    store = Store(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    before = None
    while True:
        seen = Observation()
        edges = store.table(_small_star(_large_star(edges)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        state = (seen.get["n"], seen.get["s"])
        if state == before or not state[0]:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = Store(links.sparkSession).table(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
            store.drop()
            return out
        before = state
