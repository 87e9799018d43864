"""Connected components of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored


def _downhill(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger node u to the smaller v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for each node with a link to another; alternating large and small stars.

    Each round is two aggregations with partial sums and two joins that attach a node's smallest neighbour to its links;
    those of few nodes (by the counted links) are broadcast, so a node with very many links gathers nowhere. A round's
    links are written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    edges = stored(_downhill(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    state = lambda: tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = state()
    while True:
        nodes = 2 * now[0]  # at most
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(sized(least, 24, nodes), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(least, 24, nodes), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(_downhill(small), "links")
        before, now = now, state()
        if now == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
