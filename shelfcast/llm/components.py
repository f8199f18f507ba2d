"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link to another node; root is its component's smallest.

    Each round links the larger neighbours of a node to its smallest one, then the smaller
    neighbours likewise, until every node hangs on its root. Minima are taken in partial
    aggregates and joins carry no hint, so Spark can split a node with very many links.
    """
    a, b = F.col(left), F.col(right)
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = saved(edges.distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.distinct(), "large")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").filter("v != m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small, "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
