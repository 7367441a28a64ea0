"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.shared import cut, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: two columns of one orderable type, in any order, repeats and loops allowed.

    Returns (node, component) for every node that has an edge to another node; the component
    is its smallest node. Each round is a table in the shared folder, so lineage stays short
    and a lost executor costs a round at most. A hub's neighbours are never gathered: a
    round takes minima (pre-aggregated) and joins them back (skew-split).
    """
    a, b = edges.columns[:2]
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges")
    n = now.count()
    for _ in range(max_rounds):
        if not n or _stars(now, n):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(small.distinct(), "edges", 2 * n)
        release(now)
        now, n = new, new.count()
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame, n: int) -> bool:
    """Whether every node on the left has one edge and is nowhere on the right: the end."""
    left, right = edges.select("u").distinct(), edges.select(F.col("v").alias("u")).distinct()
    return left.count() == n and left.join(right, "u", "left_semi").isEmpty()
