"""Connected components of an edge table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import durable


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): every v with the least of u and all of u's v. A hub's pairs are reduced
    before they are shuffled, and the join back is one that Spark splits where a hub is hot."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its least reachable node.

    Large-star and small-star rounds (Kiveris et al., 2014) until the edges no longer change, at
    which point each node hangs on its component's minimum. An empty table gives no rows; self
    loops, nulls and repeated edges add nothing.
    """
    now = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, seen = None, state(now)
    while seen != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _to_minimum(large)
        small = joined.select("v", "m").union(joined.select("u", "m")).where("v != m").distinct()
        now = durable(small.toDF("u", "v"))
        before, seen = seen, state(now)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v"), F.col("v"))).groupBy("node").agg(F.min("component").alias("component"))
