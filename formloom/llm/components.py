"""Connected components by alternating star rounds, on distributed edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node reachable.

    Each round links every larger neighbour of a node to the smallest of its neighbourhood
    (large star), then every node and its smaller neighbours to the smallest (small star), until
    the edges are stars. Only minima are aggregated, which combine before the shuffle; no list
    of neighbours is gathered. Each round is written to the shared folder, and
    only two sums come to the driver.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = written(edges.where(F.col(a) != F.col(b)).select(low.alias("v"), high.alias("u")).distinct(), "edges")
    state = None
    while True:
        # large star: neighbours both ways; the larger ones go to the smallest
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: edges point down; the node and its smaller neighbours go to the smallest
        with scratch():
            large = written(large, "large")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
            now = written(small, "small", outer=True)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
