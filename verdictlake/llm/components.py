"""Connected components over a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component), component being the smallest node that can be reached; nodes without links are left out.

    Each step points every node at its smallest neighbour; the number of steps grows as the logarithm of the longest path.
    Steps end in written tables.  Minima combine before the shuffle, and joins on a much-linked node are split by AQE.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    seen = _sum(edges)
    if not seen[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: neighbours above a node move to the least of all its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialize(large, "large")
        # small star: neighbours below a node, and the node, move to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u > v").distinct(), "edges")
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
