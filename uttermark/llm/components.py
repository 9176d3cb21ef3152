"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.llm.common import attach, checkpointed

MOST_ROUNDS = 100


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long): root is the smallest node that can be reached.

    Each round joins every node's larger neighbours to its smallest one, then every node with its smaller
    neighbours to the smallest of them, until nothing changes; the number of rounds grows with the logarithm
    of the longest path.  Smallest neighbours are pre-aggregated before their shuffle, and hubs go through
    the join whose hot keys are proven few.  Lineage is cut each round with a reliable checkpoint.  An empty
    link table gives an empty result; links of a node with itself say nothing and are left out.
    """
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = checkpointed(pairs)
    seen = _mark(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = attach(both, least, "u", "n", 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = attach(large, least, "u", "n", seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
