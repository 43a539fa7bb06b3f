"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumweave.llm import common as C


def connected(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the component's smallest node.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest neighbour;
    the rounds grow with the logarithm of the longest path. Hubs are aggregated by partial minima
    and joined back by a join that can be split, so no task holds a whole neighbourhood. Each
    round is a table in the shared folder.
    """
    edges = C.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("a"), "m").where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))
        edges = C.written(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).collect()[0])
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
