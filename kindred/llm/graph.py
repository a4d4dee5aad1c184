"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b bigint): component is the smallest node that can be reached.

    Each round hangs nodes on the smallest neighbour of theirs or of their neighbours; a logarithmic number of rounds ends in
    stars. The least neighbour is found with partial sums and joined back, so a node of very many edges is no single task's.
    No edges give no rows.
    """
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum("v").cast("decimal(38,0)").alias("s"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # the large star's edges point to smaller nodes already; the small star hangs all of a node's on their least
        large = table(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = table(small_.distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
