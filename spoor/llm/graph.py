"""Connected components over edge tables of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import discard, staged


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; exclusive or cannot overflow, whatever their number."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex of the undirected edges (u, v) of longs; root is its component's least vertex.

    Each round is one shuffle by vertex for its least neighbour and one join with it; Spark
    may split a vertex with very many edges.  Every round is written to the shared folder.
    """
    e = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _mark(e)
    if not last[0]:
        return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before it is joined: a join of two plain exchanges is one that Spark can split where a vertex is hot
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = staged(small.filter("u <> v").distinct(), "edges")
        discard(e, least, large, low)
        e, mark = new, _mark(new)
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(roots.select("v", F.col("v").alias("root")))
