"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import stored


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node ``u``, itself included."""
    return edges.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``u > v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
    hung = large.join(_least(large), "u")
    small = hung.select(F.explode(F.array(F.struct("u", F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("e"))
    return small.select("e.*").where("u > v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another; the component is its smallest node.

    Alternates large-star and small-star steps until the edge set no longer changes; at the fixpoint each
    node hangs on the least node of its component. Minima are aggregated before the shuffle and joined back,
    so a node of very many edges is split by the skew join. Every round ends in a table in the shared folder.
    Rows with a null end and self edges name no link. Isolated nodes do not appear.
    """
    a, b = F.col(src), F.col(dst)
    now = stored(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark, now = seen, stored(_round(now), "edges")
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
