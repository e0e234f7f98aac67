"""Connected components of an edge table by alternating stars, each round a shuffle or two.

Minima per node are aggregated map-side, so a node with very many edges costs one row a task; its
edges meet their minimum in a join that adaptive execution can split. Every round ends in a reliable
checkpoint, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node with an edge; the label is the least node of its component."""
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if before == seen or not seen["n"]:
            break
        before = seen
        now = cut(_small_star(_large_star(now).distinct()).where("u <> v").distinct())
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
