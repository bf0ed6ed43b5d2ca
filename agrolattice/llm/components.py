"""Connected components of an edge list, by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Every step is a partially aggregated minimum per node and a join; nothing is collected but
two numbers per round (edge count and hash sum), which tell when the edges stop changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _summary(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it reaches.

    ``a`` and ``b`` are long columns; loops, repeated edges and nulls are ignored; no edges
    give no rows.  ``root`` itself is among the nodes.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct())
    e = materialize(e, "edges")
    seen = _summary(e)
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        e = materialize(_small_star(_large_star(e)), "star")
        now = _summary(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    root = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(root.select(F.col("root").alias("node"), "root").distinct())
