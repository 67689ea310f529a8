"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least, "u").where("v != m").select("m", "v")
    return to_least.unionByName(least.select("m", F.col("u").alias("v"))).toDF("u", "v").distinct()


def _not_stars(edges: DataFrame) -> int:
    """Number of nodes that hang on two others, or on one while others hang on them."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("over"), F.lit(0).alias("under"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("over"), F.lit(1).alias("under")))
    counts = ends.groupBy("node").agg(F.max("over").alias("over"), F.sum("under").alias("under"))
    return counts.where("under > 1 or under = 1 and over = 1").count()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node of edges (u, v): root is the smallest node it can reach.

    Each round hangs neighbours on the smallest one; the edges become stars after about log(n) rounds.
    Minima are combined on the map side, so a node with very many edges does not burden one task. Loops and
    repeated edges change nothing; no edges give no rows.
    """
    stars = cut(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while _not_stars(stars):
        stars = cut(_small_star(_large_star(stars)))
    roots = stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("u").alias("root")))
