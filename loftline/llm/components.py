"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut


def _rows(edges: DataFrame, *rows: tuple[Column, ...], names: str) -> DataFrame:
    """These rows for each edge. Unlike a union this reads the edges once and keeps a single partition known as one."""
    made = [F.struct(*(c.alias(n) for c, n in zip(row, names.split(), strict=True))) for row in rows]
    return edges.select(F.inline(F.array(*made)))


def _met(edges: DataFrame, least: DataFrame, lone: bool) -> DataFrame:
    """edges with the least node that hangs on their u. Spark does not know the join of two single partitions as one; lone says that it is."""
    met = edges.join(least, "u")
    return met.coalesce(1) if lone else met


def _large_star(edges: DataFrame, lone: bool) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    both = _rows(edges, (u, v), (v, u), names="u v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _met(both.where("v > u"), least, lone).where("v != m").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame, lone: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _met(down, down.groupBy("u").agg(F.min("v").alias("m")), lone)
    return _rows(met, (F.col("m"), F.col("v")), (F.col("m"), F.col("u")), names="u v").where("u != v").distinct()


def _not_stars(edges: DataFrame) -> int:
    """Number of nodes that hang on two others, or on one while others hang on them."""
    none, one = F.lit(0), F.lit(1)
    ends = _rows(edges, (F.col("u"), one, none), (F.col("v"), none, one), names="node over under")
    counts = ends.groupBy("node").agg(F.max("over").alias("over"), F.sum("under").alias("under"))
    return counts.where("under > 1 or under = 1 and over = 1").count()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node of edges (u, v): root is the smallest node it can reach.

    Each round hangs neighbours on the smallest one; the edges become stars after about log(n) rounds.
    Minima are combined on the map side, so a node with very many edges does not burden one task. Loops and
    repeated edges change nothing; no edges give no rows.
    """
    stars = cut(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    parts = max(1, -(-stars.count() // BROADCAST_ROWS))  # no more than its rows need; one of them is not shuffled in any round
    while _not_stars(stars := stars.coalesce(parts)):
        stars = cut(_small_star(_large_star(stars, parts == 1), parts == 1))
    return _rows(stars, (F.col("u"), F.col("u")), (F.col("v"), F.col("u")), names="node root").distinct()
