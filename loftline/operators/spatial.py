"""Joins by place: tiles around a point, boxes that hold a point."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, TILE_DEG, haversine, in_bounds, tile
from ..session import cut, small
from .retrieval import bucket_topk


def tile_counts(asked: DataFrame, points: DataFrame, reach: int, deg: float = TILE_DEG) -> DataFrame:
    """asked (event_id, lat, lon) with n, the points at most `reach` tiles away; rows that see none are left out.

    Points are counted by tile, the counts are summed around each tile that is asked from, and a row gets the sum of its own
    tile. So no pair of points is made, however many share a tile.
    """
    at = lambda rows: rows.withColumns({"__ta": tile(F.col("lat"), deg), "__tb": tile(F.col("lon"), deg)})
    span, keys = F.sequence(F.lit(-reach), F.lit(reach)), ["__ta", "__tb"]
    counts = at(points).where("__ta is not null and __tb is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    around = counts.withColumn("__a", F.explode(span)).withColumn("__b", F.explode(span))
    around = around.select((F.col("__ta") + F.col("__a")).alias("__ta"), (F.col("__tb") + F.col("__b")).alias("__tb"), "__n")
    sums = cut(around.groupBy(*keys).agg(F.sum("__n").alias("n")))
    return at(asked).join(small(sums), keys).drop(*keys)


#: Sides of the cells that the nearest points are looked for in, as parts of a tile.
PARTS, DIGITS_M = (64, 8), 4


def nearest_points(asked: DataFrame, points: DataFrame, reach: int, k: int, deg: float = TILE_DEG) -> DataFrame:
    """(event_id, other_id, metres, rank): the k points nearest to each asked row, at most `reach` tiles away.

    Metres are rounded; of equal ones the smallest ids come first. Points at one place stand as one with their k smallest ids, and rows
    asked at one place are answered once. Places meet in small cells and those around; who has not k points there that are
    surely nearer than all others meets in larger ones, at last in the tiles themselves. So what is compared grows
    with the places, and not with the rows of a tile times those around it.
    """
    place = ["lat", "lon"]
    first = W.partitionBy(*place).orderBy("event_id")
    ids = points.select("event_id", *place).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    ids = ids.groupBy(*place).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    held = cut(ids.select(F.col("lat").alias("other_lat"), F.col("lon").alias("other_lon"), "ids"))
    open_ = cut(asked.select(*place).distinct())
    best = None
    near = lambda a, b: F.abs(tile(F.col(a), deg) - tile(F.col(b), deg)) <= reach
    metres = F.round(haversine(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon")), DIGITS_M)

    def chosen(pairs: DataFrame) -> DataFrame:
        rows = pairs.select(*place, metres.alias("metres"), F.explode("ids").alias("other_id"))
        w = W.partitionBy(*place).orderBy("metres", "other_id")
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    for part in PARTS:
        side = deg / part
        cell = lambda c: F.floor(F.col(c) / side)  # noqa: E731, B023
        span = F.sequence(F.lit(-1), F.lit(1))
        left = open_.withColumn("__a", F.explode(span)).withColumn("__b", F.explode(span))
        left = left.select(*place, (cell("lat") + F.col("__a")).alias("__ca"), (cell("lon") + F.col("__b")).alias("__cb"))
        pairs = left.join(held.withColumns({"__ca": cell("other_lat"), "__cb": cell("other_lon")}), ["__ca", "__cb"])
        found = cut(chosen(pairs.where(near("lat", "other_lat") & near("lon", "other_lon"))))
        # Points out of the cells around are further than the nearest of their borders: circles of latitude and meridians.
        rest = lambda c: F.least(F.col(c) - (cell(c) - 1) * side, (cell(c) + 2) * side - F.col(c)) * (math.pi / 180)  # noqa: E731, B023
        free = F.least(rest("lat"), F.asin(F.sin(rest("lon")) * F.cos(F.radians("lat")))) * EARTH_M
        sure = found.groupBy(*place).agg(F.max("rank").alias("n"), F.max("metres").alias("far")).where((F.col("n") == k) & (F.col("far") + 2 * 10.0**-DIGITS_M < free))
        settled = found.join(sure.select(*place), place, "left_semi")
        best = settled if best is None else best.unionByName(settled)
        open_ = cut(open_.join(sure.select(*place), place, "left_anti"))
    grid = lambda rows, lat, lon: rows.withColumns({"__ta": tile(F.col(lat), deg), "__tb": tile(F.col(lon), deg)})
    span = F.sequence(F.lit(-reach), F.lit(reach))
    left = grid(open_, *place).withColumn("__a", F.explode(span)).withColumn("__b", F.explode(span))
    left = left.select(*place, (F.col("__ta") + F.col("__a")).alias("__ta"), (F.col("__tb") + F.col("__b")).alias("__tb"))
    best = best.unionByName(chosen(left.join(grid(held, "other_lat", "other_lon"), ["__ta", "__tb"])))
    return asked.join(best, place).select("event_id", "other_id", "metres", "rank")


def scoped_topk(asked: DataFrame, frames: DataFrame, reach: int, k: int, deg: float = TILE_DEG) -> DataFrame:
    """(query_id, ref_id, score, rank): the k frames of highest cosine in the square of tiles around a query's place.

    asked (query_id, vector, lat, lon), frames (ref_id, vector, lat, lon). A query stands in all tiles around it, so both sides
    meet on equal tiles, dealt out in blocks where a tile is hot. A row without a place or with NaN for one is found by nothing and finds nothing.
    """
    span = F.sequence(F.lit(-reach), F.lit(reach))
    placed = lambda rows: rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    at = lambda c: tile(F.col(c), deg)
    left = placed(asked).withColumn("__a", F.explode(span)).withColumn("__b", F.explode(span))
    left = left.select("query_id", "vector", (at("lat") + F.col("__a")).alias("tile_lat"), (at("lon") + F.col("__b")).alias("tile_lon"))
    right = placed(frames).select("ref_id", "vector", at("lat").alias("tile_lat"), at("lon").alias("tile_lon"))
    return bucket_topk(left, right, ["tile_lat", "tile_lon"], k)


def active_sources(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points with each source whose box holds them; a source without a box holds all.

    Sources are a dimension of counted size.
    """
    held = in_bounds(F.col("lat"), F.col("lon"), F.col("lat_min"), F.col("lon_min"), F.col("lat_max"), F.col("lon_max"))
    return points.join(small(boxes), held)
