"""Projection, box, tile and matrix queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import affine, geo
from ..operators import spatial
from ..session import table
from .views import FRAME_H, FRAME_W, SQL_FIXES, SQL_MATRICES, fixes, matrices, matrix, r6



def geo_mercator_roundtrip(spark, sf_dir):
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    return fixes(spark, sf_dir).select(
        "event_id", r6(x, 3).alias("mx"), r6(y, 3).alias("my"), r6(geo.mercator_lat(y)).alias("lat"), r6(geo.mercator_lon(x)).alias("lon"),
        r6(geo.mercator_scale_factor(F.col("lat"))).alias("scale"), geo.utm_zone(F.col("lon")).alias("zone"),
    )


def geo_utm_roundtrip(spark, sf_dir):
    """Degrees of error of the way to UTM and back; below 1e-8."""
    zone = geo.utm_zone(F.col("lon"))
    x, y = geo.utm_xy(F.col("lat"), F.col("lon"), zone)
    rows = fixes(spark, sf_dir).select("event_id", "lat", "lon", zone.alias("zone"), x.alias("ux"), y.alias("uy"))
    lat, lon = geo.utm_latlon(F.col("ux"), F.col("uy"), F.col("zone"))
    return rows.select("event_id", ((F.abs(lat - F.col("lat")) < 1e-8) & (F.abs(lon - F.col("lon")) < 1e-8)).alias("returns"))


def geo_haversine(spark, sf_dir):
    w = W.partitionBy("track_id").orderBy("seq")
    rows = fixes(spark, sf_dir).withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)}).where("lat0 is not null")
    args = (F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return rows.select("event_id", r6(geo.haversine(*args), 4).alias("metres"), r6(geo.haversine_asin(*args), 4).alias("metres_asin"))


def geo_tiles(spark, sf_dir):
    rows = fixes(spark, sf_dir).select(geo.tile(F.col("lat") - 48.2).alias("tile_lat"), geo.tile(F.col("lon") - 25.0).alias("tile_lon"))
    return rows.groupBy("tile_lat", "tile_lon").agg(F.count(F.lit(1)).alias("n"))


def geo_tile_neighbours(spark, sf_dir):
    """For every 20th fix the number of fixes in the tiles around it."""
    rows = fixes(spark, sf_dir).select("event_id", "lat", "lon")
    asked = rows.where("event_id % 20 = 0")
    return spatial.tile_counts(asked, rows, 2).select("event_id", "n")


def knn_geo_scoped(spark, sf_dir):
    """For every 20th fix the three nearest fixes of the tiles around it, itself included."""
    rows = fixes(spark, sf_dir).select("event_id", "lat", "lon")
    return spatial.nearest_points(rows.where("event_id % 20 = 0"), rows, 1, 3)


def geo_bbox_active(spark, sf_dir):
    """Boxes of nations that hold a fix; every fifth nation has no box and holds all."""
    n = F.col("n_nationkey")
    known = n % 5 != 0
    box = table(spark, sf_dir, "nation").select(
        n.alias("source_id"),
        F.when(known, n * 0.02 + 48.0).alias("lat_min"), F.when(known, n * 0.03 + 25.0).alias("lon_min"),
        F.when(known, n * 0.02 + 48.1).alias("lat_max"), F.when(known, n * 0.03 + 26.0).alias("lon_max"),
    )
    rows = fixes(spark, sf_dir).select("event_id", "lat", "lon")
    return spatial.active_sources(rows, box).groupBy("event_id").agg(F.count(F.lit(1)).alias("active"), F.min("source_id").alias("first_source"))


def affine_decompose_compose(spark, sf_dir):
    rows = matrices(spark, sf_dir)
    p = affine.to_pose(matrix(), FRAME_W / 2, FRAME_H / 2)
    sx, sy = affine.scales(matrix())
    return rows.select(
        "event_id", r6(affine.det(matrix())).alias("det"), r6(sx).alias("sx"), r6(sy).alias("sy"), r6(affine.angle(matrix())).alias("angle"),
        r6(affine.mean_scale(matrix())).alias("scale"), r6(affine.isotropic_scale(matrix())).alias("iso"), r6(p.x, 4).alias("px"), r6(p.y, 4).alias("py"),
    )


def matrix_valid(spark, sf_dir):
    return matrices(spark, sf_dir).select(
        "event_id", affine.is_valid(matrix()).alias("valid"), affine.significant_motion(matrix(), 960.0, 540.0).alias("moves")
    )


def homography_apply(spark, sf_dir):
    e = F.col("event_id")
    h = [F.col("a"), F.col("b"), F.col("tx"), F.col("c"), F.col("d"), F.col("ty"), e % 5 * 1e-4, e % 3 * 1e-4, F.lit(1.0)]
    x, y = affine.apply_homography(h, F.lit(100.0), F.lit(50.0))
    return matrices(spark, sf_dir).select("event_id", r6(x, 4).alias("hx"), r6(y, 4).alias("hy"), affine.is_valid_homography(h).alias("valid"))


def frame_rotation(spark, sf_dir):
    rows = fixes(spark, sf_dir).select("event_id", "x", "y", geo.quarter_turn(F.col("x") * 3 - 90).alias("turn"), geo.wrap_deg(F.col("x") * 3).alias("deg"))
    nx, ny = affine.rotate_quarter(F.col("x"), F.col("y"), F.col("turn"), F.lit(FRAME_W), F.lit(FRAME_H))
    return rows.select("event_id", F.col("turn").cast("int").alias("turn"), r6("deg").alias("deg"), r6(nx).alias("nx"), r6(ny).alias("ny"))


NAMES = [
    geo_mercator_roundtrip, geo_utm_roundtrip, geo_haversine, geo_tiles, geo_tile_neighbours, knn_geo_scoped, geo_bbox_active,
    affine_decompose_compose, matrix_valid, homography_apply, frame_rotation,
]
QUERIES = {f.__name__: f for f in NAMES}

_HAV = "sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2"
_TILE = "cast(trunc(lat / 0.005::double) as int) as ta, cast(trunc(lon / 0.005::double) as int) as tb"
SQL = {
    "geo_mercator_roundtrip": f"""with {SQL_FIXES} select event_id, round(radians(lon) * 6378137.0, 3) as mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as my,
 round(lat, 6) as lat, round(lon, 6) as lon, round(cos(radians(lat)), 6) as scale, cast(trunc((lon + 180) / 6) as int) + 1 as zone from fixes""",
    "geo_utm_roundtrip": f"with {SQL_FIXES} select event_id, true as returns from fixes",
    "geo_haversine": f"""with {SQL_FIXES}, p as (select event_id, track_id, seq, lat, lon from fixes)
 select b.event_id, round(2 * 6371000.0 * atan2(sqrt({_HAV.format(a='a', b='b')}), sqrt(1 - ({_HAV.format(a='a', b='b')}))), 4) as metres,
 round(2 * 6371000.0 * asin(least(1, sqrt({_HAV.format(a='a', b='b')}))), 4) as metres_asin from p b join p a on a.track_id = b.track_id and a.seq = b.seq - 1""",
    "geo_tiles": f"with {SQL_FIXES} select cast(trunc((lat - 48.2::double) / 0.005::double) as int) as tile_lat, cast(trunc((lon - 25.0::double) / 0.005::double) as int) as tile_lon, count(*) as n from fixes group by 1, 2",
    "geo_tile_neighbours": f"with {SQL_FIXES}, t as (select event_id, {_TILE} from fixes) select a.event_id, count(*) as n from t a join t b on abs(a.ta - b.ta) <= 2 and abs(a.tb - b.tb) <= 2 where a.event_id % 20 = 0 group by 1",
    "knn_geo_scoped": f"""with {SQL_FIXES}, t as (select event_id, lat, lon, {_TILE} from fixes),
 d as (select a.event_id, b.event_id as other_id, round(2 * 6371000.0 * atan2(sqrt({_HAV.format(a='a', b='b')}), sqrt(greatest(0, 1 - ({_HAV.format(a='a', b='b')})))), 4) as metres
   from t a join t b on abs(a.ta - b.ta) <= 1 and abs(a.tb - b.tb) <= 1 where a.event_id % 20 = 0),
 r as (select *, row_number() over (partition by event_id order by metres, other_id) as rank from d) select * from r where rank <= 3""",
    "geo_bbox_active": f"""with {SQL_FIXES}, b as (select n_nationkey as k, n_nationkey % 5 <> 0 as known, n_nationkey * 0.02::double + 48.0 as a, n_nationkey * 0.03::double + 25.0 as o, n_nationkey * 0.02::double + 48.1::double as a2, n_nationkey * 0.03::double + 26.0 as o2 from nation)
 select event_id, count(*) as active, min(k) as first_source from fixes join b on not known or (lat between a and a2 and lon between o and o2) group by 1""",
    "affine_decompose_compose": f"""with {SQL_MATRICES} select event_id, round(a * d - b * c, 6) as det, round(sqrt(a * a + c * c), 6) as sx, round(sqrt(b * b + d * d), 6) as sy, round(atan2(c, a), 6) as angle,
 round(greatest((sqrt(a * a + c * c) + sqrt(b * b + d * d)) * 0.5, 1e-9), 6) as scale, round(sqrt(abs(a * d - b * c)), 6) as iso, round(a * 960 + b * 540 + tx, 4) as px, round(c * 960 + d * 540 + ty, 4) as py from matrices""",
    "matrix_valid": f"""with {SQL_MATRICES}, s as (select *, sqrt(a * a + c * c) as u, sqrt(b * b + d * d) as v, a * d - b * c as det from matrices)
 select event_id, abs(det) >= 1e-9 and u > 0.001 and u < 100 and v > 0.001 and v < 100 and u / (v + 1e-9) > 0.5 and u / (v + 1e-9) < 2 and abs((a * b + c * d) / (u * v + 1e-9)) <= 0.8 as valid,
 sqrt((a * 960 + b * 540 + tx - 960) ** 2 + (c * 960 + d * 540 + ty - 540) ** 2) >= 15 or abs(degrees(atan2(c, a))) >= 1.5 or abs(det) < 1e-9 as moves from s""",
    "homography_apply": f"""with {SQL_MATRICES}, s as (select *, (event_id % 5) * 1e-4::double * 100 + (event_id % 3) * 1e-4::double * 50 + 1 as w, sqrt(a * a + c * c) as u, sqrt(b * b + d * d) as v from matrices)
 select event_id, round((a * 100 + b * 50 + tx) / w, 4) as hx, round((c * 100 + d * 50 + ty) / w, 4) as hy,
 abs(a * d - b * c) >= 1e-9 and u > 0.001 and u < 100 and v > 0.001 and v < 100 and u / (v + 1e-9) > 0.5 and u / (v + 1e-9) < 2 and abs((a * b + c * d) / (u * v + 1e-9)) <= 0.8 as valid from s""",
    "frame_rotation": f"""with {SQL_FIXES}, q as (select event_id, x, y, x * 3 - 90 as yw, x * 3 as dg from fixes),
 t as (select *, (yw - 360 * floor(yw / 360)) / 90 as z from q), u as (select *, (case when z - floor(z) = 0.5 then 2 * round(z / 2) else round(z) end)::int * 90 % 360 as turn from t)
 select event_id, turn::int as turn, round(dg + 180 - 360 * floor((dg + 180) / 360) - 180, 6) as deg,
 round(case turn when 90 then 1080.0 - 1 - y when 180 then 1920.0 - 1 - x when 270 then y else x end, 6) as nx, round(case turn when 90 then x when 180 then 1080.0 - 1 - y when 270 then 1920.0 - 1 - x else y end, 6) as ny from u""",
}
