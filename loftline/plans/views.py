"""Domain tables derived from the given Parquet tables, in Spark and, as a prelude of CTEs, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.affine import Affine
from ..session import table

FRAME_W, FRAME_H = 1920.0, 1080.0
K = "\"k\": *(-?[0-9.]+)"


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, event_id, event_type, t, x, y, seq) of events, one track per user."""
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"),
        "event_id",
        "event_type",
        seconds.alias("t"),
        F.col("value").alias("x"),
        F.regexp_extract("props", K, 1).cast("double").alias("y"),
        F.row_number().over(order).cast("long").alias("seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), "label")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track rows with lat, lon and confidence."""
    return track(spark, sf_dir).withColumns(
        {
            "lat": F.col("x") / 1000.0 + 48.0,
            "lon": F.col("y") / 1000.0 + 25.0,
            "confidence": (F.col("event_id") % 100) / 100.0,
        }
    )


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One affine matrix per event."""
    e = F.col("event_id")
    sx, sy, a = e % 7 * 0.2 + 0.2, e % 5 * 0.3 + 0.2, (e % 63 - 31) * 0.1
    sign = F.when(e % 2 == 0, 1.0).otherwise(-1.0)
    return track(spark, sf_dir).select(
        "event_id", "x", "y",
        (F.cos(a) * sx).alias("a"), (-F.sin(a) * sign * sy).alias("b"), F.col("x").alias("tx"),
        (F.sin(a) * sx).alias("c"), (F.cos(a) * sign * sy).alias("d"), F.col("y").alias("ty"),
    )


def matrix() -> Affine:
    """The matrix of a row; Columns need a session, so none is made on import."""
    return Affine(*[F.col(n) for n in ("a", "b", "tx", "c", "d", "ty")])



def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal edges between the rows of a track, spatial ones over three steps; the edge's id is that of its end."""
    t = track(spark, sf_dir)
    w = W.partitionBy("track_id").orderBy("seq")

    def step(back: int, kind: str) -> DataFrame:
        before = lambda c: F.lag(c, back).over(w)
        rows = t.withColumns({"from_id": before("event_id"), "px": before("x"), "py": before("y")}).where("from_id is not null")
        e = F.col("event_id")
        return rows.select(
            (e * 2 + int(back > 1)).alias("edge_id"), "from_id", e.alias("to_id"), "track_id", "seq",
            ((F.col("x") - F.col("px")) / 10.0).alias("dx"), ((F.col("y") - F.col("py")) / 10.0).alias("dy"),
            ((e % 5 - 2) * 0.01).alias("log_dsx"), ((e % 3 - 1) * 0.01).alias("log_dsy"), ((e % 7 - 3) * 0.01).alias("dtheta"),
            (e % 4 + 1).cast("double").alias("weight"), F.lit(kind).alias("edge_type"),
            (e % 80 + 20).cast("int").alias("inliers"), (e % 13 / 10.0).alias("rmse"),
        )

    return step(1, "temporal").unionByName(step(3, "spatial"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return track(spark, sf_dir).select(
        e.alias("node"), "x", "y", ((e % 11 - 5) * 0.01).alias("log_sx"), ((e % 9 - 4) * 0.01).alias("log_sy"),
        ((e % 63 - 31) * 0.1).alias("theta"), "track_id", "seq",
    )


SQL_TRACK = """track as (select user_id as track_id, event_id, event_type, epoch(ts) as t, value as x,
  cast(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) as double) as y,
  row_number() over (partition by user_id order by ts, event_id) as seq from events)"""
SQL_FIXES = SQL_TRACK + """, fixes as (select *, x / 1000.0::double + 48.0 as lat, y / 1000.0::double + 25.0 as lon,
  (event_id % 100) / 100.0::double as confidence from track)"""
SQL_MATRICES = SQL_TRACK + """, par as (select *, (event_id % 7) * 0.2::double + 0.2 as sx, (event_id % 5) * 0.3::double + 0.2 as sy,
  (event_id % 63 - 31) * 0.1::double as an, case when event_id % 2 = 0 then 1.0::double else -1.0::double end as sg from track),
 matrices as (select event_id, x, y, cos(an) * sx as a, -sin(an) * sg * sy as b, x as tx, sin(an) * sx as c, cos(an) * sg * sy as d, y as ty from par)"""
SQL_EDGES = SQL_TRACK + """, steps as (
  select event_id * 2 as edge_id, lag(event_id, 1) over w as from_id, event_id as to_id, track_id, seq,
    (x - lag(x, 1) over w) / 10.0::double as dx, (y - lag(y, 1) over w) / 10.0::double as dy, 'temporal' as edge_type from track window w as (partition by track_id order by seq)
  union all
  select event_id * 2 + 1, lag(event_id, 3) over w, event_id, track_id, seq,
    (x - lag(x, 3) over w) / 10.0::double, (y - lag(y, 3) over w) / 10.0::double, 'spatial' from track window w as (partition by track_id order by seq)),
 edges as (select *, (to_id % 5 - 2) * 0.01::double as log_dsx, (to_id % 3 - 1) * 0.01::double as log_dsy, (to_id % 7 - 3) * 0.01::double as dtheta,
   (to_id % 4 + 1)::double as weight, (to_id % 80 + 20)::int as inliers, (to_id % 13) / 10.0::double as rmse from steps where from_id is not null),
 poses as (select event_id as node, x, y, (event_id % 11 - 5) * 0.01::double as log_sx, (event_id % 9 - 4) * 0.01::double as log_sy,
   (event_id % 63 - 31) * 0.1::double as theta, track_id, seq from track)"""
SQL_KNN = """n as (select vec_id, label, list_transform(embedding::double[], lambda v: v / (sqrt(list_inner_product(embedding::double[], embedding::double[])) + 1e-8)) as v from embeddings),
 knn as (select q.vec_id as query_id, r.vec_id as ref_id, q.label as query_label, r.label as ref_label, round(list_inner_product(q.v, r.v), 9) as score
   from n q join n r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
 ranked as (select *, row_number() over (partition by query_id order by score desc, ref_id) as rank from knn)"""
