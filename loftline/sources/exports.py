"""Exports of fixes as CSV, GeoJSON and KML; readers of ground truth and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = ("frame", "lat", "lon", "confidence", "inliers", "matched_frame", "source_id")


def write_csv(fixes: DataFrame, path: str) -> None:
    """The fixed columns only; missing ones are empty."""
    fixes.select(*[F.col(c) if c in fixes.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]).write.mode("overwrite").csv(path, header=True)


def point_feature(lat: Column, lon: Column, properties: dict[str, Column]) -> Column:
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
            F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"),
        )
    )


def polygon_feature(ring: Column, properties: dict[str, Column]) -> Column:
    """ring: array of (lat, lon) structs; null below three points, closed if it is open."""
    points = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"),
            F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"),
        )
    )
    return F.when(F.size(ring) >= 3, feature)


def line_feature(points: Column, properties: dict[str, Column]) -> Column:
    """points: array of (lat, lon) structs; null below two points or where one has no place. Null properties are kept."""
    body = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"),
        F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"),
    )
    whole = (F.size(points) >= 2) & ~F.exists(points, lambda p: p["lat"].isNull() | p["lon"].isNull())
    return F.when(whole, F.to_json(body, {"ignoreNullFields": "false"}))


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, feature) of a pose graph: a point for each node (node, lat, lon, anchor) and a line for each edge.

    edges: (edge_id, from_id, to_id, edge_type, weight, residual). Nodes without a place and edges that end at one are left out; a
    residual may be null. One row per feature, so nothing gathers; a node that many edges meet is a hot key that Spark splits.
    """
    placed = nodes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    kind = F.when(F.coalesce("anchor", F.lit(False)), "anchor").otherwise("frame")
    points = placed.select(kind.alias("kind"), F.col("node").alias("id"), point_feature(F.col("lat"), F.col("lon"), {"frame_id": F.col("node"), "type": kind}).alias("feature"))
    end = lambda name: placed.select(F.col("node").alias(f"{name}_id"), F.struct("lat", "lon").alias(name))
    both = edges.join(end("from"), "from_id").join(end("to"), "to_id")
    told = {n: F.col(n) for n in ("from_id", "to_id", "edge_type", "residual", "weight")}
    return points.unionByName(both.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), line_feature(F.array("from", "to"), told).alias("feature")))


def slot_errors(errors: DataFrame, slot: str, anchor: Column) -> DataFrame:
    """The columns of the table of errors by slot, as text with fixed digits: metres, degrees and per cent; unknown ones are empty."""
    digits = lambda v, n: F.when(v.isNotNull(), F.format_string(f"%.{n}f", v))
    return errors.select(
        F.col(slot).alias("slot"), F.coalesce(anchor, F.lit(False)).cast("int").alias("is_anchor"), digits(F.col("error"), 3).alias("err_m"),
        digits(F.col("angle_error"), 4).alias("angle_err_deg"), digits(F.col("scale_error") * 100.0, 4).alias("scale_err_pct"),
    )


def placemark(name: Column, lat: Column, lon: Column) -> Column:
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.format_string("<Placemark><name>%s</name><Point><coordinates>%.7f,%.7f,0</coordinates></Point></Placemark>", safe, lon, lat)


def write_lines(features: DataFrame, column: str, path: str) -> None:
    """One feature per line, as many files as partitions."""
    features.select(column).where(F.col(column).isNotNull()).write.mode("overwrite").text(path)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="sim_time double, pos_x double, pos_y double").orderBy("sim_time")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Rows (frame_id, affine, lat, lon) of a ground-truth JSON with frames."""
    raw = spark.read.json(path, multiLine=True).select(F.explode("frames").alias("f"))
    return raw.select("f.frame_id", F.flatten("f.affine").alias("affine"), F.col("f.gps")[0].alias("lat"), F.col("f.gps")[1].alias("lon"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key is not in new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
