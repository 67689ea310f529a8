"""Calibrations as JSON: anchors with their matrices, projection and frame size, in old and new versions, of many sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import MATRIX, matrix_of

VERSION = "3.0"
_ANCHOR = (
    "struct<frame_id: bigint, affine_matrix: array<array<double>>, rmse_m: double, max_err_m: double, "
    "qa_data: struct<rmse_m: double, median_err_m: double, max_err_m: double, inliers_count: int>>"
)
SCHEMA = (
    "version string, projection struct<mode: string, reference_gps: array<double>>, reference_gps array<double>, frame_size array<int>, "
    f"calib_frame_id bigint, affine_matrix array<array<double>>, anchors array<{_ANCHOR}>"
)
MERCATOR, UTM = "WEB_MERCATOR", "UTM"


def parsed(text: Column) -> Column:
    """A calibration's JSON as a struct; null where it is none."""
    return F.from_json(text, SCHEMA)


def projection(file: Column) -> tuple[Column, Column, Column]:
    """(mode, latitude, longitude of reference) of a parsed calibration.

    What the file states counts; a file of the second version states a reference point alone, which means UTM; else web Mercator.
    """
    stated, older = file["projection"], file["reference_gps"]
    mode = F.when(stated.isNotNull(), F.coalesce(stated["mode"], F.lit(MERCATOR))).when(older.isNotNull(), UTM).otherwise(MERCATOR)
    point = F.when(stated.isNotNull(), stated["reference_gps"]).otherwise(older)
    return mode, F.get(point, F.lit(0)), F.get(point, F.lit(1))


def anchors(files: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """A row per anchor of each file: keys, mode, ref_lat, ref_lon, width, height, frame_id, the matrix and its quality.

    The first version (or a file that names none) holds one matrix and its frame; others a list, whose quality stands in
    qa_data or, in older ones, beside the matrix. A file that is no JSON, is null, or has no anchors gives no rows; an anchor
    without a frame or a whole matrix is left out. A frame size that is not positive is null.
    """
    rows = files.select(*keys, parsed(F.col(text)).alias("f"))
    f = F.col("f")
    first = (F.coalesce(f["version"], F.lit("1.0")) == "1.0") & f["affine_matrix"].isNotNull() & f["calib_frame_id"].isNotNull()
    alone = F.array(F.struct(f["calib_frame_id"].alias("frame_id"), f["affine_matrix"].alias("affine_matrix"))).cast("array<struct<frame_id: bigint, affine_matrix: array<array<double>>>>")
    widened = F.transform(
        alone,
        lambda a: F.struct(
            a["frame_id"].alias("frame_id"), a["affine_matrix"].alias("affine_matrix"), F.lit(None).cast("double").alias("rmse_m"),
            F.lit(None).cast("double").alias("max_err_m"), F.lit(None).cast("struct<rmse_m: double, median_err_m: double, max_err_m: double, inliers_count: int>").alias("qa_data"),
        ),
    )
    mode, lat, lon = projection(f)
    size = f["frame_size"]
    sized = (F.size(size) == 2) & (F.get(size, F.lit(0)) > 0) & (F.get(size, F.lit(1)) > 0)
    each = rows.select(
        *keys, mode.alias("mode"), lat.alias("ref_lat"), lon.alias("ref_lon"),
        F.when(sized, F.get(size, F.lit(0))).alias("width"), F.when(sized, F.get(size, F.lit(1))).alias("height"),
        F.explode(F.when(first, widened).otherwise(f["anchors"])).alias("anchor"),
    )
    a = F.col("anchor")
    told = lambda n: a["qa_data"][n]
    m = matrix_of(a["affine_matrix"])
    out = each.select(
        *[c for c in each.columns if c != "anchor"], a["frame_id"].alias("frame_id"), *[v.alias(n) for n, v in zip(MATRIX, m, strict=True)],
        F.coalesce(told("rmse_m"), a["rmse_m"]).alias("rmse_m"), told("median_err_m").alias("median_err_m"),
        F.coalesce(told("max_err_m"), a["max_err_m"]).alias("max_err_m"), told("inliers_count").alias("inliers_count"),
    )
    return out.dropna(subset=["frame_id", *MATRIX])


def lines(rows: DataFrame) -> DataFrame:
    """(value): each row of `anchors` as a calibration of one anchor in a line of JSON, so that no source's anchors gather in one task.

    `anchors` reads such lines as it reads whole files. Missing quality columns are left out.
    """
    have = lambda n: [F.col(n)] if n in rows.columns else []
    matrix = F.array(F.array("a", "b", "tx"), F.array("c", "d", "ty"))
    quality = [c for n in ("rmse_m", "median_err_m", "max_err_m", "inliers_count") for c in have(n)]
    anchor = F.struct(F.col("frame_id"), matrix.alias("affine_matrix"), *([F.struct(*quality).alias("qa_data")] if quality else []))
    point = F.when(F.col("ref_lat").isNotNull() & F.col("ref_lon").isNotNull(), F.array("ref_lat", "ref_lon"))
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.array("width", "height"))
    file = F.struct(
        F.lit(VERSION).alias("version"), F.struct(F.col("mode"), point.alias("reference_gps")).alias("projection"),
        size.alias("frame_size"), F.array(anchor).alias("anchors"),
    )
    return rows.select(F.to_json(file).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """Anchors as lines of JSON; the folder is replaced as a whole, and read again by `read_lines`."""
    lines(rows).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return anchors(spark.read.text(path), "value", [])


def read_sources(sources: DataFrame, path: str) -> DataFrame:
    """Anchors of all enabled sources (source_id, enabled, calibration_file) from JSON files below a folder, one file each.

    A null `enabled` is enabled. A source whose file is missing or broken has no rows. calibration_file is relative to the folder.
    """
    spark = sources.sparkSession
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("__path"))
    root = "/" + path.split("://")[-1].strip("/") + "/"
    files = files.withColumn("calibration_file", F.substring_index("__path", root, -1)).drop("__path")
    wanted = sources.where(F.coalesce(F.col("enabled"), F.lit(True))).select("source_id", "calibration_file")
    return anchors(wanted.join(files, "calibration_file"), "value", ["source_id"])
