"""Frames and their local features as tables: optional columns, padding, two layouts of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.affine import Affine
from ..operators.scenes import frame_size

REQUIRED = ("frame_id", "vector")
#: Columns that a table of frames may lack, and what stands for them.
OPTIONAL = {
    "frame_index": "bigint", "patches": "array<array<float>>", "depth_scale": "double", "lat": "double", "lon": "double",
    "frame_height": "int", "frame_width": "int",
}
MATRIX = ("a", "b", "tx", "c", "d", "ty")


def complete(frames: DataFrame) -> DataFrame:
    """frames with all optional columns, null where the table has none; other columns stay.

    A frame's index is its id unless it is told. A place of which either number is null or NaN is no place. Without a required
    column a ValueError names what is missing.
    """
    missing = [c for c in REQUIRED if c not in frames.columns]
    if missing:
        raise ValueError(f"frames lack {', '.join(missing)}; there are {', '.join(frames.columns)}")
    out = frames.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in frames.columns})
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    return out.withColumns(
        {"frame_index": F.coalesce("frame_index", "frame_id"), "lat": F.when(placed, F.col("lat")), "lon": F.when(placed, F.col("lon"))}
    )


def padded(features: DataFrame, most: int, columns: dict[str, Column]) -> DataFrame:
    """features for storing: each array (name: what fills it) is cut or filled to `most` elements; kp_count tells the true ones.

    The first of the arrays counts. A null array has none.
    """
    first = next(iter(columns))
    count = F.least(F.coalesce(F.size(F.when(F.col(first).isNotNull(), F.col(first))), F.lit(0)), F.lit(most))

    def fill(name: str, empty: Column) -> Column:
        whole = F.coalesce(F.col(name), F.array())
        return F.concat(F.slice(whole, 1, most), F.array_repeat(empty, F.greatest(F.lit(0), F.lit(most) - F.size(whole))))

    return features.withColumns({"kp_count": count, **{n: fill(n, e) for n, e in columns.items()}})


def trimmed(features: DataFrame, columns: list[str]) -> DataFrame:
    """Stored features without their padding. A table without kp_count holds arrays as they are; a null or negative count is 0."""
    if "kp_count" not in features.columns:
        return features.withColumn("kp_count", F.coalesce(F.size(F.when(F.col(columns[0]).isNotNull(), F.col(columns[0]))), F.lit(0)))
    count = F.greatest(F.lit(0), F.coalesce(F.col("kp_count"), F.lit(0)))
    return features.withColumns({"kp_count": count.cast("int"), **{c: F.slice(F.col(c), 1, count.cast("int")) for c in columns}})


def frame_features(asked: DataFrame, frames: DataFrame, features: DataFrame, columns: list[str], stored: tuple[Column, Column]) -> DataFrame:
    """asked (frame_id) with the trimmed features of its frame, its size, and why there are none.

    status is `ok`, `unknown frame` or `no keypoints`; arrays of the latter two are null. stored: height and width that
    the whole table states, either may be null.
    """
    held = trimmed(features, columns).select("frame_id", "kp_count", *columns, F.lit(True).alias("__held"))
    sizes = complete(frames).select("frame_id", F.col("frame_height").alias("__h"), F.col("frame_width").alias("__w"))
    height, width = frame_size((F.col("__h"), F.col("__w")), stored)
    status = F.when(F.col("__held").isNull(), "unknown frame").when(F.col("kp_count") == 0, "no keypoints").otherwise("ok")
    out = asked.join(held, "frame_id", "left").join(sizes, "frame_id", "left").withColumn("status", status)
    kept = {c: F.when(F.col("status") == "ok", F.col(c)) for c in columns}
    return out.withColumns({**kept, "kp_count": F.coalesce("kp_count", F.lit(0)), "height": height, "width": width}).drop("__held", "__h", "__w")


def previous_solution(frames: DataFrame) -> DataFrame:
    """(keys and) the matrices of valid frames alone, to start the next solution from; without the columns no rows."""
    if not {"valid", *MATRIX} <= set(frames.columns):
        return frames.limit(0).withColumns({c: F.lit(None).cast("double") for c in MATRIX if c not in frames.columns})
    return frames.where(F.coalesce(F.col("valid"), F.lit(False)))


def matrix_of(rows: Column) -> Affine:
    """An array of two rows of three numbers as a matrix."""
    at = lambda i, j: F.get(F.get(rows, F.lit(i)), F.lit(j))
    return Affine(*[at(i, j) for i in range(2) for j in range(3)])
