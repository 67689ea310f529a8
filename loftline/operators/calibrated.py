"""The table of a calibrated recording: a matrix for every slot, gaps filled in five degrees of freedom, quality and place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.affine import Affine, angle, apply, compose, det, scales
from ..session import stored
from .scans import running

MATRIX = ("a", "b", "tx", "c", "d", "ty")
# Limits of a scale, floor of its logarithm, edges of a frame that its disagreement looks at.
LEAST_SCALE, MOST_SCALE, LOG_FLOOR = 1e-6, 1e6, 1e-12
EDGES_SEEN = 5


def _matrix(prefix: str = "") -> Affine:
    return Affine(*[F.col(f"{prefix}{n}") for n in MATRIX])


def fill_poses(rows: DataFrame, keys: list[str], at: str, log_scale: bool = False) -> DataFrame:
    """rows (keys, at, matrix) with gaps filled, `valid`, and `filled` for those that were gaps.

    A gap is a row whose matrix has a null. Between two known rows shift, scales and angle go on a line by `at`, the angle the
    shorter way round, the scales within their limits (in logarithms if told so); the side of the mirror is the left row's.
    Before the first known row and after the last one these repeat; a group without any stays null and not valid. `at` is a whole
    number, unique within the keys; a group of any length is scanned in blocks.
    """
    known = ~F.exists(F.array(*MATRIX), lambda v: v.isNull())
    point = F.when(known, F.struct(F.col(at).cast("double").alias("at"), *MATRIX))
    marked = rows.withColumn("__known", point)
    both = running(marked, keys, at, lasts={"__left": "__known"}, nexts={"__right": "__known"}, own=True)
    left, right = _matrix("__left."), _matrix("__right.")
    share = (F.col(at) - F.col("__left.at")) / (F.col("__right.at") - F.col("__left.at"))
    line = lambda a, b: a * (1.0 - share) + b * share

    def scale(a, b):
        if log_scale:
            a, b = (F.log(F.greatest(v, F.lit(LOG_FLOOR))) for v in (a, b))
        between = F.exp(line(a, b)) if log_scale else line(a, b)
        return F.greatest(F.lit(LEAST_SCALE), F.least(F.lit(MOST_SCALE), between))

    sx, sy = (scale(a, b) for a, b in zip(scales(left), scales(right), strict=True))
    turn = F.pmod(angle(right) - angle(left) + math.pi, F.lit(2 * math.pi)) - math.pi
    sign = F.when(det(left) < 0, -1.0).otherwise(1.0)
    between = compose(line(left.tx, right.tx), line(left.ty, right.ty), sx, sy, angle(left) + turn * share, sign)
    inside = F.col("__known").isNull() & F.col("__left").isNotNull() & F.col("__right").isNotNull()
    pick = lambda n: F.when(inside, getattr(between, n)).otherwise(F.coalesce(F.col(f"__known.{n}"), F.col(f"__left.{n}"), F.col(f"__right.{n}")))
    found = {f"__f_{n}": pick(n) for n in MATRIX}
    out = both.withColumns(found).withColumn("valid", F.col("__f_a").isNotNull())
    out = out.withColumn("filled", F.col("valid") & F.col("__known").isNull())
    return out.withColumns({n: F.col(f"__f_{n}") for n in MATRIX}).drop("__known", "__left", "__right", *found)


def edge_quality(edges: DataFrame, results: DataFrame) -> DataFrame:
    """(node, matches, rmse, disagreement) of each node that has edges (edge_id, from_id, to_id, inliers, rmse).

    matches: mean of the inliers, cut to a whole number; rmse: mean of those above 0, else 0; disagreement: spread of the x shift
    over the neighbours by the first five edges, as far as these have a result, else 0. results: (node, tx).
    An edge from a node to itself counts twice.
    """
    here = F.explode(F.array(F.struct(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit(0).alias("side")), F.struct(F.col("to_id").alias("node"), F.col("from_id").alias("other"), F.lit(1).alias("side"))))
    ends = edges.select("edge_id", "inliers", "rmse", here.alias("e")).select("edge_id", "inliers", "rmse", "e.*")
    total = ends.groupBy("node").agg(
        F.floor(F.avg("inliers")).cast("int").alias("matches"),
        F.coalesce(F.avg(F.when(F.col("rmse") > 0, F.col("rmse"))), F.lit(0.0)).alias("rmse"),
    )
    first = ends.withColumn("__n", F.row_number().over(W.partitionBy("node").orderBy("edge_id", "side"))).where(F.col("__n") <= EDGES_SEEN)
    seen = first.join(results.select(F.col("node").alias("other"), "tx"), "other")
    spread = seen.groupBy("node").agg(F.stddev_pop("tx").alias("disagreement"))
    return total.join(spread, "node", "left").withColumn("disagreement", F.coalesce("disagreement", F.lit(0.0)))


def solution_table(
    slots: DataFrame, results: DataFrame, edges: DataFrame, keys: list[str], at: str, width: float, height: float, log_scale: bool = False
) -> DataFrame:
    """A row for every slot (keys, at, node): matrix, valid, filled, matches, rmse, disagreement, lat, lon.

    results: (node, matrix) of what the graph reached; edges as in edge_quality. Slots without a result are filled; what no
    edge touches has zeros, and so has what is not valid. The place is that of the frame's centre in web Mercator, null where not valid.
    Results and edges, which are read twice each, are stored once.
    """
    results = stored(results.select("node", *MATRIX))
    edges = stored(edges.select("edge_id", "from_id", "to_id", "inliers", "rmse"))
    rows = slots.select(*keys, at, "node").join(results.select("node", *MATRIX), "node", "left")
    quality = edge_quality(edges, results)
    out = fill_poses(rows, keys, at, log_scale).join(quality, "node", "left")
    x, y = apply(_matrix(), F.lit(width / 2), F.lit(height / 2))
    zero = {n: F.when(F.col("valid"), F.coalesce(F.col(n), F.lit(0).cast(t))).otherwise(F.lit(0).cast(t)) for n, t in (("matches", "int"), ("rmse", "double"), ("disagreement", "double"))}
    return out.withColumns({**zero, "lat": F.when(F.col("valid"), geo.mercator_lat(y)), "lon": F.when(F.col("valid"), geo.mercator_lon(x))})
