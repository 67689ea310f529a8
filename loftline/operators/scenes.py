"""Scenes: lookups with defaults, truth tables, anchors and their quality, fields of view, run comparison, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.affine import Affine, apply, apply_homography, det, isotropic_scale
from .scans import beside, quantiles, ranked

# Frame size where nothing tells it, limits of scale ratios, coordinate from which a projection has exploded.
DEFAULT_SIZE = (1080, 1920)
RATIO_MIN, RATIO_MAX = 0.3, 3.5
EXPLODED = 50_000.0


def lookup(asked: DataFrame, frames: DataFrame, key: str, values: list[str], valid: Column) -> DataFrame:
    """asked with the values of its frame; null where there is no such frame or it is not valid."""
    found = frames.where(valid).select(key, *values)
    return asked.join(found, key, "left")


def frame_size(own: tuple[Column, Column], stored: tuple[Column, Column]) -> tuple[Column, Column]:
    """(height, width) of a frame: its own if both are known, else those of the database, else the default."""
    known = own[0].isNotNull() & own[1].isNotNull()
    rest = [F.coalesce(F.nullif(s, F.lit(0)), F.lit(d)) for s, d in zip(stored, DEFAULT_SIZE, strict=True)]
    return tuple(F.when(known, o).otherwise(r) for o, r in zip(own, rest, strict=True))


def center_errors(pred: DataFrame, truth: DataFrame, key: str, width: float, height: float, scale: float = 1.0) -> DataFrame:
    """Predictions and truths (key, a, b, tx, c, d, ty) of one key: distance of frame centres times scale, angle error in
    degrees, deviation of the isotropic scale, and whether the determinants' signs agree.
    """
    names = ("a", "b", "tx", "c", "d", "ty")
    both = pred.select(key, F.struct(*names).alias("p")).join(truth.select(key, F.struct(*names).alias("g")), key)
    p, g = (Affine(*[F.col(f"{s}.{n}") for n in names]) for s in "pg")
    (px, py), (gx, gy) = (apply(m, F.lit(width / 2), F.lit(height / 2)) for m in (p, g))
    turn = F.degrees(F.atan2(p.c, p.a)) - F.degrees(F.atan2(g.c, g.a)) + 180.0
    true_scale = isotropic_scale(g)
    return both.select(
        key,
        (F.sqrt((px - gx) ** 2 + (py - gy) ** 2) * scale).alias("error"),
        F.abs(F.pmod(turn, F.lit(360.0)) - 180.0).alias("angle_error"),
        F.when(true_scale > 0, F.abs(isotropic_scale(p) - true_scale) / true_scale).alias("scale_error"),
        (F.signum(det(p)) == F.signum(det(g))).alias("same_sign"),
    )


def scene_metrics(errors: DataFrame, truths: Column | int, keys: list[str]) -> DataFrame:
    """Coverage, median, p95 and largest error, share of equal determinant signs and median scale drift."""
    whole = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / truths).alias("coverage"),
        F.max("error").alias("max"),
        F.avg(F.col("same_sign").cast("int")).alias("det_sign_ok"),
    )
    spread = quantiles(errors, keys, "error", {"median": 0.5, "p95": 0.95}).drop("n")
    drift = quantiles(errors.withColumn("known", F.coalesce("scale_error", F.lit(float("nan")))), keys, "known", {"drift": 0.5}).drop("n")
    named = drift.select(*[F.col(k).alias(f"__d{i}") for i, k in enumerate(keys)], "drift")
    same = [F.col(k).eqNullSafe(F.col(f"__d{i}")) for i, k in enumerate(keys)]
    out = beside(whole, spread, keys).join(named, same, "left").drop(*[f"__d{i}" for i in range(len(keys))])
    return out.withColumn("scale_drift", F.coalesce("drift", F.lit(0.0))).drop("drift")


def relative_angle(a: Affine, b: Affine) -> Column:
    """Rotation in degrees of frame b as seen from frame a; null where a has no inverse."""
    d = det(a)
    x, y = (a.d * b.a - a.b * b.c) / d, (a.a * b.c - a.c * b.a) / d
    return F.when(F.abs(d) > 0, F.degrees(F.atan2(y, x)))


def retry_angles(prior: Column) -> Column:
    """Angles to try: the prior and the quarter turns in (-180, 180], without 0 and any within a degree of one before."""
    norm = lambda a: F.pmod(a + 180.0, F.lit(360.0)) - 180.0
    quarters = F.array(*[F.lit(a) for a in (90.0, 180.0, 270.0)])
    raw = F.when(prior.isNull(), quarters).otherwise(F.concat(F.array(prior.cast("double")), quarters))

    def add(out: Column, a: Column) -> Column:
        near = F.exists(out, lambda b: F.abs(norm(a - b)) < 1.0)
        return F.when((F.abs(a) < 1e-6) | near, out).otherwise(F.concat(out, F.array(a)))

    return F.aggregate(F.transform(raw, norm), F.array().cast("array<double>"), add)


def crop_affine(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Affine, Affine]:
    """The affine from a frame to its crop, resized to (width, height), and back; a crop without area gives identities."""
    none = (w <= 0) | (h <= 0)
    sx, sy, zero, one = width / w, height / h, F.lit(0.0), F.lit(1.0)
    pick = lambda value, other: F.when(none, other).otherwise(value)
    there = Affine(pick(sx, one), zero, pick(-x * sx, zero), zero, pick(sy, one), pick(-y * sy, zero))
    back = Affine(pick(1.0 / sx, one), zero, pick(x.cast("double"), zero), zero, pick(1.0 / sy, one), pick(y.cast("double"), zero))
    return there, back


def fov_corners(h: list[Column], m: Affine, width: float, height: float, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Four corners of a frame in metres, by a homography to the reference frame and its affine, and whether it exploded.

    Where a projected coordinate is beyond EXPLODED, the box of the inliers (min_x, min_y, max_x, max_y), a tenth wider on each
    side, stands for the frame. A corner at infinity leaves no polygon.
    """
    corners = [(F.lit(0.0), F.lit(0.0)), (F.lit(width), F.lit(0.0)), (F.lit(width), F.lit(height)), (F.lit(0.0), F.lit(height))]
    most = F.greatest(*[F.abs(v) for x, y in corners for v in apply_homography(h, x, y)])
    exploded = F.coalesce(most > EXPLODED, F.lit(False)) & box[0].isNotNull()
    pad_x, pad_y = (box[2] - box[0]) * 0.1, (box[3] - box[1]) * 0.1
    left, right = F.greatest(F.lit(0.0), box[0] - pad_x), F.least(F.lit(width), box[2] + pad_x)
    top, bottom = F.greatest(F.lit(0.0), box[1] - pad_y), F.least(F.lit(height), box[3] + pad_y)
    safe = [(left, top), (right, top), (right, bottom), (left, bottom)]
    points = []
    for (x, y), (sx, sy) in zip(corners, safe, strict=True):
        u, v = apply_homography(h, F.when(exploded, sx).otherwise(x), F.when(exploded, sy).otherwise(y))
        mx, my = apply(m, u, v)
        points.append(F.struct(mx.alias("x"), my.alias("y")))
    whole = F.array(*points)
    return F.when(~F.exists(whole, lambda p: p["x"].isNull() | p["y"].isNull()), whole), exploded


def interpolate_anchors(rows: DataFrame, anchors: DataFrame, group: str, at: str, px: float, py: float) -> DataFrame:
    """rows (group, at) with x, y in metres of pixel (px, py): exact at an anchor, linear between two, null outside.

    anchors: (group, at, a, b, tx, c, d, ty). A group with a single anchor uses it everywhere. Both sides meet in one sorted
    union, not in a range join.
    """
    m = Affine(*[F.col(n) for n in ("a", "b", "tx", "c", "d", "ty")])
    x, y = apply(m, F.lit(px), F.lit(py))
    marks = anchors.select(group, at, F.struct(F.col(at).alias("at"), x.alias("x"), y.alias("y")).alias("m"), F.lit(None).alias("row"))
    asked = rows.select(group, at, F.lit(None).cast(marks.schema["m"].dataType).alias("m"), F.struct(*rows.columns).alias("row"))
    order = W.partitionBy(group).orderBy(at)
    both = asked.unionByName(marks.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType)))
    both = both.withColumns(
        {
            "p": F.last("m", True).over(order.rangeBetween(W.unboundedPreceding, 0)),
            "n": F.first("m", True).over(order.rangeBetween(0, W.unboundedFollowing)),
            "k": F.count("m").over(W.partitionBy(group)),
        }
    )
    span = F.col("n.at") - F.col("p.at")
    share = (F.col(at) - F.col("p.at")) / span
    out = []
    for c in "xy":
        between = F.when(span == 0, F.col(f"p.{c}")).otherwise(F.col(f"p.{c}") * (1 - share) + F.col(f"n.{c}") * share)
        out.append(F.when(F.col("k") == 1, F.coalesce(f"p.{c}", f"n.{c}")).otherwise(between).alias(f"m{c}"))
    return both.where("row is not null").select("row.*", *out)


def gap_fallback(centers: DataFrame, gaps: DataFrame, group: str, at: str, most: float = 150.0) -> DataFrame:
    """Centres (group, at, x, y) inside a gap (group, lo, hi, the anchors' x0, y0, x1, y1) that lie off its line by more than `most`.

    Gaps of a group do not overlap: the last that begins before a centre is the only one that may hold it.
    """
    order = W.partitionBy(group).orderBy(at, "k").rowsBetween(W.unboundedPreceding, 0)
    gap = F.struct("lo", "hi", "x0", "y0", "x1", "y1")
    marks = gaps.select(group, F.col("lo").alias(at), gap.alias("g"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    rows = centers.select(group, at, F.lit(None).cast(marks.schema["g"].dataType).alias("g"), F.lit(1).alias("k"), "x", "y")
    held = rows.unionByName(marks).withColumn("g", F.last("g", True).over(order)).where("k = 1 and x is not null and y is not null")
    held = held.where((F.col(at) > F.col("g.lo")) & (F.col(at) < F.col("g.hi")))
    t = (F.col(at) - F.col("g.lo")) / (F.col("g.hi") - F.col("g.lo"))
    off = [F.col(c) - (F.col(f"g.{c}0") + t * (F.col(f"g.{c}1") - F.col(f"g.{c}0"))) for c in "xy"]
    return held.withColumn("off", F.sqrt(off[0] ** 2 + off[1] ** 2)).where(F.col("off") > most).select(group, at, "off")


def kinematic_triples(nodes: DataFrame, group: str, at: str, fixed: str, weight: float) -> DataFrame:
    """Triples (a, b, c) of neighbouring nodes of which one is free at least, with the share of a and the weight of the prior."""
    order = W.partitionBy(group).orderBy(at)
    rows = nodes.select(
        group, F.col(at).alias("a"), F.lead(at, 1).over(order).alias("b"), F.lead(at, 2).over(order).alias("c"),
        (F.col(fixed) & F.lead(fixed, 1).over(order) & F.lead(fixed, 2).over(order)).alias("all_fixed"),
    )
    span = F.col("c") - F.col("a")
    rows = rows.where("c is not null and not all_fixed and c > a") if weight > 0 else rows.limit(0)
    return rows.select(group, "a", "b", "c", ((F.col("c") - F.col("b")) / span).alias("alpha"), (F.lit(2.0 * weight) / span).alias("weight"))


def anchor_quality(points: DataFrame, keys: list[str], fit: DataFrame, rmse_limit: float = 3.0) -> DataFrame:
    """points (keys, x, y, u, v) with error, leave-one-out error and whether they are suspicious under the fit of their group.

    For least squares the error of a point that is left out is its error over 1 - its leverage, so no fit is repeated.
    Only groups of 5 to 12 points are judged: errors above three times the median of the group and twice the limit.
    """
    mean = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("k"))
    at = points.join(mean, keys).join(fit.select(*keys, "a", "b", "tx", "c", "d", "ty"), keys)
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = at.groupBy(*keys).agg(F.sum(dx * dx).alias("xx"), F.sum(dx * dy).alias("xy"), F.sum(dy * dy).alias("yy"))
    at = at.join(sums, keys)
    area = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    leverage = 1.0 / F.col("k") + (F.col("yy") * dx * dx - 2.0 * F.col("xy") * dx * dy + F.col("xx") * dy * dy) / area
    px, py = apply(Affine(*[F.col(n) for n in ("a", "b", "tx", "c", "d", "ty")]), F.col("x"), F.col("y"))
    at = at.withColumn("error", F.sqrt((px - F.col("u")) ** 2 + (py - F.col("v")) ** 2))
    at = at.withColumn("loo", F.when(F.col("k").between(5, 12) & (leverage < 1 - 1e-9), F.col("error") / (1.0 - leverage)))
    middle = at.groupBy(*keys).agg(F.percentile("loo", 0.5).alias("mid"))
    at = at.join(middle, keys)
    bad = F.coalesce(F.col("loo") > F.greatest(F.col("mid") * 3.0, F.lit(2.0 * rmse_limit)), F.lit(False))
    return at.select(*points.columns, "error", "loo", bad.alias("suspicious"))


def depth_hint(query: Column, stored: Column) -> Column:
    """Ratio of depth scales inside the limits; null where the database has none."""
    return F.when(stored >= 1e-8, F.greatest(F.lit(RATIO_MIN), F.least(F.lit(RATIO_MAX), query / stored)))


def scale_candidates(prior: Column, hint: Column, pyramid: tuple[float, ...]) -> Column:
    """The prior alone, else the levels of the pyramid, those nearest to the hint first, in their order where they tie."""
    levels = F.array(*map(F.lit, pyramid))
    keyed = F.transform(levels, lambda r, i: F.struct(F.abs(r - hint).alias("d"), i.alias("i"), r.alias("r")))
    near = F.transform(F.array_sort(keyed), lambda s: s["r"])
    return F.when(prior.isNotNull(), F.array(prior)).when(hint.isNotNull(), near).otherwise(levels)


def majority_sign(d: Column) -> Column:
    """-1 where half of the determinants or more are negative, else 1."""
    return F.when(F.count_if(d < 0) * 2 >= F.count(F.lit(1)), -1.0).otherwise(1.0)


def grid_tiles(width: Column, height: Column, grids: list[tuple[int, int]], least: int = 32) -> Column:
    """Boxes of the tiles of each grid (rows, columns), row by row; the last ones take what is left. Too small a tile is an error."""
    out = []
    for rows, columns in grids:
        th, tw = F.floor(height / rows).cast("int"), F.floor(width / columns).cast("int")
        for r in range(rows):
            for c in range(columns):
                bottom = height if r == rows - 1 else th * (r + 1)
                right = width if c == columns - 1 else tw * (c + 1)
                box = F.struct((tw * c).alias("x1"), (th * r).alias("y1"), right.cast("int").alias("x2"), bottom.cast("int").alias("y2"))
                small = (th < least) | (tw < least)
                out.append(F.when(small, F.raise_error(F.lit("tile too small"))).otherwise(box))
    return F.array(*out)


def run_verdict(runs: DataFrame, frame: str, inliers: str) -> DataFrame:
    """One row on runs (run a or b, ok, frame, inliers): the signals that need no alignment, and which of them fell.

    Success more than 2 points lower, Jaccard of matched frames below 0.9, or a median of inliers lower by more than 50.
    """
    of = lambda run: F.col("run") == run
    rate = runs.agg(
        *[F.count_if(of(r)).alias(f"total_{r}") for r in "ab"], *[F.count_if(of(r) & F.col("ok")).alias(f"n_{r}") for r in "ab"],
        *[F.percentile(F.when(of(r) & F.col("ok"), F.col(inliers)), 0.5).alias(f"median_{r}") for r in "ab"],
    )
    sides = runs.where("ok").groupBy(frame).agg(F.max(of("a")).alias("a"), F.max(of("b")).alias("b"))
    sets = sides.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count(F.lit(1)).alias("either"))
    one = rate.crossJoin(F.broadcast(sets))  # one row each
    jaccard = F.when(F.col("either") > 0, F.col("shared") / F.col("either"))
    fell = {
        "success": (F.col("total_a") > 0) & (F.col("total_b") > 0) & (F.try_divide("n_b", "total_b") < F.try_divide("n_a", "total_a") - 0.02),
        "frames": jaccard < 0.9,
        "inliers": F.col("median_b") < F.col("median_a") - 50,
    }
    names = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in fell.items()])
    return one.select("n_a", "n_b", "median_a", "median_b", jaccard.alias("jaccard"), F.array_join(F.array_compact(names), ",").alias("worse"))


def pair_runs(runs: DataFrame, keys: list[str], side: str, order: list[str], values: list[str]) -> DataFrame:
    """(keys, place, a_*, b_*) of the values of runs `a` and `b`, paired by their places, for keys where both have equally many rows.

    Unequal counts have no pairs, as a place then tells nothing. `order` makes the rows of a side distinct. Rows are
    ranked by ranges, so a run may be longer than a task can hold; keys may be null.
    """
    placed = ranked(runs.select(*keys, side, *dict.fromkeys([*order, *values])), [*keys, side], order)
    left, right = placed.where(F.col(side) == "a"), placed.where(F.col(side) == "b")
    left = left.select(*keys, "place", F.col("n").alias("__n"), *[F.col(v).alias(f"a_{v}") for v in values])
    right = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("place").alias("__place"), F.col("n").alias("__m"), *[F.col(v).alias(f"b_{v}") for v in values])
    same = [F.col("place") == F.col("__place"), F.col("__n") == F.col("__m"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    return left.join(right, same).select(*keys, "place", *[f"a_{v}" for v in values], *[f"b_{v}" for v in values])


def timings(samples: DataFrame, stage: str, value: str) -> DataFrame:
    """Calls, total, mean, least and most of each stage, with the median and the p95 by floor index."""
    placed = ranked(samples.select(stage, value), [stage], [value])
    at, middle = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)), (F.col("n") - 1) / 2
    spot = lambda i: F.max(F.when(F.col("place") == i, F.col(value)))
    return placed.groupBy(stage).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"),
        F.max(value).alias("most"), ((spot(F.floor(middle)) + spot(F.ceil(middle))) / 2).alias("median"), spot(at).alias("p95"),
    )


def compare_timings(a: DataFrame, b: DataFrame, stage: str, slower: float = 1.3) -> DataFrame:
    """Stages of both reports with the ratio of their medians; a median of 0 has no ratio and leaves the stage out."""
    both = a.select(stage, F.col("median").alias("a")).join(b.select(stage, F.col("median").alias("b")), stage).where("a <> 0 and b is not null")
    return both.withColumn("ratio", F.col("b") / F.col("a")).withColumn("slower", F.col("ratio") > slower)
