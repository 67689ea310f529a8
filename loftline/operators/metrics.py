"""Evaluation: retrieval metrics, error summaries and cuts, regression gates, run comparison, percentiles, affine fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import distance_ratio, pdm_score
from ..session import cut
from .scans import beside, quantiles, ranked


def retrieval_metrics(candidates: DataFrame, queries: DataFrame, k: int, radius: float, decay: float) -> DataFrame:
    """Per query recall, sdm and pdm at k from (query_id, rank, d_m, w_m); queries without candidates count 0.

    Ranks weigh from min(k, n) down to 1.
    """
    top = candidates.where(F.col("rank") <= k)
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    top = top.withColumn("w", n - F.col("rank") + 1)
    weighted = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    found = top.groupBy("query_id").agg(
        F.max((F.col("d_m") <= radius).cast("double")).alias("recall"),
        weighted(F.exp(F.col("d_m") * -decay)).alias("sdm"),
        weighted(pdm_score(distance_ratio(F.col("d_m"), F.col("w_m")))).alias("pdm"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("recall", "sdm", "pdm")}
    return queries.select("query_id").join(found, "query_id", "left").withColumns(zero)


def macro(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of queries and the means; 0 for none."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def summarize(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, median, p95 (linear), max and mean of the values that are not null or NaN."""
    return quantiles(rows, keys, value, {"median": 0.5, "p95": 0.95}, {"max": F.max, "mean": F.avg})


def cut_report(rows: DataFrame, value: str, cuts: dict[str, Column]) -> DataFrame:
    """summarize() for overlapping cuts: a row counts in each cut whose condition holds."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cuts.items()]))
    return summarize(rows.withColumn("cut", F.explode(labels)), value, ["cut"])


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """keys, n, the percentiles by nearest rank (name: share) and max of the known values; values are ranked by ranges."""
    placed = ranked(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    at = {name: F.greatest(F.ceil(F.col("n") * p) - 1, F.lit(0)) for name, p in shares.items()}
    found = [F.max(F.when(F.col("place") == i, F.col(value))).alias(name) for name, i in at.items()]
    return placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *found, F.max(value).alias("max"))


def floor_index(rows: DataFrame, value: str, p: float, keys: list[str]) -> DataFrame:
    """The value at index min(n - 1, int(p n)) of the ordered values of each key."""
    placed = ranked(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    return placed.where(F.col("place") == at).select(*keys, F.col(value).alias("value"))


def mad_outliers(rows: DataFrame, value: str, keys: list[str], k: float = 3.0, floor: float = 1.0, least: int = 4) -> DataFrame:
    """With keep: not above median + k * 1.4826 * MAD (at least `floor`); all stay where fewer than `least` would."""
    middle = cut(quantiles(rows, keys, value, {"__m": 0.5}).drop("n"))
    off = beside(rows.select(*keys, value), middle, keys).select(*keys, F.abs(F.col(value) - F.col("__m")).alias("__o"))
    limits = beside(middle, quantiles(off, keys, "__o", {"__d": 0.5}).drop("n"), keys)
    limits = cut(limits.select(*keys, F.greatest(F.col("__m") + F.col("__d") * (k * 1.4826), F.lit(floor)).alias("limit")))
    near = beside(rows, limits, keys)
    kept = near.groupBy(*keys).agg(F.count_if(F.col(value) <= F.col("limit")).alias("__kept"))
    return beside(near, kept, keys).withColumn("keep", (F.col(value) <= F.col("limit")) | (F.col("__kept") < least)).drop("__kept")


def inlier_spread(x: str, y: str, width: float, height: float) -> Column:
    """Smaller population deviation over the smaller side; null below two points."""
    least = F.least(F.stddev_pop(x), F.stddev_pop(y)) / min(width, height)
    return F.when(F.count(F.lit(1)) >= 2, least)


def affine_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares affine (a, b, tx, c, d, ty) from (x, y) to (u, v) by centred sums; null where points are collinear."""
    mean = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"], F.count(F.lit(1)).alias("n"))
    at = points.join(mean, keys).withColumns({c: F.col(c) - F.col(f"m{c}") for c in "xyuv"})
    products = {p: F.sum(F.col(p[0]) * F.col(p[1])).alias(p) for p in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")}
    s = at.groupBy(*keys, "n", *[f"m{c}" for c in "xyuv"]).agg(*products.values())
    d = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    d = F.when((F.col("n") >= 3) & (d > 1e-9), d)
    row = lambda u: (
        (F.col(f"x{u}") * F.col("yy") - F.col(f"y{u}") * F.col("xy")) / d,
        (F.col(f"y{u}") * F.col("xx") - F.col(f"x{u}") * F.col("xy")) / d,
    )
    (a, b), (c, e) = row("u"), row("v")
    tx = F.col("mu") - a * F.col("mx") - b * F.col("my")
    ty = F.col("mv") - c * F.col("mx") - e * F.col("my")
    return s.select(*keys, "n", a.alias("a"), b.alias("b"), tx.alias("tx"), c.alias("c"), e.alias("d"), ty.alias("ty"))


def regression_gate(now: DataFrame, baseline: DataFrame, keys: list[str], median: float = 0.10, most: float = 0.20) -> DataFrame:
    """passed: median and max are no more than so much above those of the baseline."""
    base = baseline.select(*keys, F.col("median").alias("base_median"), F.col("max").alias("base_max"))
    ok = (F.col("median") <= F.col("base_median") * (1 + median) + 1e-9) & (F.col("max") <= F.col("base_max") * (1 + most) + 1e-9)
    return now.join(base, keys).select(*keys, "median", "base_median", "max", "base_max", ok.alias("passed"))


def set_jaccard(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """One row: sizes of intersection and union of two item sets and their ratio, 1 for two empty ones."""
    x = a.select(F.col(item).alias("i"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    y = b.select(F.col(item).alias("i"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = x.unionByName(y).groupBy("i").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    total = both.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("shared"), F.count(F.lit(1)).alias("all"))
    return total.withColumn("jaccard", F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("all")), F.lit(1.0)))
