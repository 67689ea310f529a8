"""Search over variants of a query (angle and scale) in stages, of which later ones see only queries that are still open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .retrieval import topk

#: Scores at which a query is closed: by the prior or a stage, and by the prior where scales are searched.
RESCAN, SCALE_RESCAN = 0.70, 0.65


def staged_search(variants: DataFrame, refs: DataFrame, least: float = RESCAN, prior_least: float = min(RESCAN, SCALE_RESCAN)) -> DataFrame:
    """The best (query_id, stage, place, ref_id, score) over the variants of each query, and tried, the variants that were scored.

    variants: query_id, stage, place, vector. Stage 0 holds the variants of a prior: the best of them is taken if its score is
    `prior_least` or more, else it is forgotten. Later stages go in order; a query stops after the stage in which its
    best so far is `least` or more. Of equal scores the lower stage and place wins. Scores are cosines with all refs (ref_id, vector).
    A query none of whose variants has a vector has no row.
    """
    numbered = cut(variants.where("vector is not null").withColumn("variant_id", F.monotonically_increasing_id()))
    stages = sorted(r.stage for r in numbered.select("stage").distinct().collect())  # a handful, as the plan has them
    best = None
    for stage in stages:
        rows = numbered.where(F.col("stage") == stage)
        if best is not None:
            closed = best.where(F.col("score") >= F.when(F.col("stage") == 0, prior_least).otherwise(least)).select("query_id")
            rows = rows.join(closed, "query_id", "left_anti")
        found = topk(rows.select(F.col("variant_id").alias("query_id"), "vector"), refs, 1)
        found = found.select(F.col("query_id").alias("variant_id"), "ref_id", "score")
        one = F.struct((-F.col("score")).alias("s"), "stage", "place", "ref_id", "score")
        new = rows.select("query_id", "stage", "place", "variant_id").join(found, "variant_id", "left")
        new = new.groupBy("query_id").agg(F.count(F.lit(1)).alias("tried"), F.min(F.when(F.col("score").isNotNull(), one)).alias("b"))
        new = new.select("query_id", "tried", "b.stage", "b.place", "b.ref_id", "b.score")
        if best is None:
            best = cut(new)
            continue
        # What the prior found too low does not count against the other stages.
        old = best.withColumns({c: F.when((F.col("stage") > 0) | (F.col("score") >= prior_least), F.col(c)) for c in ("stage", "place", "ref_id", "score")})
        both = old.unionByName(new).groupBy("query_id").agg(F.sum("tried").alias("tried"), F.min(F.when(F.col("score").isNotNull(), one)).alias("b"))
        best = cut(both.select("query_id", "tried", "b.stage", "b.place", "b.ref_id", "b.score"))
    if best is None:
        return numbered.select("query_id", F.lit(0).cast("bigint").alias("tried"), "stage", "place", F.col("variant_id").alias("ref_id"), F.lit(0.0).alias("score"))
    return best.where("score is not null")
