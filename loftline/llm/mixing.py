"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, small, table

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size, n) with target double.

    Sources in order of code points, null last, weigh `weights`, repeating. All sizes are shared by weight; no
    target exceeds most * source_size, and the excess goes to the others by weight until none is above. Ordered
    by source_size / weight the capped sources are a prefix, so running sums find the shares in one pass: a
    source is capped when its cap is below what it would get if all before it were capped. The table has one
    row per source.
    """
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sources.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = W.partitionBy(F.lit(0)).orderBy(
        F.col("source_size").cast("double") / F.col("w"), F.col("source").asc_nulls_last()
    )
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("share", F.col("left").cast("double") / F.sum("w").over(onward))
    )
    capped = F.col("cap").cast("double") <= F.col("share") * F.col("w")
    level = F.min(F.when(~capped, F.struct(F.col("source_size").cast("double") / F.col("w"), "share"))).over(whole)
    return rows.withColumn("level", level["share"]).select(
        "source",
        "source_size",
        "n",
        F.when(capped, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken.

    Every document gets a hash-random key from its id and the seed. Within a source the keys are cut into
    sqrt(rows) equal ranges; windows sum the sizes inside a range and over the ranges, so that no task holds
    more than about sqrt(rows) rows of a source, however hot. Of a source with target t and size s, each
    document is taken t div s times whole, and in order of the key the rest is cut at the exact word.

    A null size counts as 0; null and repeated ids are ordered by size, and rows that tie in all of these are
    interchangeable. A source without words has target 0. Reruns agree, as keys depend on ids only.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("key"),
    )
    rows = cut(rows)
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most
    )
    targets = cut(targets.withColumnRenamed("source", "src"))
    joined = rows.join(small(targets), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    joined = joined.withColumn("part", F.floor(share * F.ceil(F.sqrt(F.col("n")))).cast("long"))
    sums = joined.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("src"),
        F.col("part").alias("prt"),
        F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("offset"),
    )
    inside = (
        W.partitionBy("source", "part")
        .orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    placed = joined.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("src")) & (F.col("part") == F.col("prt"))
    )
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div greatest(source_size, 1)")).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.select(
        F.col("doc_id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
    )


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def take(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: whole rows, repeated for each epoch; those of which nothing is taken go.

    A document that the cut divides is taken whole when at least half of it is. Documents without words take
    no budget and go. Ids must be unique; rows that repeat an id are taken as often as the mix says for one.
    """
    plan = mix(docs, words(F.col("text")), **how).where("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = plan.select("doc_id", times.alias("__times")).where("__times > 0").dropDuplicates(["doc_id"])
    plan = plan.withColumnRenamed("doc_id", "__id")
    chosen = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")))
    return chosen.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, words(F.col("text"))).drop("source")


SQL = {
    "op5_mixing": r"""
with d as (select doc_id, source, length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'))
                  - length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '', 'g')) as size from documents),
 s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
 w as (select *, cast(case (row_number() over (order by encode(source) asc nulls last) - 1) % 3
                      when 0 then 5 when 1 then 2 else 1 end as bigint) as w, source_size * 3 as cap from s),
 o as (select *, cast(sum(source_size) over () as bigint)
               - coalesce(cast(sum(cap) over (order by source_size::double / w, encode(source) asc nulls last
                          rows between unbounded preceding and 1 preceding) as bigint), 0) as rest,
              cast(sum(w) over (order by source_size::double / w, encode(source) asc nulls last
                          rows between current row and unbounded following) as bigint) as wsum from w),
 p as (select *, rest::double / wsum as share, cap::double <= (rest::double / wsum) * w as capped from o),
 l as (select min_by(share, source_size::double / w) as level from p where not capped),
 t as (select source, source_size, case when capped then cap::double else l.level * w end as target
       from p left join l on true),
 k as (select d.doc_id, d.size, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as budget,
              coalesce(cast(sum(d.size) over (partition by d.source
                 order by md5('mix-1' || coalesce(cast(d.doc_id as varchar), 'null')), d.doc_id nulls last, d.size
                 rows between unbounded preceding and 1 preceding) as bigint), 0) as before
       from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(case when source_size > 0 then (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) else 0 end as bigint) as taken
from k
"""
}
