"""Exact deduplication: 128-bit content hash, byte comparison inside groups, one row of each group stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, cut, join_hot, table, unused


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    keep: str = "min",
    hash128: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows belong together when their normalised texts have the same bytes; a null text counts as empty.
    The texts are grouped by (hash, text): the map side collapses copies before the shuffle, so a group
    that holds a third of all rows leaves one row per map task, and the hash table compares bytes. Rows
    get their group back by the hash alone, those of hot groups by a broadcast; only hashes that stand for several
    texts (collisions) are joined by their text as well.

    keep: "min" or "max" id of the group stays. A null id never wins against another id; where all ids
    of a group are null, keep_id is null and its rows count as kept. Rows that repeat both id and text
    are all marked alike. An empty table gives an empty result; other columns are ignored.
    """
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("h", hash128(F.col("t")))
    pick = {"min": F.min, "max": F.max}[keep]
    groups = rows.groupBy("h", "t").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.select("h", F.sha2(F.col("t"), 256).alias("text_sha256"), "keep_id", "group_size"))
    several = cut(groups.groupBy("h").count().where("count > 1").select("h"))
    single = groups
    parts = []
    narrow = rows.select("doc_id", "h")
    if not several.isEmpty():
        # Another text has the same hash: only these rows are told apart by their bytes.
        clashing = rows.join(several, "h", "left_semi")
        own = clashing.groupBy("h", "t").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        parts.append(
            clashing.join(own, ["h", "t"]).select(
                "doc_id", F.sha2(F.col("t"), 256).alias("text_sha256"), "keep_id", "group_size"
            )
        )
        single = groups.join(several, "h", "left_anti")
        narrow = narrow.join(several, "h", "left_anti")
    parts.append(join_hot(narrow, single, "h", "group_size", ["text_sha256", "keep_id", "group_size"]).drop("h"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _ordered(kind: T.DataType) -> bool:
    """Whether values of the type can be compared."""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def drop_copies(docs: DataFrame, keep: str = "max", **how) -> DataFrame:
    """docs without the rows that exact_groups does not keep; of rows that repeat id and text, one stays.

    The kept row is found by aggregating whole rows under (hash, text), so copies collapse before the
    shuffle and no join is needed. Ties between rows of equal id and text go to the largest other columns, as far as
    they have an order (maps have none). A null text is empty; a null id never wins against another. Columns may have
    any names; an empty table gives an empty result.
    """
    text = how.get("normalise", ascii_lower)(F.coalesce(F.col("text"), F.lit("")))
    others = [f"`{f.name}`" for f in docs.schema.fields if f.name not in ("doc_id", "text") and _ordered(f.dataType)]
    best = {"min": F.min_by, "max": F.max_by}[keep]
    order = F.struct("doc_id", *others) if keep == "max" else F.struct(F.col("doc_id").isNull(), "doc_id", *others)
    t, h, row = (unused(name, *docs.columns) for name in ("__t", "__h", "__row"))
    rows = docs.select("*", text.alias(t)).withColumn(h, how.get("hash128", md5_128)(F.col(t)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return rows.groupBy(h, t).agg(best(whole, order).alias(row)).select(f"{row}.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


SQL = {
    "op10_exact_dedup": r"""
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
           from documents),
     g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, (d.doc_id = g.keep_id) as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
}
