"""Scans of long ordered groups in blocks: running sums, last values, products of matrices, and ranks by ranges.

A group of any length is cut into blocks by its order. Each block is summed up by itself, the few summaries are scanned, and each
block then starts from what came before it. So no task holds more than a block, or the summaries of one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, small, stored

#: Rows of a block: of one that windows scan, and of one that is folded as an array.
WINDOW_BLOCK, FOLD_BLOCK = 4096, 256
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(
    rows: DataFrame, keys: list[str], at: str, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None,
    ahead: bool = False, own: bool = False, block: int = WINDOW_BLOCK, nexts: dict[str, str] | None = None,
) -> DataFrame:
    """rows with running sums and last known values (new name: column) of the rows before, in the order of `at`, by keys.

    ahead: of the rows behind instead; nexts: nearest known values on the other side; own: with the row's own. A null adds nothing to a
    sum and is no known value. `at` is a whole number that is unique within the keys; rows of a null `at` come first.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    name = "__block"
    order = lambda c, back: F.col(c).desc() if back else F.col(c).asc_nulls_first()
    rows = stored(rows.withColumn(name, F.floor(F.col(at) / block).cast("long")))  # read twice below; a checkpoint would make them twice
    inner, outer = (W.partitionBy(*keys, name).orderBy(order(at, back)).rowsBetween(W.unboundedPreceding, 0 if own else -1) for back in (ahead, not ahead))
    each = [F.sum(c).alias(f"__{n}") for n, c in sums.items()]
    for side, pick in ((lasts, F.min_by if ahead else F.max_by), (nexts, F.max_by if ahead else F.min_by)):
        each += [pick(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), F.col(at))).alias(f"__{n}") for n, c in side.items()]
    before, behind = (W.partitionBy(*keys).orderBy(order(name, back)).rowsBetween(W.unboundedPreceding, -1) for back in (ahead, not ahead))
    starts = rows.groupBy(*keys, name).agg(*each)
    starts = starts.select(
        *keys, name, *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in sums],
        *[F.last(f"__{n}", True).over(w).alias(f"__{n}") for side, w in ((lasts, before), (nexts, behind)) for n in side],
    )
    starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, name])], *[f"__{n}" for n in (*sums, *lasts, *nexts)])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, name])]
    found = {n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()}
    found |= {n: F.last(c, True).over(w) for side, w in ((lasts, inner), (nexts, outer)) for n, c in side.items()}
    inside = rows.withColumns({f"__in_{n}": v for n, v in found.items()}).join(starts, same)
    out = {n: F.col(f"__in_{n}") + F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in sums}
    out |= {n: F.coalesce(F.col(f"__in_{n}"), F.col(f"__{n}.v")) for n in (*lasts, *nexts)}
    return inside.select(*[c for c in rows.columns if c != name], *[v.alias(n) for n, v in out.items()])


def product(a: Column, b: Column) -> Column:
    """Of two 3 x 3 matrices, as arrays of nine numbers by rows."""
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Column) -> Column:
    """Null for a singular matrix."""
    cofactors = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    return let(determinant(m), lambda d: F.when(d != 0, F.array(*[c / d for c in cofactors])))


def cumulative_products(steps: DataFrame, keys: list[str], at: str, step: str = "step", name: str = "pose", block: int = FOLD_BLOCK) -> DataFrame:
    """steps with the product of all steps up to each row, in order: pose of row k = step 1 @ step 2 @ ... @ step k.

    A step is a 3 x 3 matrix as an array of nine numbers; a null repeats the product so far (the identity at the
    start). Blocks of the order are multiplied, their products are scanned in the same way until a group has one, and each block
    multiplies on from what came before; the order within a block is that of a plain loop. `at` is a whole number; rows that
    share it are ordered by their steps. Keys may be null.
    """
    return _scanned(steps, keys, at, step, block).withColumnRenamed("__upto", name).drop("__before")


def _scanned(steps: DataFrame, keys: list[str], at: str, step: str, block: int) -> DataFrame:
    """steps with the products before and up to each row."""
    identity = F.array(*map(F.lit, IDENTITY))
    others = [c for c in steps.columns if c not in keys]
    row = F.struct(F.col(at).alias("__at"), F.col(step).alias("__step"), F.struct(*others).alias("__row"))
    parts = steps.groupBy(*keys, F.floor(F.col(at) / block).cast("long").alias("__block")).agg(F.array_sort(F.collect_list(row), _by_place).alias("__rows"))
    onward = lambda acc, e: F.when(e["__step"].isNull(), acc).otherwise(product(acc, e["__step"]))
    parts = cut(parts.withColumn("__product", F.aggregate("__rows", identity, onward)))
    many = not parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if many:
        upper = parts.select(*keys, F.col("__block").alias("__seq"), F.col("__product").alias("__step"))
        starts = _scanned(upper, keys, "__seq", "__step", block).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__seq"])], F.col("__before").alias("__start"))
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__block"])]
        parts = parts.join(starts, same)
    else:
        parts = parts.withColumn("__start", identity)
    first = F.struct(F.array().cast("array<struct<b:array<double>,u:array<double>>>").alias("out"), F.col("__start").alias("last"))

    def push(acc: Column, e: Column) -> Column:
        put = lambda m: F.struct(F.concat(acc["out"], F.array(F.struct(acc["last"].alias("b"), m.alias("u")))).alias("out"), m.alias("last"))
        return let(onward(acc["last"], e), put)

    walked = F.aggregate("__rows", first, push, lambda acc: acc["out"])
    rows = parts.select(*keys, F.explode(F.arrays_zip(F.col("__rows.__row").alias("r"), walked.alias("m"))).alias("z"))
    return rows.select(*keys, *[F.col(f"z.r.{c}").alias(c) for c in others], F.col("z.m.b").alias("__before"), F.col("z.m.u").alias("__upto")).select(
        *steps.columns, "__before", "__upto"
    )


def _by_place(a: Column, b: Column) -> Column:
    """Order by place, then by step; nulls first."""
    left, right = F.struct(a["__at"], a["__step"]), F.struct(b["__at"], b["__step"])
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows (checkpointed) with place, their number from 0 within the keys by `order`, and n, the rows of the keys.

    Rows are range-partitioned by keys and order, so those of a group lie one after the other over the partitions, and the places follow
    from row numbers and a row for each group and border between partitions. No group has to fit a task.
    """
    rows = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__count"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # a row for each partition then
    before = group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("__count").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__count").over(group).alias("n"),
    )
    same = [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    found = rows.join(small(cut(parts)), same).withColumn("place", F.col("__at") + F.col("__shift"))
    return found.drop("__at", "__part", "__p", "__shift", *[f"__k{i}" for i in range(len(keys))])


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, joined on keys that may be null; one row without any keys."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]).drop(*[f"__r{i}" for i in range(len(keys))])


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float], others: dict | None = None) -> DataFrame:
    """keys, n and the quantiles (name: share) of the known values, on the line between the two nearest ranks.

    others: further aggregates of the values (name: function). Values are ranked by ranges, and each task answers with a row for each of its
    groups; a group may be as large as the table. NaN counts as unknown. Groups without known values have no row.
    """
    known = rows.select(*keys, F.col(column).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    placed = ranked(known, keys, ["__v"])
    spots = {name: (F.col("n") - 1) * share for name, share in shares.items()}
    parts = []
    for name, s in spots.items():
        parts += [F.max(F.when(F.col("place") == f(s), F.col("__v"))).alias(f"__{side}_{name}") for side, f in (("low", F.floor), ("high", F.ceil))]
    parts += [f("__v").alias(name) for name, f in (others or {}).items()]
    found = placed.groupBy(*keys).agg(F.max("n").alias("n"), *parts).where("n is not null")
    line = [
        (F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * (s - F.floor(s))).alias(n) for n, s in spots.items()
    ]
    return found.select(*keys, "n", *line, *(others or {}))
