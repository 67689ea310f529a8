"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small, table

SHARDS = 40
BITS = 6


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hilbert(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point whose coordinates have so many bits.

    From the highest bit down each coordinate either inverts the low bits of the first one or swaps them with
    its own; a Gray code of the result, read across the coordinates, is the index. Folds over arrays keep the
    expression small: its size does not grow with the bits. Index and coordinates fit a long: len(dims) * bits < 63.
    """
    n = len(dims)
    start = F.array(*[F.coalesce(d, F.lit(0)).cast("long") for d in dims])
    zero = F.lit(0).cast("long")

    def at(x: Column, i: Column) -> Column:
        return F.element_at(x, (i + 1).cast("int"))

    def one(x: Column, i: Column, bit: Column) -> Column:
        low = bit - 1
        own = at(x, i)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swap = at(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))
        swapped = F.when(i == 0, x).otherwise(swapped)
        return F.when(own.bitwiseAND(bit) != 0, inverted).otherwise(swapped)

    def each_bit(x: Column, bit: Column) -> Column:
        return F.aggregate(F.array(*[F.lit(i) for i in range(n)]), x, lambda a, i: one(a, i, bit))

    high_to_low = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    later = F.array(*[F.lit(i) for i in range(1, n)])
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def gray(turned: Column) -> Column:
        return F.aggregate(
            later,
            turned,
            lambda x, i: F.transform(x, lambda v, j: F.when(j == i, v.bitwiseXOR(at(x, i - 1))).otherwise(v)),
        )

    def flip(x: Column) -> Column:
        last = at(x, F.lit(n - 1))
        return F.aggregate(
            high_to_low,
            zero,
            lambda t, bit: F.when(last.bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t),
        )

    def read(x: Column) -> Column:
        return F.aggregate(
            places,
            zero,
            lambda acc, p: acc * 2 + F.call_function("getbit", at(x, p["i"]), p["b"].cast("int")).cast("long"),
        )

    ready = let(
        let(F.aggregate(high_to_low, start, each_bit), gray),
        lambda x: let(flip(x), lambda t: F.transform(x, lambda v: v.bitwiseXOR(t))),
    )
    return let(ready, read)


def log_steps(size: Column, bits: int = BITS) -> Column:
    """Four steps to each doubling of the size, as far as the bits go; null as 0."""
    return F.least(F.floor(F.log2(F.coalesce(size, F.lit(0)) + F.lit(1.0)) * 4), F.lit((1 << bits) - 1))


def ranked(rows: DataFrame, keys: list) -> DataFrame:
    """rows (checkpointed) with __rank from 0 in the order of keys, and __all, their number.

    Range partitioning sorts all rows; the ranges are checkpointed, as a second sampling could move their bounds. The
    rank of a row is its place in its partition plus the rows before that partition; the table of partition
    counts has one row per partition. Equal rows get different ranks; no rows give none.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    ranged = cut(
        ranged.withColumn("__part", F.shiftright(place, 33).cast("int")).withColumn(
            "__pos", place.bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    one = W.partitionBy(F.lit(0))
    counts = counts.select(
        "__part",
        F.coalesce(
            F.sum("__rows").over(one.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__rows").over(one).alias("__all"),
    )
    placed = ranged.join(small(cut(counts)), "__part").withColumn("__rank", F.col("__before") + F.col("__pos"))
    return placed.drop("__part", "__pos", "__before")


def with_place(rows: DataFrame, name: str, place: str, bits: int = BITS) -> DataFrame:
    """rows with the place of a name among all distinct names, in so many bits and in their order; null comes first.

    Neighbouring places are neighbouring names, so that a file's least and greatest name tell what it holds. The
    table of distinct names is broadcast only if it was counted to be small.
    """
    names = ranked(rows.select(F.col(name).alias("__name")).distinct(), [F.col("__name").asc_nulls_first()])
    names = names.select("__name", F.expr(f"__rank * {1 << bits} div __all").cast("long").alias(place))
    return rows.join(small(cut(names)), F.col(name).eqNullSafe(F.col("__name"))).drop("__name")


def curve_shards(rows: DataFrame, dims: list[Column], ties: list[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """rows with curve, shard and slot: sorted by curve index and ties, cut into runs of equal row counts.

    Ties spread points that share an index, so a hot point is cut across partitions. Runs differ by one row at most; the
    first ones are the longer. Nulls in a dimension count as 0. Equal rows get different slots; columns named curve, shard
    and slot are replaced; an empty table gives an empty result.
    """
    kept = [c for c in rows.columns if c not in ("curve", "shard", "slot")]
    placed = ranked(rows.withColumn("__curve", hilbert(dims, bits)), ["__curve", *ties])
    each = F.expr(f"__all div {shards}")
    long_ones = F.col("__all") % shards
    edge = long_ones * (each + 1)
    in_long = F.col("__rank") < edge
    shard = F.when(in_long, F.expr(f"__rank div (__all div {shards} + 1)")).otherwise(
        long_ones + F.floor((F.col("__rank") - edge) / F.greatest(each, F.lit(1)))
    )
    slot = F.when(in_long, F.col("__rank") % (each + 1)).otherwise(
        (F.col("__rank") - edge) % F.greatest(each, F.lit(1))
    )
    return placed.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__curve").alias("curve"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot")
    )


def ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """What file statistics would hold: a row per shard with the least and the greatest value of each column."""
    ends = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions: size, source and language; equal texts of one source and language lie side by side.

    Null texts have 16 bytes; null sources and languages have their own place. Every row gets a slot, repeated ones too.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("source").alias("__source"),
        F.col("lang").alias("__lang"),
        F.xxhash64(text).alias("__content"),
    )
    rows = with_place(with_place(rows, "__source", "__s"), "__lang", "__l")
    dims = [log_steps(F.col("size")), F.col("__s"), F.col("__l")]
    out = curve_shards(rows, dims, [F.col("__content"), F.xxhash64("doc_id"), F.col("doc_id")])
    return out.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


SQL: dict[str, str] = {}
