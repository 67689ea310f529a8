"""Near-duplicate detection by b-bit MinHash.

Of each set the minima of BANDS * ROWS hash functions are taken. Band keys, hashes of ROWS minima, make the candidates; only the
BITS low bits of each minimum are kept, as BITS planes of one bit a lane, so that the lanes in which two signatures agree are
counted by xor, or and bit_count. Two lanes agree by chance in one of 2 ** BITS cases, and the estimate is corrected for that.
Candidates whose estimate is high enough, and whose parity bitmaps do not prove that they differ in too many tokens, are
confirmed on their full sets.

Equal sets form a class and take part once. Only connections matter: each class is first compared with a few hubs of each of
its bands, those that meet most others, and confirmed with the nearest; the links make components, and other pairs with hubs, then
those of a band, follow where they lie in different components. So a group of any number of copies is never expanded into its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_hot, released, small, table
from .components import components
from .ngram_join import PARITY_WORDS, _batches, _between, _class_keys, _live_filter, _nearest, _parity, _Seen
from .shingles import mix

#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS, BITS = 32, 4, 4
LANES = BANDS * ROWS
WORDS = LANES // 64
#: Standard deviations below its mean at which an estimate is too low; a normal variable lies below with 1e-8.
SIGMAS = 5.6
HUBS = 8
#: Shingles that are hashed by all functions at once: a step's table has so many rows of LANES numbers.
STEP = 4096
_U = np.uint64
_FACTORS = mix(np.arange(1, LANES + 1, dtype=np.uint64)) | _U(1)
_SHIFTS = mix(np.arange(1, LANES + 1, dtype=np.uint64) + _U(1 << 32))
_LOW = (1 << BITS) - 1


def minima(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The minimum of each hash function (column) over the hashes of each set (row); sets are not empty.

    The functions are multiplications modulo 2 ** 64 by odd factors, of which the high 32 bits are compared.
    """
    out = np.full((len(sizes), LANES), np.iinfo(np.uint32).max, np.uint32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(values), STEP):
        part, of = values[a : a + STEP, None], owner[a : a + STEP]
        hashes = ((part * _FACTORS + _SHIFTS) >> _U(32)).astype(np.uint32)
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.minimum(out[of[first]], np.minimum.reduceat(hashes, first, axis=0))
    return out


def planes(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima: BITS planes of WORDS 64-bit words for each row."""
    low = mix(least.astype(np.uint64)) & _U(_LOW)
    bits = np.stack([(low >> _U(b) & _U(1)).astype(np.uint8) for b in range(BITS)], 1)
    return np.packbits(bits, axis=2).view(">u8").astype(np.uint64).view(np.int64).reshape(len(least), BITS * WORDS)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    keys = np.zeros((len(least), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys ^ least[:, r::ROWS].astype(np.uint64)) + _U(r)
    return mix(keys ^ mix(np.arange(BANDS, dtype=np.uint64)))


def fewest_equal(num: int, den: int) -> int:
    """Lanes that agree, at least, in all but about 1e-8 of the pairs whose similarity is num / den."""
    agree = num / den + (1 - num / den) / (1 << BITS)
    return max(0, math.floor(LANES * agree - SIGMAS * math.sqrt(LANES * agree * (1 - agree))))


def equal_lanes(a: str, b: str) -> Column:
    """Number of lanes in which two rows' signatures agree."""
    differ = [reduce(Column.bitwiseOR, [F.col(f"{a}.s{p * WORDS + w}").bitwiseXOR(F.col(f"{b}.s{p * WORDS + w}")) for p in range(BITS)]) for w in range(WORDS)]
    return LANES - reduce(lambda x, y: x + y, [F.bit_count(d) for d in differ])


def similarity(equal: Column) -> Column:
    """The estimate from the lanes that agree, corrected for those that agree by chance."""
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (equal / LANES - chance) / (1 - chance))


SIGNATURE = [f"s{k}" for k in range(BITS * WORDS)]
PARITY = [f"f{k}" for k in range(PARITY_WORDS // 2)]


def _fewest_differing(a: str, b: str) -> Column:
    """Tokens that only one of two sets has, at least: an odd number of them lies behind each bit in which the parities differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in PARITY])


def _classes(k: int):
    """id, n and node (128 bits of the set; null for empty ones) and, where its task meets a class first, signature with parities and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for rows, sizes, offsets, values in _batches(batches, k):
            keys = _class_keys(values, sizes, offsets)
            new = [i for i, key in enumerate(keys) if key is not None and seen.first(key)]
            sign: list[list[int] | None] = [None] * len(keys)
            bands = list(sign)
            if new:
                own = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in new])
                least, parity = minima(own, sizes[new]), _parity(own, sizes[new])
                both = np.concatenate([planes(least), parity[:, : len(PARITY)] ^ parity[:, len(PARITY) :]], 1)
                for i, s, b in zip(new, both, band_keys(least).view(np.int64), strict=True):
                    sign[i], bands[i] = s, b
            columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (sign, bands)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "sign", "bands"])

    return run


def _sets(texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """node, n and the whole set of the classes in pairs; a filter of fixed size says which are wanted."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    live = texts.sparkSession.sparkContext.broadcast(_live_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for _, _, offsets, values in _batches(batches, k):
            rows = []
            for i, key in enumerate(_class_keys(values, np.diff(offsets), offsets)):
                if key is not None:
                    at = int.from_bytes(key[:3], "big")
                    if live.value[at >> 3] >> (at & 7) & 1 and seen.first(key):
                        rows.append((key, values[offsets[i] : offsets[i + 1]].view(np.int64)))
            if rows:
                found = [pa.array([key for key, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(found, ["node", "tokens"])

    return texts.mapInArrow(run, "node binary, tokens array<bigint>").dropDuplicates(["node"])


def _confirmed(texts: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of distinct pairs (u, v) those whose full sets are similar."""
    sets = _sets(texts, pairs, k)
    a, b = (sets.select(F.col("node").alias(c), F.col("tokens").alias(t)) for c, t in (("u", "x"), ("v", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v")
    return cut(both.where(shared * (num + den) >= (F.size("x") + F.size("y")) * num).select("u", "v"))


def _candidates(a: DataFrame, b: DataFrame, which: Column, num: int, den: int) -> DataFrame:
    """Distinct (a, b, far) of band postings that share a key, with lengths, estimates and parities that allow a link."""
    near = (F.col("a.band") == F.col("b.band")) & which
    near &= F.greatest("a.n", "b.n") * num <= F.least("a.n", "b.n") * den
    near &= equal_lanes("a", "b") >= fewest_equal(num, den)
    near &= _fewest_differing("a", "b") * (den + num) <= (F.col("a.n") + F.col("b.n")) * (den - num)
    found = a.alias("a").join(b.alias("b"), near)
    far = 1.0 - similarity(equal_lanes("a", "b"))
    return found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), far.alias("far")).distinct()


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of class numbers as pairs (u, v) of classes."""
    u, v = (classes.select(F.col("id").alias(n), F.col("node").alias(node)) for n, node in (("a", "u"), ("b", "v")))
    return pairs.join(u, "a").join(v, "b").select("u", "v", "far")


def _placed(named: DataFrame, k: int, num: int, den: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): doc_id, n and node of each, and of each node its copies and component_id; both are checkpointed."""
    texts = named.select("text")
    kind = named.schema["doc_id"].dataType.simpleString()
    rows = cut(named.mapInArrow(_classes(k), f"doc_id {kind}, n bigint, node binary, sign array<bigint>, bands array<bigint>"))
    classes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("sign", ignorenulls=True).alias("sign")
    )
    words = [F.get("sign", F.lit(i)).alias(c) for i, c in enumerate(SIGNATURE + PARITY)]
    classes = cut(classes.select("node", "least", "n", "copies", *words).withColumn("id", F.monotonically_increasing_id()))

    # Postings of keys that several classes have, with what the estimate needs.
    posts = rows.where("bands is not null").select(F.explode("bands").alias("band"), _number("node").alias("short"))
    posts = posts.repartition("band").dropDuplicates(["band", "short"])
    live = cut(posts.withColumn("group", F.count(F.lit(1)).over(W.partitionBy("band"))).where("group > 1"))
    # A class that meets many others lies in the middle of its cluster.
    met = live.groupBy("short").agg(F.sum("group").alias("met"))
    known = classes.select(_number("node").alias("short"), "id", "n", *SIGNATURE, *PARITY).join(met, "short")
    posts = cut(live.drop("group").join(known, "short").drop("short"))

    # Each class with its nearest hub first: sets are sent for no more pairs than classes, and most links are found.
    order = W.partitionBy("band").orderBy(F.col("met").desc(), "id")
    chosen = posts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= hubs).drop("r")
    pairs = cut(_named(_candidates(posts, chosen, F.col("a.id") != F.col("b.id"), num, den), classes))
    nearest = cut(_nearest(pairs))
    links = _confirmed(texts, nearest, k, num, den)
    roots = cut(components(links))
    # Then the other pairs with hubs whose ends lie in different components.
    others = cut(_between(pairs.join(nearest, ["u", "v"], "left_anti"), roots))
    if not others.isEmpty():
        links = cut(links.unionByName(_confirmed(texts, others, k, num, den)))
        roots = cut(components(links))

    # What is left: all pairs of a band whose ends lie in different components.
    numbers = classes.select("id", "node")
    numbered = roots.join(numbers, "node").select("id", F.col("root").alias("node")).join(numbers.withColumnRenamed("id", "of_root"), "node")
    rest = _named(_cross(posts, cut(numbered.select("id", F.col("of_root").alias("root"))), num, den), classes)
    rest = cut(rest.select("u", "v").join(nearest.unionByName(others), ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(_confirmed(texts, rest, k, num, den))
        roots = cut(components(links))

    grouped = roots.join(classes.select("node", "least"), "node")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = grouped.join(least, "root").select("node", F.col("component_id").alias("joined"))
    placed = classes.join(linked, "node", "left").select("node", "copies", F.coalesce("joined", "least").alias("component_id"))
    return rows.select("doc_id", "n", "node"), cut(placed)


def near_duplicates(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", hubs: int = HUBS
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Two documents link when den * |intersection| >= num * |union| of their sets of distinct k-word shingles; every link
    returned is confirmed on full sets. A pair at the bound is missed by bands and estimate together with a probability below
    1e-7 at 0.8, less above it; equal sets always meet. component_id is the smallest id reachable, kept whether it is the row's own.
    Ids may be of any type that has an order. Null and empty texts and texts of white space have no shingles and link with
    nothing. A null id loses against any other of its component and is kept only where all of it are null. Texts of any
    length are taken whole; repeated rows belong together and are marked alike. Other columns are not looked at. No rows
    give no rows. Shingles are compared by 64-bit and classes by 128-bit hashes.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with released(docs.sparkSession):
        rows, placed = _placed(named, k, num, den, hubs)
    found = join_hot(rows, placed, "node", "copies", ["component_id"])
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _number(node: str) -> Column:
    """The first 64 bits of a class, which stand for it in postings."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def _cross(posts: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a band that lie in different components (roots: id, root); the largest component of a band stands on one side only."""
    placed = posts.join(small(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    count = placed.groupBy("band", "root").count()
    mixed = count.groupBy("band").agg(F.max_by("root", F.struct("count", "root")).alias("big"), F.count(F.lit(1)).alias("roots"))
    placed = cut(placed.join(mixed.where("roots > 1").select("band", "big"), "band"))
    apart = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.big")) | (F.col("a.id") < F.col("b.id")))
    return _candidates(placed.where("root != big"), placed, apart, num, den)


def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, num=80, den=100)


SQL = {
    "op13_bbit_minhash": r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
 s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w
   else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as t from d),
 ranked as (select *, min(doc_id) over (partition by list_sort(t)) as class from s),
 one as (select class, any_value(t) as t from ranked where doc_id = class and len(t) > 0 group by class),
 token as (select class, unnest(t) as t, len(t) as n from one),
 counted as (select *, count(*) over (partition by t) as c from token),
 prefix as (select class, t, n from counted qualify row_number() over (partition by class order by c, t) <= n - ceil(n * 80 / 100.0)::bigint + 1),
 pair as (select distinct a.class as u, b.class as v from prefix a join prefix b on a.t = b.t and a.class < b.class where greatest(a.n, b.n) * 80 <= least(a.n, b.n) * 100),
 link as (select u, v from pair join one a on a.class = u join one b on b.class = v
   where 180 * len(list_intersect(a.t, b.t)) >= 80 * (len(a.t) + len(b.t))),
 both_ways as (select u, v from link union all select v, u from link),
 reach(node, other) as (select class, class from one union select r.node, l.v from reach r join both_ways l on l.u = r.other),
 least as (select node, min(other) as component_id from reach group by node)
select r.doc_id, len(r.t)::bigint as n_shingles, case when len(r.t) = 0 then r.doc_id else l.component_id end as component_id,
  r.doc_id = case when len(r.t) = 0 then r.doc_id else l.component_id end as kept
from ranked r left join least l on l.node = r.class
"""
}
