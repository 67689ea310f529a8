"""Jaccard join of shingle sets, filtered under several global token orders at once.

Two sets with Jaccard similarity t share a token among the first n - ceil(t n) + 1 tokens of each, under any
order of all tokens. Order 1 is by the counts of a sketch (rare first) and makes the candidates; orders 2 and
3 are pseudo-random, and a candidate pair must share a prefix token under each of them too. Three more bounds
prune without losing a pair: the lengths, the tokens that can still follow a shared one in order 1, and the number of
differing bits between parity bitmaps, which bounds the symmetric difference from below. Pairs left are
verified on their whole sets.

Equal sets form a class and take part once. Only connections matter, so pairs inside a component are not
expanded: each class is first compared with a few hubs of each of its tokens, those that have the fewest rarer
tokens and so lie in the middle of a cluster. The components that these links make are contracted, and all
pairs of a token's classes that lie in different components are compared then. The same two steps serve
small groups, which have no more classes than hubs, and large ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_hot, released, small, table
from .components import components
from .shingles import chunks, mix, shingle_sets

#: Buckets of the count sketch and bits of the filter of live classes: fixed sizes, whatever the input.
SKETCH_BITS = 18
LIVE_BITS = 24
#: 64-bit words of a parity bitmap, and of the folded one that goes with postings.
PARITY_WORDS, FOLDED_WORDS = 16, 4
HUBS = 8
#: Classes that a task remembers, so that it sends each of them once; forgotten beyond.
SEEN = 200_000
_U = np.uint64
_ORDER_SALT = (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F))
_CLASS_SALT = (_U(0x2545F4914F6CDD1D), _U(0x9FB21C651E98DF25))


def _batches(batches: Iterator[pa.RecordBatch], k: int):
    """For each chunk of each batch: its other columns, set sizes, offsets and all hashes."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
        for a, b in chunks(texts):
            values, sizes = shingle_sets(texts[a:b], k)
            yield batch.slice(a, b - a), sizes, np.concatenate([[0], np.cumsum(sizes)]), values


def _sums(values: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _class_keys(values: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; None for empty sets."""
    pair = np.stack([_sums(mix(values ^ s), sizes, offsets) for s in _CLASS_SALT], 1)
    raw = np.ascontiguousarray(pair.astype(">u8")).tobytes()
    return [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes)]


def _parity(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set the bits that an odd number of its hashes fall on, as 64-bit words."""
    bits = PARITY_WORDS * 64
    place = np.repeat(np.arange(len(sizes)) * bits, sizes) + ((values >> _U(3)) & _U(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sizes) * bits) & 1).astype(np.uint8).reshape(len(sizes), bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _short(key: bytes | None) -> int | None:
    """The first 64 bits of a class, which stand for it in postings."""
    return None if key is None else int.from_bytes(key[:8], "big", signed=True)


_FOLDED = [f"f{w}" for w in range(FOLDED_WORDS)]


class _Seen(set):
    """Classes that a task has met, up to a bound."""

    def first(self, key: bytes) -> bool:
        if key in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(key)
        return True


def _classes(k: int):
    """Rows of documents and, as the last of a task, the counts of its tokens by bucket.

    A document has its id, n, node (the class, null for empty sets) and, where its task meets the class for the first
    time, the parity words.
    """

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        seen, ids = _Seen(), pa.null()
        for rows, sizes, offsets, values in _batches(batches, k):
            counts += np.bincount((values >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            keys = _class_keys(values, sizes, offsets)
            parity, ids = _parity(values, sizes), rows.column(0).type
            words = [x if key is not None and seen.first(key) else None for key, x in zip(keys, parity, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(words, pa.list_(pa.int64())),
                 pa.nulls(len(keys), pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "parity", "counts"],
            )
        if counts.any():
            one = pa.array([counts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, ids), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), one],
                ["doc_id", "n", "node", "parity", "counts"],
            )

    return run


def count_levels(counts: DataFrame) -> tuple[np.ndarray, int]:
    """A level for each bucket of the sketch, four to a doubling of its count, and the level of heavy buckets.

    Every order of all tokens gives right results; the counts only make it a good one.
    """
    found = counts.select(F.posexplode("counts").alias("bucket", "count")).where("count > 0")
    found = cut(found.groupBy("bucket").agg(F.sum("count").alias("count")))
    total = found.agg(F.sum("count")).first()[0] or 0
    level = F.least(F.lit(254), F.ceil(F.log2(F.col("count") + F.lit(1.0)) * 4)).cast("int")
    rows = found.select("bucket", level.alias("level")).toPandas()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    levels[rows["bucket"].to_numpy(dtype=np.int64)] = rows["level"].to_numpy(dtype=np.uint8)
    return levels, min(254, int(np.ceil(np.log2(4 * total / len(levels) + 64) * 4)))


def _rare_first(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Keys of order 1: level above, 56 bits of the hash below."""
    level = levels[(values >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return (level << _U(56)) | (mix(values) >> _U(8))


def _prefix(keys: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    length = n - -(-num * n // den) + 1
    return np.sort(np.partition(keys, length - 1)[:length]) if length < n else np.sort(keys)


def _postings(k: int, num: int, den: int, levels):
    """The prefix of each class under order 1: token, the class and how many of its tokens come before."""

    def run(batches):
        seen = _Seen()
        for _, sizes, offsets, values in _batches(batches, k):
            order = _rare_first(values, levels.value)
            tokens, nodes = [], []
            for i, key in enumerate(_class_keys(values, sizes, offsets)):
                if key is not None and seen.first(key):
                    tokens.append(_prefix(order[offsets[i] : offsets[i + 1]], int(sizes[i]), num, den))
                    nodes.append(_short(key))
            if tokens:
                counts = [len(x) for x in tokens]
                at = np.repeat(np.arange(len(nodes)), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.array(nodes, np.int64)[at]),
                        pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in counts])),
                    ],
                    ["token", "short", "pos"],
                )

    return run


def _sets(texts: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node, n, prefixes under orders 2 and 3 and the whole set of the classes in pairs (and a few more).

    A filter of fixed size says which classes are wanted, so that others are not sent.
    """
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    live = texts.sparkSession.sparkContext.broadcast(_live_filter(wanted))

    def run(batches):
        seen = _Seen()
        for _, sizes, offsets, values in _batches(batches, k):
            rows = []
            for i, key in enumerate(_class_keys(values, sizes, offsets)):
                if key is None:
                    continue
                at = int.from_bytes(key[:3], "big")
                if live.value[at >> 3] >> (at & 7) & 1 and seen.first(key):
                    rows.append((i, key))
            if not rows:
                continue
            of = [values[offsets[i] : offsets[i + 1]] for i, _ in rows]
            other = [[_prefix(mix(v ^ s), len(v), num, den).astype(np.uint32).view(np.int32) for v in of] for s in _ORDER_SALT]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key for _, key in rows], pa.binary()), pa.array([len(v) for v in of], pa.int64())]
                + [pa.array(x, pa.list_(pa.int32())) for x in other]
                + [pa.array([v.view(np.int64) for v in of], pa.list_(pa.int64()))],
                ["node", "n", "p2", "p3", "tokens"],
            )

    found = texts.mapInArrow(run, "node binary, n bigint, p2 array<int>, p3 array<int>, tokens array<bigint>")
    return found.dropDuplicates(["node"])


def _live_postings(texts: DataFrame, k: int, num: int, den: int, levels, heavy: int) -> DataFrame:
    """Postings whose token several classes have in their prefix.

    Tokens of light buckets have few postings and are counted by token; those of heavy buckets, whose groups
    have no bound, are kept without looking.
    """
    light = F.shiftrightunsigned("token", 56) < heavy
    posts = texts.mapInArrow(_postings(k, num, den, levels), "token bigint, short bigint, pos int")
    first = posts.where(light).repartition("token").dropDuplicates(["token", "short"])
    counted = first.withColumn("group", F.count(F.lit(1)).over(W.partitionBy("token")))
    rest = posts.where(~light).dropDuplicates(["token", "short"])
    return counted.where("group > 1").drop("group").unionByName(rest)


def _live_filter(nodes: DataFrame) -> bytes:
    """A bit for the first LIVE_BITS bits of each class, in a string of fixed size."""
    at = nodes.select(F.conv(F.hex(F.substring("node", 1, LIVE_BITS // 8)), 16, 10).cast("long").alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (LIVE_BITS - 6), "<i8")
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.tobytes()


def _folded() -> list[Column]:
    """Words f of a shorter bitmap: parities of fewer, larger buckets."""
    words = [[F.get("parity", F.lit(i)) for i in range(w, PARITY_WORDS, FOLDED_WORDS)] for w in range(FOLDED_WORDS)]
    return [reduce(lambda x, y: x.bitwiseXOR(y), part).alias(f"f{w}") for w, part in enumerate(words)]


def _may_link(num: int, den: int, a: str, b: str, differ: Column) -> Column:
    """Length and parity filters between two sides."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.greatest(n, m) * num <= F.least(n, m) * den) & (differ * (den + num) <= (n + m) * (den - num))


def _enough_follow(num: int, den: int) -> Column:
    """Of postings a and b of a token: with what comes behind it in both, the overlap can be large enough.

    This holds at the first token that the two sets of a link share, so every link passes at one token at least.
    """
    most = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return most * (den + num) >= (F.col("a.n") + F.col("b.n")) * num


def _refine(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of class numbers as pairs (u, v) of classes that the whole bitmaps let pass.

    far is the part of their tokens that the two differ in at least.
    """
    brief = F.struct("node", "n", "parity")
    x, y = (classes.select(F.col("id").alias(name), brief.alias(side)) for name, side in (("a", "x"), ("b", "y")))
    bits = F.zip_with("x.parity", "y.parity", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long"))
    near = pairs.join(x, "a").join(y, "b")
    near = near.withColumn("differ", F.aggregate(bits, F.lit(0).cast("long"), lambda p, q: p + q))
    near = near.where(_may_link(num, den, "x", "y", F.col("differ")))
    far = F.col("differ") / (F.col("x.n") + F.col("y.n"))
    return near.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), far.alias("far"))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs (u, v) those that pass orders 2 and 3 and whose sets are similar."""
    a = sets.select(F.col("node").alias("u"), F.struct("n", "p2", "p3", "tokens").alias("x"))
    b = sets.select(F.col("node").alias("v"), F.struct("n", "p2", "p3", "tokens").alias("y"))
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return (
        pairs.join(a, "u")
        .join(b, "v")
        .where(F.arrays_overlap("x.p2", "y.p2") & F.arrays_overlap("x.p3", "y.p3"))
        .where(shared * (num + den) >= (F.col("x.n") + F.col("y.n")) * num)
        .select("u", "v")
    )


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each class the pair with the class that it differs from least: no more pairs than classes."""
    pair = F.struct("far", "u", "v")
    ends = pairs.select(F.col("u").alias("node"), pair.alias("pair")).unionByName(pairs.select(F.col("v").alias("node"), pair.alias("pair")))
    return ends.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.u", "pair.v").distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) whose ends lie in different components, or in none; roots: node, root."""
    for side in ("u", "v"):
        of = roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        pairs = pairs.join(of, side, "left")
    apart = ~F.coalesce(F.col("u_root") == F.col("v_root"), F.lit(False))
    return pairs.where(apart).select("u", "v")


def _links(texts: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    return cut(_verify(pairs, _sets(texts, pairs, k, num, den), num, den))


def _hub_pairs(posts: DataFrame, hubs: int, num: int, den: int) -> DataFrame:
    """Each class with up to so many hubs of each of its tokens: those with the smallest part of rarer tokens.

    row_number under a bound is limited before and after the shuffle, so no task sorts a hot group whole.
    """
    order = W.partitionBy("token").orderBy(F.col("pos") / F.col("n"), "id")
    chosen = posts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= hubs).drop("r")
    return _pairs(posts, chosen, F.col("a.id") != F.col("b.id"), num, den)


def _cross_pairs(posts: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of a token group that lie in different components (roots: id, root).

    Of each group the largest component stands on one side only: its members meet the others of the group,
    never each other.
    """
    placed = posts.join(small(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    count = placed.groupBy("token", "root").count()
    mixed = count.groupBy("token").agg(
        F.max_by("root", F.struct("count", "root")).alias("big"), F.count(F.lit(1)).alias("roots")
    )
    placed = cut(placed.join(mixed.where("roots > 1").select("token", "big"), "token"))
    apart = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.big")) | (F.col("a.id") < F.col("b.id")))
    return _pairs(placed.where("root != big"), placed, apart, num, den)


def _pairs(a: DataFrame, b: DataFrame, which: Column, num: int, den: int) -> DataFrame:
    """Distinct class numbers (a, b) of postings that share a token and pass the filters that postings allow."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in _FOLDED])
    near = (F.col("a.token") == F.col("b.token")) & which & _enough_follow(num, den) & _may_link(num, den, "a", "b", differ)
    found = a.alias("a").join(b.alias("b"), near)
    return found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def _placed(named: DataFrame, k: int, num: int, den: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): doc_id, n and node of each, and of each node its copies and component_id; both are checkpointed."""
    texts = named.select("text")
    kind = named.schema["doc_id"].dataType.simpleString()
    rows = cut(
        named.mapInArrow(_classes(k), f"doc_id {kind}, n bigint, node binary, parity array<bigint>, counts array<bigint>")
    )
    levels, heavy = count_levels(rows.where("counts is not null"))
    rows = rows.where("counts is null").drop("counts")
    classes = rows.where("node is not null").groupBy("node")
    classes = classes.agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"),
        F.first("parity", ignorenulls=True).alias("parity"),
    )
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    posts = _live_postings(texts, k, num, den, named.sparkSession.sparkContext.broadcast(levels), heavy)
    short = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long").alias("short")
    posts = cut(posts.join(classes.select(short, "id", "n", *_folded()), "short").drop("short"))

    # Each class with its nearest hub first: sets are sent for no more pairs than classes, and most links are found.
    pairs = cut(_refine(_hub_pairs(posts, hubs, num, den), classes, num, den))
    nearest = cut(_nearest(pairs))
    links = _links(texts, nearest, k, num, den)
    roots = cut(components(links))
    numbers = classes.select("id", "node")
    numbered = roots.join(numbers, "node").select("id", F.col("root").alias("node")).join(
        numbers.withColumnRenamed("id", "of_root"), "node"
    )
    rest = _cross_pairs(posts, cut(numbered.select("id", F.col("of_root").alias("root"))), num, den)
    rest = _refine(rest, classes, num, den).select("u", "v").unionByName(_between(pairs, roots)).distinct()
    rest = cut(rest.join(nearest, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(_links(texts, rest, k, num, den))
        roots = cut(components(links))

    grouped = roots.join(classes.select("node", "least"), "node")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = grouped.join(least, "root").select("node", F.col("component_id").alias("joined"))
    placed = classes.join(linked, "node", "left").select("node", "copies", F.coalesce("joined", "least").alias("component_id"))
    return rows.select("doc_id", "n", "node"), cut(placed)


def jaccard_components(
    docs: DataFrame, k: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", hubs: int = HUBS
) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Two documents link when den * |intersection| >= num * |union| of their sets of distinct k-word shingles;
    component_id is the smallest id reachable by links. Ids may be of any type that has an order. Null and empty
    texts and texts of white space have no shingles and link with nothing, each its own component (rows that
    repeat such an id share it). A null id loses against any other of its component. Texts of any length are
    taken whole; repeated rows belong together. Shingles are compared by 64-bit and classes by 128-bit hashes.
    Columns other than the two are not looked at. An empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with released(docs.sparkSession):
        rows, placed = _placed(named, k, num, den, hubs)
    found = join_hot(rows, placed, "node", "copies", ["component_id"])
    return found.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those that are linked with others but are not the first of their component.

    The document whose id is its component's stays; documents without words all stay.
    """
    found = jaccard_components(docs, k, num, den).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = found.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


SQL: dict[str, str] = {}
