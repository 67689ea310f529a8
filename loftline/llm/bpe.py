"""Byte-level BPE: ranked merges folded over the bytes of distinct words by higher-order functions.

The words of the corpus are counted, and the most frequent ones, up to a fixed number, are encoded in SQL: a
word is an array of byte strings (hex), and a fold merges the adjacent pair of lowest rank, the leftmost of
equals, until no pair has a rank. Ranks are a literal map, held as hash buckets, because a Spark map is
searched from end to end. Documents are then put together in tasks: words of the encoded table by look-up,
all others by the same merges over arrays that hold the words of many texts at once.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

#: Most distinct words that are encoded first and broadcast, and the steps of the histogram that chooses them.
TABLE_WORDS = 1 << 17
STEPS = 16
#: White space as the vocabulary's pattern means it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces that no match of the pattern crosses: a run of other characters with the blank before it, and white space
#: as the pattern takes it. Distinct pieces are few, so the pattern itself runs on each of them once.
PIECES = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Pieces that a task counts or remembers before it starts anew; longer ones than LONGEST are not remembered.
MEMO = 300_000
LONGEST = 64
#: Characters of text that a task encodes at once.
CHUNK = 1 << 20
BUCKETS = 8192
#: Bytes from which a word is merged by a heap, in n log n steps.
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: maps from hex pieces to ranks in an array, by the crc32 of the hex text."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex()
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets)), T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))


def encode_word(word: Column, ranks: Column) -> Column:
    """Ids of the pieces of one pre-token: array<int>, empty for an empty or null word."""
    return _let(ranks, lambda bound: _fold(word, bound))  # the plan holds the literal once


def _fold(word: Column, ranks: Column) -> Column:
    def rank(name: Column) -> Column:
        return F.try_element_at(F.get(ranks, (F.crc32(name.cast("binary")) % BUCKETS).cast("int")), name)

    def merge(pieces: Column, found: Column, best: Column) -> Column:
        def at(i: Column) -> Column:
            return F.concat(
                F.slice(pieces, F.lit(1), i - 1),
                F.array(F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1))),
                F.slice(pieces, i + 2, F.size(pieces)),
            )

        return F.when(best.isNull(), pieces).otherwise(_let(F.array_position(found, best).cast("int"), at))

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: rank(F.concat(a, b)))
        return F.when(F.size(pieces) < 2, pieces).otherwise(
            _let(pairs, lambda found: _let(F.array_min(found), lambda best: merge(pieces, found, best)))
        )

    name = F.lower(F.hex(F.coalesce(word, F.lit("")).cast("binary")))
    n = F.length(name) / 2
    single = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substring(name, i * 2 - 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int") - 1, F.lit(1))), single, step)
    whole = _let(rank(name), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(F.transform(folded, rank)))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(whole)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges of one long word, whose pairs wait in a heap."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)

    def pair(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (r := ranks.get(joined := parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (r, i, len(joined)))

    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
        if after[i] >= 0:
            before[after[i]] = i
        pair(i)
        pair(before[i])
    return [ranks[p] for p in parts if p]


class Pairs:
    """The rank of each pair of ids whose pieces make a piece together, in a hash table of arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        halves = ((ranks.get(p[:i]), ranks.get(p[i:]), r) for p, r in ranks.items() for i in range(1, len(p)))
        rows = np.array([x for x in halves if x[0] is not None and x[1] is not None] or np.zeros((0, 3)), np.int64)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.shift = 61 - len(rows).bit_length()  # four to eight places for each pair
        self.codes, self.ranks, self.probes = np.full(1 << (64 - self.shift), -1, np.int64), np.zeros(1 << (64 - self.shift), np.int64), 0
        codes, values = (rows[:, 0] << 32) | rows[:, 1], rows[:, 2]
        while len(codes):  # each round fills free places; the rest goes on to the next place
            at = self._place(codes, self.probes)
            free = np.flatnonzero(self.codes[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.codes[at[put]], self.ranks[at[put]] = codes[put], values[put]
            codes, values = np.delete(codes, put), np.delete(values, put)
            self.probes += 1

    def _place(self, codes: np.ndarray, probe: int) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(self.shift)).astype(np.int64) + probe) & (len(self.codes) - 1)

    def find(self, codes: np.ndarray, none: int) -> np.ndarray:
        """Ranks of pairs, `none` for those that have none."""
        out = np.full(len(codes), none, np.int64)
        rest = np.arange(len(codes))
        for probe in range(self.probes):
            at = self._place(codes[rest], probe)
            there = self.codes[at]
            hit = there == codes[rest]
            out[rest[hit]] = self.ranks[at[hit]]
            rest = rest[~hit & (there >= 0)]
            if not len(rest):
                break
        return out


def merge_words(words: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of each word (none is empty), as bytes: in each round a word merges its pair of lowest rank, the leftmost of equals."""
    sizes = np.array([len(w) for w in words], np.int64)
    ids = pairs.bytes[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    none = np.int64(1 << 30)
    out = [b""] * len(words)
    while len(ids):
        last = np.append(owner[1:] != owner[:-1], True)
        rank = np.full(len(ids), none, np.int64)
        inner = np.flatnonzero(~last)
        rank[inner] = pairs.find((ids[inner] << 32) | ids[inner + 1], none)
        starts = np.flatnonzero(np.append(True, last[:-1]))
        stops = np.append(starts[1:], len(ids))
        best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), starts)
        done = best >> 32 >= none
        raw = ids.astype(np.int32).tobytes()
        for i, a, b in zip(owner[starts[done]].tolist(), (starts[done] * 4).tolist(), (stops[done] * 4).tolist(), strict=True):
            out[i] = raw[a:b]
        at = best[~done] & 0xFFFFFFFF
        ids[at] = rank[at]
        keep = np.repeat(~done, stops - starts)
        keep[at + 1] = False
        ids, owner = ids[keep], owner[keep]
    return out


_MEETS = re.compile(f" (?:[{_WHITE}]|$)").search


def _split(text: str) -> list[str]:
    """The pieces of a text; most texts have no blank beside other white space and are cut before each blank."""
    if "\0" in text or _MEETS(text):
        return PIECES.findall(text)
    return text.replace(" ", "\0 ").split("\0")


class Encoder:
    """Ids of whole texts, as the bytes of 32-bit numbers; remembers short pieces, up to a bound."""

    def __init__(self, pattern: str, known: dict[str, bytes], ranks: dict[bytes, int]):
        self.find, self.known, self.ranks, self.pairs = regex.compile(pattern).findall, known, ranks, Pairs(ranks)
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        words = {p: self.find(p) for p in pieces}
        ids: dict[str, bytes] = {}
        short: list[tuple[str, bytes]] = []
        for w in {w for found in words.values() for w in found if w not in self.known}:
            raw = w.encode()
            if raw not in self.ranks and len(raw) < LONG:
                short.append((w, raw))
            else:
                ids[w] = array("i", merge_long(raw, self.ranks)).tobytes()
        ids.update(zip((w for w, _ in short), merge_words([raw for _, raw in short], self.pairs), strict=True))
        for p, found in words.items():
            self.memo[p] = b"".join([self.known.get(w) or ids[w] for w in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [_split(t) for t in texts]
        new = set(chain.from_iterable(cuts)).difference(self.memo)
        self.learn(new)
        out = [b"".join(map(self.memo.__getitem__, x)) for x in cuts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        else:
            for p in new:
                if len(p) > LONGEST:
                    del self.memo[p]
        return out


def _count(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pieces = regex.compile(pattern).findall, Counter()

        def drain():
            counts: Counter[str] = Counter()
            for piece, n in pieces.items():
                for word in find(piece):
                    counts[word] += n
            pieces.clear()
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                pieces.update(_split(text or ""))
                if len(pieces) > MEMO:
                    yield from drain()
        yield from drain()

    return run


def frequent_words(docs: DataFrame, pattern: str, text_col: str = "text", n: int = TABLE_WORDS) -> DataFrame:
    """The most frequent pre-tokens of all texts, with their counts: all from a count on, and no more than n.

    A histogram of counts, of some hundred rows, gives that count, so no task ranks the words.
    """
    counts = docs.select(text_col).mapInArrow(_count(pattern), "word string, n bigint")
    counts = cut(counts.groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * STEPS).cast("int")
    least, left = None, n
    for step in counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        left -= step["count"]
        if left < 0:
            break
        least = step["level"]
    return counts.where(level >= least if least is not None else F.lit(False))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters; a range ends with the text that fills it."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", n: int = TABLE_WORDS) -> DataFrame:
    """docs with ids array<int>: each match of the pattern encoded for itself, without special tokens.

    The pattern must not match across PIECES, as that of the byte-level vocabularies does not. Null and empty
    texts have no ids; whole texts are encoded, however long. Rows keep their columns (one of the
    name ids is replaced) and are encoded each for itself, so ties and repeated rows change nothing.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # A fold takes n * n steps: long words, however frequent, are left to the heap.
    words = frequent_words(docs, pattern, text_col, n).where(F.octet_length("word") < LONG)
    rows = words.select("word", encode_word(F.col("word"), rank_map(ranks)).alias("ids")).toArrow()
    known: dict[str, bytes] = {}
    for batch in rows.to_batches():
        ids = batch.column(1)
        starts, values = ids.offsets.tolist(), ids.values.to_numpy().astype(np.int32)
        known.update(zip(batch.column(0).to_pylist(), (values[a:b].tobytes() for a, b in pairwise(starts)), strict=True))
    shared = spark.sparkContext.broadcast((known, ranks))
    del rows, known
    kept = [c for c in docs.columns if c != "ids"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pattern, *shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text_col)).to_pylist()]
            for a, b in _chunks(texts):
                packed = encoder.encode(texts[a:b])
                offsets = list(accumulate((len(x) // 4 for x in packed), initial=0))
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], [*kept, "ids"])

    return docs.mapInArrow(run, docs.limit(0).withColumn("ids", F.array().cast("array<int>")).schema)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of the pieces of ids, one after the other; no ids give no bytes, a foreign id is an error."""
    names = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        names[rank] = piece.hex()
    pieces = F.from_json(F.lit(json.dumps(names)), T.ArrayType(T.StringType()))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))


def vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the contract's vocabulary."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256."""
    found = encode(docs, ranks, pattern)
    return found.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
            "decoded_sha256": F.sha2(decode(F.col("ids"), ranks), 256),
        }
    ).drop("ids")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, *vocabulary()).drop("text")


SQL: dict[str, str] = {}
