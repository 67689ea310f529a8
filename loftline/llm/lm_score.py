"""Cross-entropy difference of two matched word-pair models that share one vocabulary.

A target and a background model give each word a loss, given the word before; the mean difference scores the
document. The models are matched: of the rows in the target and of those outside, the side with more words is thinned
by a hash of the id until both have about the same number of words, and both are smoothed alike. All words of the
corpus are the vocabulary, each by 32 bits of its hash. Every text is scored by models that leave it out: what it
counts itself is taken off first.

Pairs are smoothed by single words, and these by equal shares. The counts of single words are kept for CELLS classes of
words (the low bits of their hashes), so that they can be broadcast; the words of a class share its count equally.

Each batch of texts sends the pairs of its documents, with their counts, to the buckets of the pairs' first words;
there the counts of the whole corpus meet, and the sums of losses go back to the batch. So the pairs are
shuffled once, packed in arrays. First words that are hot are counted before and broadcast, and their pairs dealt
out by themselves; so are pairs that are hot, which are scored inside the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, small, table
from .shingles import chunks, mix, word_hashes

#: Pseudo-counts that go by single words, for each first word.
ALPHA = 8.0
#: Classes of words, a power of two, by which single words are counted.
CELLS = 1 << 18
#: Bytes of text and number of texts of a batch.
BATCH, BATCH_TEXTS = 4 << 20, 1 << 15
#: Distinct words or pairs that a task merges at once.
HELD = 1 << 20
#: Words that are more than this part of all words are hot, so fewer than so many; and pairs of hot words.
HOT_WORDS, HOT_PAIRS = 1 << 12, 1 << 16
#: Pairs of a bucket that are scored at once.
SCORED = 1 << 17
#: Words of the corpus for each bucket.
BUCKET_WORDS = 1 << 20
#: Losses are summed as whole numbers of this part of a nat, so that their order does not matter.
UNITS = 1e8

#: What a text is part of.
NONE, TARGET, BACKGROUND = 0, 1, 2
MODELS = (BACKGROUND, TARGET)
ENTRY = ["code", "owner", "times", "own", "mine", "role"]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What word_hashes finds, a chunk at a time: it takes some 50 bytes for each byte of text meanwhile."""
    found = [(*word_hashes(texts[a:b]), a) for a, b in chunks(texts)]
    return np.concatenate([word for word, _, _ in found]), np.concatenate([doc + a for _, doc, a in found])


def _batches(batch: pa.RecordBatch, role: int, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple[np.ndarray, ...]]]:
    """Parts of a batch: their rows, the role of each, and of each word its first word, itself and its text."""
    texts = batch.column(text).cast(pa.binary())
    roles = np.array(batch.column(role).to_pylist(), np.int8)
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= BATCH or i + 1 - start >= BATCH_TEXTS or i + 1 == len(texts):
            word, doc = _words([t or b"" for t in texts.slice(start, i + 1 - start).to_pylist()])
            word = np.maximum((word >> np.uint64(32)).astype(np.int64), 1)
            before = np.zeros_like(word)  # 0: the start of a text
            before[1:] = np.where(doc[1:] == doc[:-1], word[:-1], 0)
            yield batch.slice(start, i + 1 - start), roles[start : i + 1], (before, word, doc)
            start, size = i + 1, 0


class _Counts:
    """Sums of columns by key, merged whenever they grow beyond HELD keys."""

    def __init__(self, names: list[str]):
        self.names, self.held = names, []

    def add(self, keys: np.ndarray, columns: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """columns may be made one by one; each is that of a batch, so its sums fit 32 bits."""
        self.held.append(self._merge(keys, columns, np.int32))
        if sum(len(h[0]) for h in self.held) > HELD:
            yield from self.drain()

    @staticmethod
    def _merge(keys: np.ndarray, columns: Iterable[np.ndarray], kind: type) -> tuple:
        values, place = np.unique(keys, return_inverse=True)
        return values, *(np.bincount(place, c, len(values)).astype(kind) for c in columns)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, *columns = zip(*self.held, strict=True)
            merged = self._merge(np.concatenate(keys), map(np.concatenate, columns), np.int64)
            self.held.clear()
            for at in range(0, len(merged[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in merged], self.names)


def _parts(role: np.ndarray) -> list[np.ndarray]:
    """Whether words or pairs of texts with these roles count in each of MODELS."""
    return [(role == m).astype(float) for m in MODELS]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts(["word", "n", "first", "b", "t", "b_first", "t_first"])
    for batch in batches:
        for _, role, (before, word, doc) in _batches(batch, 0, 1):
            one, none = np.ones(len(word), bool), np.zeros(len(word), bool)
            of = [role[doc] == m for m in MODELS]
            as_word, as_first = [one, none, *of, none, none], [none, one, none, none, *of]
            yield from counts.add(np.r_[word, before], (np.r_[a, b] for a, b in zip(as_word, as_first, strict=True)))
    yield from counts.drain()


def _code(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before << 32 | word


def _first_of(code: np.ndarray) -> np.ndarray:
    return code >> 32 & 0xFFFFFFFF


def _index(listed: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted list, and whether they are there."""
    if not len(listed):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
    return at, listed[at] == keys


def _count_hot_pairs(hot) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(["code", "n", "b", "t"])
        for batch in batches:
            for _, role, (before, word, doc) in _batches(batch, 0, 1):
                both = _index(hot.value[0], before)[1] & _index(hot.value[0], word)[1]
                yield from counts.add(_code(before, word)[both], [np.ones(both.sum()), *_parts(role[doc][both])])
        yield from counts.drain()

    return run


def _sums(losses: np.ndarray, times: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(losses * times, starts) if len(starts) else losses[:0]


def _cell(code: np.ndarray, single) -> np.ndarray:
    """The class of the second word of pairs."""
    return code & (len(single[-1][0]) - 1)


def _scored(code, times, own, mine, role, pair, first, single) -> list[np.ndarray]:
    """-log P of pairs of texts in whole UNITS by each of MODELS, without what the text counts itself.

    times, own and mine are the text's counts of the pair, of its first word and of the class of its second; pair and first
    are those of each model. single: for each model the words of each class and all words, then the vocabulary of each class.
    """
    *models, (sizes, size) = single
    cell, out = _cell(code, single), []
    for model, p, f, (words, total) in zip(MODELS, pair, first, models, strict=True):
        here = (role == model).astype(np.int64)
        share = ((words[cell] - mine * here) / np.maximum(sizes[cell], 1) + 1) / (total + size)
        out.append(np.rint(-np.log((p - times * here + ALPHA * share) / (f - own * here + ALPHA)) * UNITS).astype(np.int64))
    return out


def _send(shared, single, buckets: int) -> Callable:
    """For each batch of texts a row with its ids and what is scored here, and a row of pairs for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot_words, *first), (hot_pairs, *pair) = shared.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, role, (before, word, doc) in _batches(batch, 1, 2):
                code, docs = _code(before, word), rows.num_rows
                order = np.lexsort((code, doc))
                code, doc = code[order], doc[order]
                new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])][: len(code)])
                times, total = np.diff(np.r_[new, len(code)]), np.bincount(doc, minlength=docs)
                code, doc = code[new], doc[new]
                context = _first_of(code)
                opens = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])][: len(code)])
                own = np.repeat(_sums(times, np.ones_like(times), opens), np.diff(np.r_[opens, len(code)]))
                of = role[doc]
                _, place = np.unique(doc << 32 | _cell(code, single.value), return_inverse=True)
                mine = np.bincount(place, times)[place].astype(np.int64) if len(place) else times

                at, here = _index(hot_pairs, code)
                at, ctx = at[here], _index(hot_words, context[here])[0]
                of_here = [x[here] for x in (code, times, own, mine, of)]
                found = _scored(*of_here, [x[at] for x in pair], [x[ctx] for x in first], single.value)
                sums = [np.zeros(docs, np.int64) for _ in found]
                for s, x in zip(sums, found, strict=True):
                    np.add.at(s, doc[here], x * times[here])

                away = np.flatnonzero(~here)
                is_hot = _index(hot_words, context[away])[1]
                key = np.where(is_hot, code[away], context[away]).astype(np.uint64)
                bucket = (mix(key + np.uint64(5)) % np.uint64(buckets)).astype(np.int64)
                away, bucket = away[by := np.argsort(bucket, kind="stable")], bucket[by]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
                edges = pa.array(np.r_[starts, len(bucket), len(bucket)].astype(np.int32))
                sent = len(starts)
                lists = [pa.ListArray.from_arrays(edges, pa.array(x[away].astype(t))) for x, t in
                         ((code, np.int64), (doc, np.int32), (times, np.int32), (own, np.int32), (mine, np.int32), (of, np.int8))]
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0] * (sent + 1) + [docs], pa.int32()), x)
                home = int(mix(np.array([number], np.uint64))[0] % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[bucket[starts], home]), pa.array(np.full(sent + 1, number)), *lists,
                     whole(rows.column(0)), whole(pa.array(total.astype(np.int64))), *(whole(pa.array(s)) for s in sums)],
                    ["bucket", "batch", *ENTRY, "ids", "n", "background", "target"],
                )
                number += 1

    return run


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _meet(shared, single) -> Callable:
    """One bucket: counts of its pairs over all batches, and for each batch the sums of losses by document."""

    def run(rows: pa.Table) -> pa.Table:
        hot_words, *hot_first = shared.value[0]
        code, owner, times, own, mine, role = (_flat(rows.column(c)) for c in ENTRY)
        of_row = np.repeat(np.arange(rows.num_rows, dtype=np.int32), rows.column("code").combine_chunks().value_lengths().to_numpy())
        values, place = np.unique(code, return_inverse=True)
        place = place.astype(np.int32)
        pair = [np.bincount(place, times * (role == m), len(values)) for m in MODELS]
        context, inside = np.unique(_first_of(values), return_inverse=True)
        first = [np.bincount(inside, p, len(context)) for p in pair]
        at, is_hot = _index(hot_words, context)
        for f, known in zip(first, hot_first, strict=True):
            f[is_hot] = known[at[is_hot]]
        found = [np.zeros(len(code), np.int64) for _ in MODELS]
        for a in range(0, len(code), SCORED):
            some = slice(a, a + SCORED)
            at, entry = place[some], [x[some] for x in (code, times, own, mine, role)]
            for out, x in zip(found, _scored(*entry, [p[at] for p in pair], [f[inside[at]] for f in first], single.value), strict=True):
                out[some] = x
        starts = np.flatnonzero(np.r_[True, (of_row[1:] != of_row[:-1]) | (owner[1:] != owner[:-1])][: len(code)])
        offsets = pa.array(np.searchsorted(of_row[starts], np.arange(rows.num_rows + 1)).astype(np.int32))
        lists = [pa.array(owner[starts].astype(np.int32)), *(pa.array(_sums(x, times, starts)) for x in found)]
        parts = [pa.ListArray.from_arrays(offsets, x) for x in lists]
        kept = [rows.column(c).combine_chunks() for c in ("batch", "ids", "n", "background", "target")]
        return pa.Table.from_arrays([*kept, *parts], ["batch", "ids", "n", "background", "target", "owner", "b", "t"])

    return run


def _gather(rows: pa.Table) -> pa.Table:
    """One batch: the losses of each of its documents."""
    ids = rows.column("ids").combine_chunks().flatten()
    n, target, background = (_flat(rows.column(c)).astype(np.int64) for c in ("n", "target", "background"))
    owner = _flat(rows.column("owner")).astype(np.int64)
    np.add.at(target, owner, _flat(rows.column("t")).astype(np.int64))
    np.add.at(background, owner, _flat(rows.column("b")).astype(np.int64))
    return pa.Table.from_arrays([ids, pa.array(n), pa.array(target), pa.array(background)], ["doc_id", "n_tokens", "t", "b"])


def _with_roles(rows: DataFrame) -> DataFrame:
    """(doc_id, role, text) of (doc_id, good, text): the side with more words is thinned by a hash of the id."""
    words = {r.good: r.n or 0 for r in rows.groupBy("good").agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("bigint")).alias("n")).collect()}
    least = min(words.get(True, 0), words.get(False, 0))
    drawn = F.pmod(F.xxhash64(F.lit("role"), F.col("doc_id").cast("string")), F.lit(1 << 40))
    taken = lambda good: drawn < (least << 40) // max(words.get(good, 0), 1)
    role = F.when(F.col("good") & taken(True), TARGET).when(~F.col("good") & taken(False), BACKGROUND).otherwise(NONE)
    return rows.select("doc_id", role.cast("tinyint").alias("role"), "text")


def _singles(words: DataFrame, size: int) -> list:
    """What _scored takes as single; at most CELLS rows reach the driver."""
    by = words.where("n > 0").groupBy(F.col("word").bitwiseAND(CELLS - 1).alias("cell"))
    found = by.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("size")).toArrow()
    at, out = found.column("cell").to_numpy(), []
    for name in ("b", "t", "size"):
        values = found.column(name).to_numpy()
        total = int(values.sum())
        held = np.zeros(CELLS, np.int64 if total >= 1 << 31 else np.int32)
        held[at] = values
        out.append((held, total))
    return [*out[:2], (out[2][0], size)]


def word_scores(docs: DataFrame, is_target, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean nats of a word) and score, their difference.

    docs is what both models are made of and what is scored: the target is made of texts of is_target (null: not of it), the
    background of as many words of the others; if the others have fewer words, the target is thinned instead. Every row is scored,
    whether it is part of a model or not. A lower score is nearer to the target. Words are runs of anything but ASCII white
    space, a to z like A to Z. Null and empty texts have no words and null losses; ids may be null, of any type or repeat.
    A text that is in a model twice is left out once. Without a target or without other texts both models are empty, and all scores 0.
    An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    good = F.coalesce(is_target, F.lit(False)).alias("good")
    rows = _with_roles(docs.select(F.col(id_col).alias("doc_id"), good, F.col(text_col).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n", "first", "b", "t", "b_first", "t_first"]
    counts = rows.select("role", "text").mapInArrow(_count_words, ", ".join(f"{c} bigint" for c in ["word", *names]))
    words = cut(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]))
    total = words.agg(F.count_if(F.col("n") > 0).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    size, tokens = total["size"] + 1, total["n"]
    listed = words.where(F.greatest("n", "first") * HOT_WORDS > tokens).toPandas().sort_values("word")
    hot = [listed[c].to_numpy(np.int64) for c in ("word", "b_first", "t_first")]
    single = spark.sparkContext.broadcast(_singles(words, size))
    seen = spark.sparkContext.broadcast(hot)
    pairs = rows.select("role", "text").mapInArrow(_count_hot_pairs(seen), "code bigint, n bigint, b bigint, t bigint")
    pairs = pairs.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n", "b", "t")])
    often = pairs.where(F.col("n") * HOT_PAIRS > tokens).toPandas().sort_values("code")
    shared = spark.sparkContext.broadcast((hot, [often[c].to_numpy(np.int64) for c in ("code", "b", "t")]))

    buckets = max(tokens // BUCKET_WORDS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = f"ids array<{kind}>, n array<bigint>, background array<bigint>, target array<bigint>"
    entry = "code array<bigint>, owner array<int>, times array<int>, own array<int>, mine array<int>, role array<tinyint>"
    sent = rows.mapInArrow(_send(shared, single, buckets), f"bucket bigint, batch bigint, {entry}, {own}")
    met = sent.groupBy("bucket").applyInArrow(_meet(shared, single), f"batch bigint, {own}, owner array<int>, b array<bigint>, t array<bigint>")
    out = met.groupBy("batch").applyInArrow(_gather, f"doc_id {kind}, n_tokens bigint, t bigint, b bigint")
    mean = [F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens") / UNITS) for c in "tb"]
    out = out.select(F.col("doc_id").alias(id_col), "n_tokens", mean[0].alias("target_loss"), mean[1].alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: texts labelled of good quality. Background: as many words of other texts. One row per document, those with nulls or repeated too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    # Each pass over the texts joins them: without a shuffle of the texts as long as the good labels are few.
    return word_scores(docs.join(small(good), "doc_id", "left"), F.col("good"))


SQL: dict[str, str] = {}
