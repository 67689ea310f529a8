"""Periodic runs of words: harmonic grid probing over whole texts.

A run of period p and at least 4 p words holds four grid points j p, (j + 1) p, ... one after the other, at which the words
are equal. So for each p only the grid is compared, n / p words, in all about n log n. Points that lie in a run that
was found for a divisor of p are skipped; what is left is extended to both sides by comparing arrays in growing chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import chunks

#: Least number of words of a run, and of its repetitions.
LEAST, REPEATS = 6, 4
#: Words that are compared first when a point is extended; each further chunk has twice as many.
CHUNK_WORDS = 64

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _first_difference(x: np.ndarray, i: int, p: int) -> int:
    """The first place from i on whose word differs from the one p further on; len(x) - p where none does."""
    size, last = CHUNK_WORDS, len(x) - p
    while i < last:
        stop = min(i + size, last)
        off = x[i:stop] != x[i + p : stop + p]
        at = int(off.argmax())
        if off[at]:
            return i + at
        i, size = stop, 2 * size
    return last


def _last_difference(x: np.ndarray, i: int, p: int) -> int:
    """The last place up to i whose word differs from the one p further on; -1 where none does."""
    size = CHUNK_WORDS
    while i >= 0:
        start = max(i + 1 - size, 0)
        off = (x[start : i + 1] != x[start + p : i + 1 + p])[::-1]
        at = int(off.argmax())
        if off[at]:
            return i - at
        i, size = start - 1, 2 * size
    return -1


def _survivors(x: np.ndarray, p: int, chain: int) -> np.ndarray:
    """Grid points from which `chain` equalities at distance p follow one another, and which do not fail between them."""
    grid = x[::p]
    equal = grid[1:] == grid[:-1]
    if len(equal) < chain:
        return np.zeros(0, np.int64)
    ok = equal[: len(equal) - chain + 1].copy()
    for k in range(1, chain):
        ok &= equal[k : len(equal) - chain + 1 + k]
    found = np.flatnonzero(ok) * p
    # A run over these grid points holds all words between them as well.
    for offset in {p // 2, p // 4, p - 1} - {0}:
        for turn in range(chain - 1):
            if len(found):
                i = found + (offset + turn * p)
                found = found[x[i] == x[i + p]]
    return found


def _uncovered(points: np.ndarray, p: int, runs: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """Points whose pair does not lie in a run of a period that divides p and that is long enough to settle p as well."""
    for q, held in runs.items():
        if len(points) and p % q == 0:
            spans = np.array(held, np.int64)
            spans = spans[spans[:, 1] - spans[:, 0] >= p + q]
            if len(spans):
                at = np.searchsorted(spans[:, 0], points, side="right") - 1
                points = points[(at < 0) | (points + p >= spans[at, 1])]
    return points


def find_runs(x: np.ndarray, longest: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs of x, whose parts (texts, each with a number of its own behind) come longest first.

    longest: the number of words of each part. A part is looked at for periods that fit into it `repeats` times. A stretch
    with period p that has a smaller one has one that divides p, and was found under it with the same borders.
    """
    ends = np.cumsum(longest + 1)
    runs: dict[int, list[tuple[int, int]]] = {}
    seen: set[tuple[int, int]] = set()
    p = 1
    while True:
        parts = int(np.searchsorted(-longest, -repeats * p, side="right"))
        if not parts:
            break
        y = x[: ends[parts - 1]]
        shortest = max(least, repeats * p)
        new, beyond = [], -1
        for a in _uncovered(_survivors(y, p, max(shortest // p - 1, 1)), p, runs).tolist():
            if a < beyond:
                continue
            beyond = _first_difference(y, a, p)
            span = (_last_difference(y, a, p) + 1, beyond + p)
            if span[1] - span[0] >= shortest and span not in seen:
                seen.add(span)
                new.append(span)
        if new:
            runs[p] = new
        p += 1
    return [(s, e, q) for q, spans in runs.items() for s, e in spans]


def runs_of(texts: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words and its runs (start, length, period) by start, then period."""
    words = [t.split() for t in texts]
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    number: dict[bytes, int] = {}
    parts = []
    for k, i in enumerate(order):
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words[i]), np.int64, len(words[i])))
        parts.append(np.array([-1 - k], np.int64))
    sizes = np.array([len(words[i]) for i in order], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(texts):
        for s, e, q in find_runs(np.concatenate(parts), sizes, least, repeats):
            k = int(np.searchsorted(starts, s, side="right")) - 1
            found[order[k]].append((s - int(starts[k]), e - s, q))
    for own, runs in zip(words, found, strict=True):
        runs.sort(key=lambda r: (r[0], r[2]))
        yield own, runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """One row per row of docs: id, n_words, runs (start, length, period; words are numbered from 0) and the collapsed text.

    A run is a stretch of words with smallest period q (words q apart are identical) and at least max(least, repeats * q)
    words that no neighbouring word extends; repeats is 3 at least. The collapsed text joins by one space the words that no run holds
    after its first q. Words are runs of anything but ASCII white space and are compared byte by byte, case included.
    Null and empty texts have no words, no runs and an empty collapsed text. Texts of any length are taken whole, rows that are repeated
    give repeated rows, other columns are not looked at, no rows give no rows.
    """
    if repeats < 3:
        raise ValueError("a run must repeat three times at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                sizes, runs, kept = [], [], []
                for words, own in runs_of(texts[a:b], least, repeats):
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    kept.append(b" ".join(collapsed(words, own)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS_ARROW), pa.array(kept, pa.binary()).cast(pa.string())],
                    [id_col, "n_words", "runs", "collapsed"],
                )

    rows = docs.select(id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(key: Column, text: Column) -> Column:
    """text; of a tenth of the ids (by crc32) the words from a place on repeat the first few from there."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % F.nullif(n, F.lit(0))
    p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
    one = F.struct(words.alias("w"), a.alias("a"), p.alias("p"), n.alias("n"))
    # A list of one element names the parts, so that they are computed once.
    made = F.transform(
        F.array(one),
        lambda s: F.concat_ws(
            " ", F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")))
        ),
    )
    return F.when((h % 10 == 0) & (n > 0), made[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, after a tenth of them was made periodic by a fixed rule; a null id is left as it is."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), order.alias("top"), lines.alias("lines"), "collapsed")
    listed = F.array_join(F.transform("lines", lambda s: F.concat(s, F.lit("\n"))), "")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


#: Runs are beyond SQL on whole tables; tests hold the query against brute force.
SQL: dict[str, str] = {}
