"""Runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from loftline.llm import periodic, queries

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=6, repeats=4):
    """For each period the stretches that it holds, without those that a smaller one has already given."""
    found, seen = [], set()
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, repeats * p) and (s, i + p) not in seen:
                seen.add((s, i + p))
                found.append((s, i + p - s, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i + p] for i in range(len(w) - p)))


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def texts(seed=4):
    rng = random.Random(seed)
    out = ["", "a", "a a a a a", "a a a a a a", "a b " * 4, "x " * 3000, "a b c d e f " * 3, "A a " * 9, "a a a a a a b " * 6 + "c"]
    for _ in range(150):
        w = [rng.choice("abcdefgh"[: rng.choice([2, 3, 8])]) for _ in range(rng.choice([7, 40, 300]))]
        for _ in range(rng.choice([0, 1, 2, 3])):
            at, p, n = rng.randrange(len(w)), rng.choice([1, 2, 3, 5, 13, 40]), rng.choice([4, 20, 130, 200])
            w[at : at + n] = [w[(at + i % p) % len(w)] for i in range(n)]
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out


def test_runs_match_brute_force():
    rows = texts()
    got = list(periodic.runs_of([t.encode() for t in rows]))
    for text, (words, runs) in zip(rows, got, strict=True):
        w = words_of(text)
        assert [x.decode() for x in words] == w and runs == brute(w)
        assert all(smallest_period(w[s : s + n]) == q for s, n, q in runs)
        assert [x.decode() for x in periodic.collapsed(words, runs)] == kept(w, runs)
    assert sum(len(r) for _, r in got) > 100


@pytest.mark.parametrize("least,repeats", [(3, 3), (10, 5)])
def test_other_bounds(least, repeats):
    rows = texts(7)
    for text, (_, runs) in zip(rows, periodic.runs_of([t.encode() for t in rows], least, repeats), strict=True):
        assert runs == brute(words_of(text), least, repeats)


def test_a_very_long_periodic_text_takes_no_square():
    """A text of one word would take n * n / 8 comparisons if grid points inside runs were not skipped."""
    (words, runs), (_, two) = periodic.runs_of([b"x " * 400_000, (b"a b c " * 50_000) + b"q " + b"a b " * 40_000])
    assert runs == [(0, 400_000, 1)] and two == [(0, 150_000, 3), (150_001, 80_000, 2)] and len(words) == 400_000


def test_operator(spark):
    rows = [(str(i), t, "r") for i, t in enumerate(texts(5))] + [("n", None, "r"), ("n", None, "r"), (None, "b " * 7, "r"), ("ws", " \t\n", "r")]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id string, text string, runs string").repartition(3)).collect()
    want = sorted(((d, len(words_of(t)), brute(words_of(t)), " ".join(kept(words_of(t), brute(words_of(t))))) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).collect() == []


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for d in docs:
        w = words_of(d["text"])
        h = zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        runs = brute(w)
        r = got.pop(d["doc_id"])
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept(w, runs)))
    assert not got and planted


def test_planting_takes_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (25, None), (25, ""), (25, " ")], "doc_id long, text string")
    from pyspark.sql import functions as F
    got = df.select(periodic.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert [r.t for r in got] == ["a b c", None, "", " "]
