import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loftline.llm import lm_score as L
from loftline.llm.shingles import word_hashes


def split(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def drawn(spark, ids):
    """The place of each id in the draw, as a part of 2**40."""
    df = spark.createDataFrame([(i, str(d) if d is not None else None) for i, d in enumerate(ids)], "i int, d string")
    return [r.x for r in df.selectExpr("i", "pmod(xxhash64('role', d), 1L << 40) x").orderBy("i").collect()]


def cell_of(word):
    return int(word_hashes([word])[0][0] >> np.uint64(32)) % L.CELLS


def word_brute(spark, rows):
    """(doc_id, words, target loss, background loss) of rows (doc_id, text, good), each by models of the other rows."""
    texts = [split(t) for _, t, _ in rows]
    total = {g: sum(len(w) for w, r in zip(texts, rows, strict=True) if bool(r[2]) == g) for g in (True, False)}
    least = min(total.values())
    taken = [d < (least << 40) // max(total[bool(r[2])], 1) for d, r in zip(drawn(spark, [r[0] for r in rows]), rows, strict=True)]
    own = [Counter(zip([None, *w], w, strict=False)) for w in texts]
    vocabulary = {w for t in texts for w in t}
    cell = {w: cell_of(w) for w in vocabulary}
    sizes, size = Counter(cell.values()), len(vocabulary) + 1
    inside = {m: [y and bool(r[2]) == m for y, r in zip(taken, rows, strict=True)] for m in (True, False)}
    whole = {m: sum((o for o, y in zip(own, inside[m], strict=True) if y), Counter()) for m in (True, False)}
    out = []
    for n, ((d, _, _), mine, words) in enumerate(zip(rows, own, texts, strict=True)):
        losses = []
        for m in (True, False):
            pairs = whole[m] - mine if inside[m][n] else whole[m]
            before, single, everything = Counter(), Counter(), sum(whole[m].values())
            for (a, b), k in pairs.items():
                before[a] += k
                single[cell[b]] += k
            p = {}
            for a, b in mine:
                share = (single[cell[b]] / sizes[cell[b]] + 1) / (everything + size)
                p[a, b] = -math.log((pairs[a, b] + L.ALPHA * share) / (before[a] + L.ALPHA))
            losses.append(sum(p[x] * k for x, k in mine.items()) / len(words) if words else None)
        out.append((d, len(words), *losses))
    return sorted(out, key=str)


def compare(got, want):
    for g, w in zip(sorted([tuple(r) for r in got], key=str), want, strict=True):
        assert g[:2] == w[:2]
        assert g[2:] == (None,) * 3 if not w[1] else np.allclose(g[2:], (w[2], w[3], w[2] - w[3]), atol=1e-6)


@pytest.mark.parametrize("words,pairs,cells", [(1, 1, 16), (20, 50, L.CELLS), (L.HOT_WORDS, L.HOT_PAIRS, 16)])
def test_scores_match_brute_force(spark, monkeypatch, words, pairs, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    monkeypatch.setattr(L, "HOT_WORDS", words)
    monkeypatch.setattr(L, "HOT_PAIRS", pairs)
    rng = random.Random(5)
    word = lambda n: rng.choice(["the", "The", "of", "é", *(f"w{i}" for i in range(n))])
    rows = [(i, " ".join(word(20 + i % 2 * 40) for _ in range(rng.randint(1, 80))), i % 2 == 0 or None) for i in range(60)]
    rows += [(100, None, None), (101, " \n", True), (102, "the of " * 30_000, None), (103, "a b", None), (103, "a b", None), (None, "w1 w2", True)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, good boolean, n_tokens int").repartition(4)
    got = L.word_scores(df, F.col("good")).collect()
    compare(got, word_brute(spark, rows))
    by = {g[0]: g[4] for g in got}
    assert sum(by[i] for i in range(0, 60, 2)) < sum(by[i] for i in range(1, 60, 2))


def test_empty_table_and_string_ids(spark):
    df = spark.createDataFrame([("x", "a b", True), ("y", None, None)], "doc_id string, text string, good boolean")
    assert sorted((r.doc_id, r.n_tokens) for r in L.word_scores(df, F.col("good")).collect()) == [("x", 2), ("y", 0)]
    assert L.word_scores(df.limit(0), F.col("good")).collect() == []


def test_a_text_that_occurs_twice_is_likelier(spark):
    rng = random.Random(7)
    once = [" ".join(f"v{rng.randrange(5000)}" for _ in range(50)) for _ in range(20)]
    rows = [(i, t, False) for i, t in enumerate([*once, once[0]])]
    rows += [(i + 100, t, True) for i, t in enumerate([" ".join(f"u{rng.randrange(5000)}" for _ in range(50)) for _ in range(30)])]
    got = {r.doc_id: r.background_loss for r in L.word_scores(spark.createDataFrame(rows, "doc_id long, text string, good boolean"), F.col("good")).collect()}
    assert max(got[0], got[20]) < min(got[i] for i in range(1, 20)) - 1


def test_models_have_about_equal_sizes(spark):
    rows = [(i, i % 4 == 0, "one two three four") for i in range(4000)]
    found = L._with_roles(spark.createDataFrame(rows, "doc_id long, good boolean, text string")).groupBy("role").count().collect()
    n = {r.role: r["count"] for r in found}
    assert n[L.TARGET] == 1000 and 900 < n[L.BACKGROUND] < 1100 and n[L.NONE] == 3000 - n[L.BACKGROUND]


def test_no_target_scores_nothing(spark):
    rows = [(i, f"a b {i}", None) for i in range(5)]
    got = L.word_scores(spark.createDataFrame(rows, "doc_id long, text string, good boolean"), F.col("good")).collect()
    assert [r.score for r in got] == [0.0] * 5


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.75), ("sf0.1", 0.85)])
def test_good_texts_score_lower(spark, sf, least):
    """A labelled good text scores below a labelled bad one with at least this probability."""
    folder = f"/root/testdata/{sf}"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.doc_id, r.score) for r in L.op8_lm_score(spark, folder).collect() if r.score is not None and quality.get(r.doc_id) is not None]
    good, bad = (np.array([s for d, s in rows if quality[d] == q]) for q in (1, 0))
    lower = np.searchsorted(np.sort(bad), good, side="right")
    assert 1 - lower.mean() / len(bad) >= least


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality == 1}
    compare(L.op8_lm_score(spark, folder).collect(), word_brute(spark, [(r.doc_id, r.text, r.doc_id in good) for r in docs]))


def test_memory_of_a_batch_stays_bounded():
    """Beside its texts, counting holds some 30 bytes for each byte of a batch; hashing a batch at once took far more."""
    texts = [b" ".join(b"w%d" % ((i * 7919 + j * j) % 300_000) for j in range(2_000)) for i in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(700) % 3, pa.int8()), pa.array(texts)], ["role", "text"])
    tracemalloc.start()
    try:
        rows = sum(b.column("n").to_numpy().sum() for b in L._count_words(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1_400_000
    assert peak < 32 * L.BATCH


def test_words_do_not_depend_on_chunks():
    texts = [b"", b"a B c", b"x" * 300_000 + b" y", b" ", b"a b", *[b"w%d w" % i for i in range(5_000)]]
    for got, want in zip(L._words(texts), word_hashes(texts), strict=True):
        assert got.tolist() == want.tolist()
    assert not len(L._words([b"", b" "])[0])
