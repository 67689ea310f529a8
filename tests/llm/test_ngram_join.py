"""Near-duplicate join against brute force."""

import random
import re

import pytest

from loftline.llm.ngram_join import drop_near_copies, jaccard_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 90, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy).title() if rng.random() < 0.2 else " ".join(copy)))
            n += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(15):
        rows.append((n, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60))))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "One"), (n + 5, "x " * 3000), (n + 6, "é ß Ö")]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, k, num, den):
    rows = corpus()
    df = spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, k, num, den, hubs=2).collect()}
    assert got == brute(rows, k, num, den)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema), 4, 85, 100).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (7, None)]
    got = jaccard_components(spark.createDataFrame(rows, schema), 4, 85, 100).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in got) == [
        (False, 0, 7), (False, 2, 1), (False, 2, 1), (True, 2, 1)]


def test_near_copies_go(spark):
    rows = corpus(3)
    want = {d for d, (n, c) in brute(rows, 5, 80, 100).items() if d == c}
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"] and {r.doc_id for r in got.collect()} == want


def test_string_ids_and_one_hot_class(spark):
    rows = [(f"d{i:04d}", "a b c d e f g" if i % 2 else f"w{i} x{i} y{i} z{i} v{i}") for i in range(600)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id string, text string").repartition(5), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: "d0001" if int(d[1:]) % 2 else d for d, _ in rows}


def test_unlinked_members_of_a_large_token_group(spark):
    """Many texts share most of a passage, but only some are linked: the result is that of brute force."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, hubs=3).collect()}
    assert got == brute(rows, 4, 85, 100)
