import hashlib
import random
import re

from pyspark.sql import functions as F

from loftline.llm.mixing import SEED, mix, take, words

SCHEMA = "doc_id long, text string, source string, size long"


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, capped = set(names), sum(sizes.values()), {}
    while left:
        share = (total - sum(capped.values())) / sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] >= most * sizes[s]}
        if not over:
            return capped | {s: share * weight[s] for s in left}
        capped |= {s: float(most * sizes[s]) for s in over}
        left -= over
    return capped


def brute(rows):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + n(t)
    want, out = targets(sizes), {}
    for source, size in sizes.items():
        own = sorted((hashlib.md5((SEED + str(d)).encode()).hexdigest(), d, n(t)) for d, t, s, _ in rows if s == source)
        budget, before = int(want[source] + 0.5), 0
        for _, d, k in own:
            epochs, rest = divmod(budget, size) if size else (0, 0)
            out[d] = (k, size, want[source], epochs * k + max(0, min(k, rest - before)))
            before += k
    return out


def corpus(n=400):
    rng = random.Random(5)
    pick = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "Z", "ä", None, "tiny"])
    rows = [(i, " ".join("w" * rng.randint(0, 4) for _ in range(rng.randint(0, 30))), pick(), 0) for i in range(n)]
    return rows + [(n, None, "empty", 0), (n + 1, "", "empty", 0), (n + 2, "long " * 50_000, "hot", 0)]


def test_mix_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mix(df, words(F.col("text"))).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-6 and g[3] == w[3] for g, w in ((got[d], want[d]) for d in got))
    assert all(t <= 3 * s for s, _, _, t in got.values())


def test_stage_repeats_and_drops_whole_rows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    want = {d: int(t / s + 0.5) for d, (s, _, _, t) in brute(corpus()).items() if s}
    got = take(df)
    assert got.columns == df.columns
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {d: n for d, n in want.items() if n}


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA), words(F.col("text"))).collect() == []
