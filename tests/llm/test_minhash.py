"""b-bit MinHash against brute force."""

import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from loftline.llm import minhash, queries
from loftline.llm.ngram_join import jaccard_components
from tests.llm.test_ngram_join import brute, corpus

FOLDER = "/root/testdata/sf0.001"


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k,num,den", [(2, 80, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, k, num, den):
    rows = corpus()
    df = spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id long, text string, node string").repartition(5)
    got = minhash.near_duplicates(df, k, num, den, hubs=2)
    assert result(got) == brute(rows, k, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_query_matches_brute_force(spark):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    assert result(queries.QUERIES["op13_bbit_minhash"](spark, FOLDER)) == brute(docs, 2, 80, 100)


def test_empty_table_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "A b c d e"), (7, None), (8, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema), 2).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id, r.kept) for r in got) == [
        (False, 0, 7, True), (False, 0, 8, True), (False, 4, 1, True), (False, 4, 1, True), (True, 4, 1, False)]


def test_a_large_group_of_near_copies_and_string_ids(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(700):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 9])):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(10**9)}"
        rows.append((f"d{i:04d}", " ".join(copy)))
    got = result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").repartition(6), 2))
    assert got == brute(rows, 2, 80, 100)


def test_estimates_are_corrected_for_chance(spark):
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8, 0.95):
        found = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
            own = rng.integers(0, 1 << 63, (2, (2000 - len(both)) // 2), dtype=np.uint64)
            sets = [np.concatenate([both, x]) for x in own]
            least = minhash.minima(np.concatenate(sets), np.array([len(x) for x in sets]))
            a, b = minhash.planes(least).reshape(2, minhash.BITS, minhash.WORDS)
            differ = np.bitwise_or.reduce(a ^ b, axis=0).view(np.uint64)
            equal = minhash.LANES - sum(int(x).bit_count() for x in differ)
            low = minhash.mix(least.astype(np.uint64)) & np.uint64(minhash._LOW)
            assert equal == int((low[0] == low[1]).sum())
            found.append((equal / minhash.LANES - 1 / 16) * 16 / 15)
        assert abs(np.mean(found) - share) < 0.03


def test_signature_columns_estimate_the_same(spark):
    rng = np.random.default_rng(6)
    x, y = (minhash.planes(rng.integers(0, 4, (1, minhash.LANES), dtype=np.uint32))[0].tolist() for _ in range(2))
    names = ", ".join(f"{c} bigint" for c in minhash.SIGNATURE)
    df = spark.createDataFrame([(tuple(x), tuple(y))], f"a struct<{names}>, b struct<{names}>")
    row = df.select(minhash.equal_lanes("a", "b").alias("e"), minhash.similarity(minhash.equal_lanes("a", "b")).alias("s")).first()
    a, b = np.array(x).reshape(4, 2), np.array(y).reshape(4, 2)
    want = 128 - sum(int(v).bit_count() for v in np.bitwise_or.reduce(a ^ b, axis=0).view(np.uint64))
    assert row.e == want and row.s == pytest.approx(max(0, (want / 128 - 1 / 16) * 16 / 15))


@pytest.mark.parametrize("group", [minhash.near_duplicates, jaccard_components])
def test_steps_leave_no_shuffle_files(spark, group):
    """Those of some 100 shuffles stayed before, until the driver happened to collect its garbage."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\d+", files.getAllFiles().mkString(" ")))
    before = held()
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    got = group(df, 4, 85, 100)
    for _ in range(50):  # files go behind the step
        if len(left := held() - before) < 10:
            break
        time.sleep(0.2)
    assert len(left) < 10
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(corpus(), 4, 85, 100)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
