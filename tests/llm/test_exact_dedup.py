import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from loftline.llm.exact_dedup import drop_copies, exact_groups

SCHEMA = "doc_id long, text string, h string, keep_id string"
ROWS = [(1, "Aa", "x", "y"), (5, "aA", "x", "y"), (3, "ÄÖ", "x", "y"), (4, "äö", "x", "y"), (7, None, "x", "y"), (8, "", None, None),
        (9, "b" * 200_000, "x", "y"), (2, "B" * 200_000, "x", "y"), (None, "aa", "x", "y"), (6, "solo", "x", "y"), (6, "solo", "x", "y")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, pick):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[lower(t)].append(d)
    out = []
    for d, t, *_ in rows:
        ids = groups[lower(t)]
        keep = pick([i for i in ids if i is not None])
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


def test_groups_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert result(exact_groups(df, keep="max")) == brute(ROWS, max)
    assert result(exact_groups(df)) == brute(ROWS, min)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    weak = lambda t: F.lit(b"same")
    assert result(exact_groups(df, keep="max", hash128=weak)) == brute(ROWS, max)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = drop_copies(df, keep="max")
    assert got.columns == df.columns
    assert sorted([(r.doc_id, lower(r.text)) for r in got.collect()], key=str) == sorted(
        [(5, "aa"), (3, "ÄÖ"), (4, "äö"), (8, ""), (9, "b" * 200_000), (6, "solo")], key=str)
    assert sorted(r.doc_id for r in drop_copies(df, keep="min").collect()) == [1, 2, 3, 4, 6, 7]


def test_hot_texts_and_odd_columns(spark):
    rows = [(i, "same" if i % 3 == 0 else None if i % 3 == 1 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(exact_groups(df, keep="max")) == brute(rows, max)
    odd = df.limit(6).selectExpr("doc_id", "'a' as text", "map('k', 1) as m", "1 as __t", "2 as __h", "3 as __row", "array(map(1, 2)) as n")
    got = drop_copies(odd, keep="max").collect()
    assert len(got) == 1 and got[0].m == {"k": 1} and (got[0]["__t"], got[0]["__h"], got[0]["__row"]) == (1, 2, 3)


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "X"), ("c", "y")], "doc_id string, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_groups(df, keep="max").collect()) == [("a", "b"), ("b", "b"), ("c", "c")]
