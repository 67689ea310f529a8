import itertools
import zlib

from pyspark.sql import functions as F

from loftline.llm.sharding import curve_shards, hilbert, op7_hilbert_sharding, ranges, with_place


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3)):
        points = list(itertools.product(range(1 << bits), repeat=dims))
        names = [f"c{i}" for i in range(dims)]
        rows = spark.createDataFrame(points, names).withColumn("h", hilbert([F.col(n) for n in names], bits)).collect()
        order = sorted(rows, key=lambda r: r.h)
        assert [r.h for r in order] == list(range(len(points)))
        assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(order, order[1:], strict=False))


def test_runs_are_even_and_gapless(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(1003)], "doc_id long, shard_key long").repartition(5)
    got = curve_shards(rows, [F.col("shard_key"), F.col("doc_id") % 8], [F.xxhash64("doc_id"), F.col("doc_id")]).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in {r.shard for r in got}}
    assert len(got) == 1003 and set(by) == set(range(40)) and {len(v) for v in by.values()} == {25, 26}
    assert all(v == list(range(len(v))) for v in by.values())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert all(a.curve <= b.curve for a, b in zip(order, order[1:], strict=False))


def test_few_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (None, None)], "doc_id long, k long")
    got = curve_shards(rows, [F.col("k"), F.col("k")], [F.xxhash64("doc_id")]).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert curve_shards(rows.limit(0), [F.col("k"), F.col("k")], [F.col("k")]).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op7_hilbert_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) for r in got)


def test_query_law_and_slots(spark):
    """Law rows: counts are at most one apart, and slots have no gap."""
    got = op7_hilbert_sharding(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) <= set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_ranges_prune_by_every_dimension(spark):
    rows = spark.createDataFrame([(i, f"s{i * 7919 % 64:02d}", f"l{i * 104729 % 61 % 32:02d}", i) for i in range(4096)], "doc_id long, source string, lang string, shard long")
    placed = with_place(with_place(rows, "source", "s"), "lang", "l")
    got = curve_shards(placed, [F.col("s"), F.col("l")], [F.col("doc_id")])
    assert got.columns.count("shard") == 1
    for column, value in (("source", "s20"), ("lang", "l10")):
        read = ranges(got, [column]).where(f"{column}_min <= '{value}' and {column}_max >= '{value}'").count()
        assert read <= 16


def test_places_follow_names(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "n string")
    got = {r.n: r.p for r in with_place(rows, "n", "p", bits=2).collect()}
    assert got == {None: 0, "a": 1, "b": 2, "c": 3}
    assert with_place(rows.limit(0), "n", "p").collect() == []
