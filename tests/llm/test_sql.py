"""The subpackage's queries against their SQL in DuckDB, or a brute-force version, on the smallest tables."""

import hashlib
import zlib

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest
import tiktoken

from loftline.llm import bpe, queries, tiff, toxicity

FOLDER = "/root/testdata/sf0.001"


def documents():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    normal = lambda p: p[sorted(p.columns)].astype(object).where(p[sorted(p.columns)].notna(), None).map(str).sort_values(sorted(p.columns)).reset_index(drop=True)
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]) or pd.api.types.is_float_dtype(want[c]):
            got[c], want[c] = got[c].astype(float).round(6), want[c].astype(float).round(6)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_toxicity_query(spark):
    lexicon = toxicity.fit_lexicon(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    reader, machine = toxicity._Reader(lexicon), toxicity.grammar()
    want = {d["doc_id"]: toxicity.score_text(d["text"] or "", reader, machine)[0] for d in documents()}
    got = queries.QUERIES["op1_toxicity"](spark, FOLDER).collect()
    assert {r.doc_id: r.score for r in got} == want and len(got) == len(want)
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_digests_equal_tiktoken_and_hashlib(spark):
    ranks, pattern = bpe.vocabulary()
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(d["doc_id"], d["text"]) for d in documents()[:60]] + [(-1, None), (-2, ""), (-3, "  a \n\n b\t" * 3000), (-4, "x" * 70_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, ranks, pattern).collect()}
    for i, text in rows:
        ids = encoder.encode_ordinary(text or "")
        joined = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i] == (len(ids), joined, hashlib.sha256((text or "").encode()).hexdigest())


def test_tiff_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op4_tiff"](spark, FOLDER).collect()}
    codecs = set()
    for d in documents():
        data = (d["text"] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        crc = zlib.crc32(payload)
        codec = tiff.LZW if crc % 8 == 0 else tiff.PACKBITS if crc % 8 < 4 else tiff.DEFLATE
        media = tiff.write_tiff(payload, codec, bool(crc >> 8 & 1), bool(crc >> 9 & 1) and codec != tiff.PACKBITS)
        codecs.add(codec)
        r = got.pop(d["doc_id"])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        values = [b for b in payload[: 64 * tiff.PAGE_ROWS]]
        assert f"mean={sum(values) / len(values):.4f}" in r.feature and f"values={len(set(values))}" in r.feature
    assert not got and len(codecs) == 3
