"""The pipeline's stages against brute force on the smallest tables."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from loftline.llm import bpe

from .test_exact_dedup import lower
from .test_ngram_join import brute as near
from .test_mixing import brute as mixed

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
    kept = stages["toxicity"](spark, docs, FOLDER)
    assert kept.columns == COLUMNS and 0 < kept.count() < docs.count()

    rows = {r.doc_id: r for r in docs.collect()}
    got = stages["exact_dedup"](spark, docs, FOLDER)
    first = {}
    for d, r in sorted(rows.items()):
        first.setdefault(lower(r.text), d)
    assert got.columns == COLUMNS and {r.doc_id for r in got.collect()} == set(first.values())

    got = stages["ngram_jaccard_join"](spark, docs, FOLDER)
    want = {d for d, (_, c) in near([(d, r.text) for d, r in rows.items()], 5, 80, 100).items() if d == c}
    assert got.columns == COLUMNS and {r.doc_id for r in got.collect()} == want

    got = stages["mixing"](spark, docs, FOLDER)
    plan = mixed([(d, r.text, r.source, 0) for d, r in rows.items()])
    want = {d: n for d, (s, _, _, t) in plan.items() if s and (n := int(t / s + 0.5))}
    assert got.columns == COLUMNS and {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == want

    ranks, pattern = bpe.vocabulary()
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = stages["byte_bpe"](spark, docs, FOLDER).collect()
    assert len(got) == len(rows) and all(r.ids == encoder.encode_ordinary(r.text or "") for r in got)


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == [*COLUMNS, "ids"] and got.count() > 0


def test_odd_rows_pass_all_stages(spark):
    """Nulls, empty and very long texts, repeated rows and a column named ids; then no rows at all."""
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0),
            (None, "no id here at all today", "en", "t", 5), (4, "long text " * 20_000, "en", None, 9)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == (COLUMNS if name != "byte_bpe" else [*COLUMNS, "ids"])
        got = docs.collect()
        assert bool(got) == bool(some) and all(r.text for r in got)
    named = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, ids string")
    assert dict(corpus_pipeline.STAGES)["byte_bpe"](spark, named, FOLDER).columns == ["doc_id", "text", "ids"]
