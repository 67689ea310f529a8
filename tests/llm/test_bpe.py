import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loftline.llm import bpe

RANKS, PATTERN = bpe.vocabulary()
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(4)
    signs = " \n\t\r\x1c\x85\xa0 a'stZé1½.!_-漢́<|endoftext|>🙂"
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    return made + [None, "", " ", "  a", "it's we'll 'tis", "a" * 5000, "!?" * 3000, " " * 4000, "".join(rng.choice("abcdefgh") for _ in range(4000))]


@pytest.mark.parametrize("table", [0, 40, 5000])
def test_encoding_equals_tiktoken_and_decodes(spark, table):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = bpe.encode(df, RANKS, PATTERN, n=table).withColumn("bytes", bpe.decode(F.col("ids"), RANKS))
    for r in got.collect():
        text = rows[r.doc_id][1] or ""
        assert r.ids == REFERENCE.encode_ordinary(text) and bytes(r.bytes) == text.encode()


def test_fold_over_words_equals_tiktoken(spark):
    words = ["the", " tokens", "naïve", "\n\n", "qzxj", "🙂", " " * 7, "aaaaaaa"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.encode_word(F.col("w"), bpe.rank_map(RANKS)).alias("ids"))
    assert {r.w: r.ids for r in df.collect()} == {w: REFERENCE.encode_ordinary(w) for w in words}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, RANKS, PATTERN).collect() == []
