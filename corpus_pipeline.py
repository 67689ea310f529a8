"""A corpus pipeline of five stages over `documents`; each stage's rows are written and read by the next one.

Every stage takes any rows: nulls in any column, empty and very long texts, repeated rows, no rows at all. Columns beside
doc_id, text and source are passed on as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loftline.llm import bpe, common, exact_dedup, mixing, ngram_join, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; it is fitted on labelled rows that are not held out.

    Null and empty texts score 0 and stay; repeated rows go or stay together.
    """
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the smallest doc_id stays.

    Null and empty texts are equal; a null id loses against any other; of rows that repeat id and text one stays.
    """
    return exact_dedup.drop_copies(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 of five-word shingles the first stays.

    Texts without words are connected with nothing and stay; a null id stays only where its group has no other.
    """
    return ngram_join.drop_near_copies(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document that is taken several times has as many rows.

    Null is a source of its own. Texts without words take nothing and go.
    """
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the token ids of each text; a null text has none, a column ids is replaced."""
    return bpe.encode(docs, *bpe.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: The grammar, the join and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each but the last is written as Parquet in the shared folder and reread."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
