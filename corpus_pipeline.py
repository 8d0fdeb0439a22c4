"""A training-data pipeline over ``documents``: five stages, each calling one operator of lodestar.llm.

Every stage takes the whole output of the one before. All but the last return the columns of
``documents``; the last returns the packed pieces.

Every stage defines its result for nulls, empty tables, repeated rows and columns of any names: a
null text fails the quality rules, as one without words does; a null id never wins over an id among
equal texts and has no near copies; an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup, ngram_join, packing, quality_rules, suffix_dedup
from lodestar.llm.common import materialize, remove, small_batches, table


REPEAT_WORDS, REPEAT_BYTES = 51, 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that policy v1 of the quality rules keeps."""
    return quality_rules.keep_good(docs, "v1")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of documents linked by similarity, the one with the least doc_id."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of ``REPEAT_WORDS`` words and more that occur anywhere else out of the texts; all documents stay, n_chars follows.

    Repeats are found as byte strings of ``REPEAT_BYTES``, which 51 words of prose exceed (4 bytes a word
    with its space, 51 * 4 = 204), and go where the whole repeated stretch holds that many words: shorter
    common phrases and lines stay. Null and empty texts stay as they are, ties do not arise.
    """
    small_batches(spark)
    return suffix_dedup.drop_repeats(docs, length=REPEAT_BYTES, gram=64, min_words=REPEAT_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("suffix-array dedup", suffix), ("best-fit packing", pack)]

#: Shingle similarity, tokens and packing are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage has read is deleted once its own result is stored."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
            if last is not None:
                remove(spark, last)
            last = docs
    return docs
