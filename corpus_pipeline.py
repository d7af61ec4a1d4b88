"""A training corpus in five stages: toxic documents go, then exact copies, then near copies; secrets are replaced; what is left is packed.

Defined results, in every stage: a null or empty text is a clean document without words, of which the exact stage keeps one, as
of all equal texts; repeated rows are copies like any other.  Extra columns stay as they are up to the last stage, whatever
their names.  Texts are read whole.  An empty table gives an empty result in each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from petrelspark.llm import exact_dedup, minhash, packing, queries, secrets, toxicity
from petrelspark.staging import remove, session_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays under 0.5."""
    return toxicity.drop_toxic(docs, queries.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more), the document with the smallest id."""
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, each with its sequence and place."""
    return packing.pack_tokens(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("exact dedup", without_copies), ("near dedup", without_near_copies), ("secrets", without_secrets), ("packing", packed)]

#: SQL cannot fit a classifier nor encode tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as Parquet to the session's part of the shared folder and read
    again, and goes when the next one has been written."""
    top = f"{session_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            remove(spark, f"{top}/{k - 1}")
    return docs
