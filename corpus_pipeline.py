"""The corpus pipeline: language ID, near-copies, repeated passages, benchmark passages, packing.

The near-copy stage takes five-word shingles and a likeness of 0.8 or more. Language ID rejects texts without a
recognised language. Cut texts stay as documents, even where nothing is left of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubeframe.llm import decontaminate, langid, near_copies, packing, passages
from cubeframe.llm.common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.learnt(docs))


def near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def passage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("near-copies", near_copy), ("passages", passage), ("benchmark", benchmark), ("packing", pack)]
#: Trained models, tokenizers and byte-wise passage removal are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
