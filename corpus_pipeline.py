"""A corpus pipeline of five stages; each takes documents and returns documents, the last token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshspark.llm import bpe, jaccard, mixing, pii, toxicity
from meshspark.llm._shared import materialize

#: The setting that holds the key of the pseudonyms, and what stands in for it in trials: who knows the key can undo them.
KEY_SETTING, DEMO_KEY = "spark.meshspark.pseudonymKey", "not a secret"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the string-kernel machine does not reject: scores under 0.3, null and empty texts mostly among them.

    Rows stay as they are, repeated ones and null ids too; without labels of both kinds all stay.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more; the smallest id stays.

    Null and wordless texts and rows with null ids stay. Rows with equal ids stay or go together.
    """
    return jaccard.one_of_each(docs, n=5, percent=80)


def pseudonyms_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data, under the key that the session holds."""
    return pii.pseudonymize(docs, key=spark.conf.get(KEY_SETTING, DEMO_KEY).encode())


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken; a null source is a source, texts without words are never taken."""
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of each row, null and empty texts without ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", duplicates_stage),
    ("pseudonyms", pseudonyms_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]
#: The kernel machine, the pseudonyms and the ids are not SQL; tests/llm holds the operators behind the stages against plain versions, the stages themselves only to their columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
