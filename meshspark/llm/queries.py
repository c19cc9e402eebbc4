"""Queries of the numbered operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_text, importance, jaccard, mixing, neardup, pii, substring, token_files, toxicity, trie, warc
from ._shared import shared_dir
from .oracle import OP11_SQL, OP12_SQL, OP13_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands in for a key in trials; a library call needs the caller's own.
DEMO_KEY = b"not a secret"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key=DEMO_KEY, counted="n_pseudonyms").select("doc_id", "text", "n_pseudonyms")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = bpe.decode(encoded, ranks)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return both.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


WORD_TERMINALS = 49_408


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), n_terminals=WORD_TERMINALS, end=1)
    return token_files.digest_token_files(spark, out, n_terminals=WORD_TERMINALS)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest_repeats(table(spark, sf_dir, "documents"), window=35)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit_machine(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    predicted = F.when(F.col("score") >= toxicity.CUTOFF, 1).otherwise(0).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), order=2, buckets=10_000, seed=7, min_words=20, percent=25)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), family=5, splice=9)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), out, min_bytes=0)
    return warc.read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY skey, source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
    + level * sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget AS capped FROM l
), t AS (
  SELECT skey, source_size, CASE WHEN capped THEN cap ELSE weight * ((budget - coalesce(sum(cap) FILTER (capped) OVER (), 0.0)) / sum(weight) FILTER (NOT capped) OVER ()) END AS target FROM c
), m AS (
  SELECT doc_id, source, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM d JOIN t ON d.skey = t.skey
)
SELECT doc_id, size, source_size, target, source,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - cum)) AS BIGINT) AS taken FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pseudonyms, op2_bpe_encode_decode, op3_embedding_near_dedup, op4_jaccard_join, op5_token_files, op6_html_text, op7_toxicity, op8_mix_sources, op9_substring_dedup, op10_nearest_neighbours, op11_importance_resampling, op12_prefix_trie, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": OP8_SQL, "op11_importance_resampling": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_warc": OP13_SQL}
