"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from distkpi.llm import (bpe_prefix, cholesky_whitening, collision_search, dominance_packing, jaccard_join,
                         language_mixture, length_histogram, merkle_manifest, quality_ranking, quality_rules,
                         secret_ledger, source_mix, warc_bundles)
from distkpi.llm.common import read
from distkpi.session import scratch_path


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACKING_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")     # the ranks of byte_bpe_50k.json


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(read(spark, sf_dir, "documents"))


def op2_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan: the ledger is new, so every blob is unseen."""
    path = scratch_path(spark, f"ledger-{uuid.uuid4().hex}")
    return secret_ledger.secret_spans(read(spark, sf_dir, "documents"), path)


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive(read(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.suffix_table(length_histogram.lengths(
        read(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents"))


def op10_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.encode(read(spark, sf_dir, "documents"),
                             VOCABULARY, public_tokenizers.PATTERN)


def op11_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = dominance_packing.pack(read(spark, sf_dir, "documents"), PACKING_VOCABULARY, public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cholesky_whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.prove(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language_mixture, op2_collision_search, op3_quality_rules, op4_secret_ledger, op5_warc_bundles,
    op6_jaccard_join, op7_quality_ranking, op8_length_histogram, op9_source_mix, op10_bpe_prefix,
    op11_dominance_packing, op12_cholesky_whitening, op13_merkle_manifest)}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.oracle(),
    "op4_secret_ledger": secret_ledger.oracle(),
    "op5_warc_bundles": warc_bundles.oracle(),
    "op6_jaccard_join": jaccard_join.oracle(),
    "op9_source_mix": source_mix.oracle(),
    "op13_merkle_manifest": merkle_manifest.oracle(),
}
