"""A training corpus from raw documents, stage by stage.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``:

1. ``quality_rules`` drops documents that fail the base rule or the threshold table;
2. ``jaccard_join`` keeps one document (the smallest id) of each group of near duplicates
   (5-word shingles, similarity 0.8 or more);
3. ``secret_ledger`` replaces every secret found by a mark;
4. ``source_mix`` repeats or leaves out documents until each source has its target;
5. ``bpe_prefix`` encodes every text: id, tokens and digests.

Nulls, empty texts, repeated rows and empty tables are handled as each
operator's docstring says. Rows repeated by the mix stay repeated in stage 5.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from distkpi.llm import bpe_prefix, jaccard_join, quality_rules, secret_ledger, source_mix
from distkpi.llm.common import importable, materialize, read
from distkpi.session import scratch_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard_join.keep_one(docs, near=jaccard_join.GENERAL)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs, scratch_path(spark, f"ledger-{uuid.uuid4().hex}"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return bpe_prefix.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN,
                             with_ids=True)


STAGES = [
    ("quality_rules", good),
    ("jaccard_join", distinct),
    ("secret_ledger", without_secrets),
    ("source_mix", mixed),
    ("bpe_prefix", encoded),
]

# The last stage's merges have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
