"""Token counts as an exact length histogram.

Documents are encoded and counted by encoded length. The histogram has a row
per length that occurs, so it is as long as the longest document at most,
however many documents there are. Suffix sums over it (documents and tokens of
that length or more) answer for every context limit c at once::

    truncated(c) = tokens shorter than c + c * documents of length c or more

and the quantiles, as the length at which the share of documents not longer
passes the level. The suffix sums are distributed: lengths are cut into ranges
and the totals of longer ranges are added.

Null and empty texts have length 0. Repeated rows count as often as they
occur. An empty table has an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distkpi.llm.bpe_prefix import _encoder, encode_texts
from distkpi.llm.common import materialize, prefix_sums

RANGE = 1024


def lengths(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens, documents: counted within each batch first."""
    with open(vocabulary_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        table = _encoder(shipped.value, pattern)
        for batch in batches:
            found: dict[int, int] = {}
            for blocks in encode_texts(table, (x.as_py() or "" for x in batch.column(0))):
                n = sum(len(x) // 4 for x in blocks)
                found[n] = found.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()),
                                              pa.array(found.values(), pa.int64())],
                                             names=["n_tokens", "documents"])

    return docs.select(text).mapInArrow(run, "n_tokens bigint, documents bigint").groupBy("n_tokens").agg(
        F.sum("documents").alias("documents"))


def suffix_table(histogram: DataFrame) -> DataFrame:
    """The histogram with, per length n: documents and tokens of length n or more, the sum of
    ``min(length, n)`` and the share of documents of length n or less."""
    base = materialize(histogram.select(
        "n_tokens", "documents", (F.col("n_tokens") * F.col("documents")).alias("tokens"),
        (-F.floor(F.col("n_tokens") / RANGE)).alias("range")), "length-histogram")
    summed = prefix_sums(base, [], "range", [F.col("n_tokens").desc()], {"more": "documents", "longer": "tokens"})
    documents = base.agg(F.coalesce(F.sum("documents"), F.lit(0))).scalar()
    tokens = base.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    at_least = F.col("more") + F.col("documents")
    tokens_at_least = F.col("longer") + F.col("tokens")
    return summed.withColumns({"all_documents": documents, "all_tokens": tokens}).select(
        "n_tokens", "documents", at_least.alias("documents_at_least"), tokens_at_least.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_tokens"),
        ((F.col("all_documents") - F.col("more")) / F.col("all_documents")).alias("share_at_most"),
        "all_documents", "all_tokens")


def at_limits(suffixes: DataFrame, limits: list[int]) -> DataFrame:
    """limit, tokens left when every document is cut there, documents that are cut: any limits."""
    # The suffix row of the next longer length that occurs: all from there on are cut.
    following = suffixes.agg(F.max("all_tokens").alias("all"), *[F.min(F.when(F.col("n_tokens") > c, F.struct(
        "n_tokens", "documents_at_least", "tokens_at_least"))).alias(f"r{i}") for i, c in enumerate(limits)])
    return following.select(F.inline(F.array(*[F.struct(
        F.lit(c).cast("long").alias("limit"),
        F.coalesce(F.col("all") - F.col(f"r{i}.tokens_at_least") + c * F.col(f"r{i}.documents_at_least"),
                   "all", F.lit(0)).cast("long").alias("truncated_tokens"),
        F.coalesce(f"r{i}.documents_at_least", F.lit(0)).cast("long").alias("documents_cut"))
        for i, c in enumerate(limits)])))


def quantiles(suffixes: DataFrame, levels: list[float]) -> DataFrame:
    """level, n_tokens: the smallest length that the level's share of documents does not exceed."""
    sums = suffixes.agg(*[F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias(f"q{i}")
                          for i, q in enumerate(levels)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("level"), F.col(f"q{i}").alias("n_tokens"))
                                          for i, q in enumerate(levels)])))
