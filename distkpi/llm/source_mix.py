"""Mixing sources to target weights.

Targets: every source gets its weight's share of the total, but at most
``max_epochs`` times its own size; what a capped source cannot take is shared
by weight among the others. The result is ``min(cap, level * weight)`` for one
common level, found from distributed prefix sums over the sources sorted by
``size / weight`` instead of by repeated rounds.

Taking: documents get hash-random keys (MD5 of seed and id), are put in key
order within their source, and a prefix sum of their sizes says which words of
the source's endless repetition they hold. A source's budget is cut exactly:
every document is taken ``budget // source_size`` times whole, and the
document at the cut gives the words that are left. The order of a source is
split into ranges of the key (``buckets``), so a source with a third of all
rows is never sorted in one task.

Only DataFrame functions run. Null texts have size 0 and are taken 0 words;
null sources form one source, the last; a null id hashes as the empty text.
Repeated rows share a key and are taken one after the other. No total: all
targets are 0. Extra columns of the input are ignored by :func:`mix` and kept
by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distkpi.llm.common import materialize, prefix_sums, words

SEED = "mix-1"
BUCKETS = 4096
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def _key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
                 .cast("binary"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, key and the key's bucket."""
    df = docs.select("doc_id", "source", F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"),
                     _key(F.col("doc_id")).alias("key"))
    digits = len(f"{BUCKETS - 1:x}")
    return df.withColumn("bucket", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))


def _in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with the number of its range in the given order as ``range``; written, so it is fixed."""
    return materialize(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-sources")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Sources are numbered, and summed in the order of ``size / weight``, by
    distributed prefix sums over ranges, so there may be any number of them.
    """
    name = F.col("source").asc_nulls_last()
    per = _in_ranges(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                     .withColumn("one", F.lit(1)), name)
    per = prefix_sums(per, [], "range", [name], {"position": "one"}).drop("range")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"))
    need = [(F.col("source_size") / F.col("weight")).asc(), F.col("weight").asc(), name]
    per = _in_ranges(per, *need)
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).scalar()
    weight_sum = per.agg(F.coalesce(F.sum("weight"), F.lit(0))).scalar()
    per = prefix_sums(per, [], "range", need, {"below": "source_size", "w_below": "weight"}).drop("range")
    # With all sources of smaller need capped, the level is (total - caps) / weights left;
    # this source is capped too if its own cap is not above its share of it.
    per = materialize(per.withColumn("left", total - max_epochs * F.col("below"))
                      .withColumn("w_left", weight_sum - F.col("w_below")), "mix-levels")
    capped = (max_epochs * F.col("source_size") * F.col("w_left")) <= (F.col("left") * F.col("weight"))
    level = per.filter(~capped).agg(F.min(F.struct("below", "left", "w_left"))).scalar()
    per = per.withColumn("level", level)
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.w_left")
    return per.select("source", "source_size", F.when(capped | F.col("level").isNull(),
                      (max_epochs * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    base = materialize(sized(docs, text), "mix-sizes")
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    placed = prefix_sums(base, ["source"], "bucket", order, {"before": "size"})
    t = targets(base).select(F.col("source").alias("_source"), "source_size", "target")
    df = placed.join(t, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return df.select("doc_id", "source", "size", "source_size", "target",
                     (epochs * F.col("size") + cut).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as mixed: a document comes out once for every epoch that takes words of it.

    The document at a source's cut comes out whole, so a source exceeds its
    target by less than one document and no text is cut in two.
    """
    m = mix(docs, text).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.expr("CASE WHEN taken > 0 THEN (taken + size - 1) div size ELSE 0 END").alias("_n"))
    # Repeated rows share id, source and size; the copies of all of them are dealt evenly to them.
    m = m.groupBy("_id", "_source", "_size").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    m = materialize(m.filter("_n > 0"), "mix-copies")
    size = F.size(words(F.col(f"`{text}`"))).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), size.alias("_s"))

    def joined(some: DataFrame) -> DataFrame:
        return rows.join(some, F.col("_row.doc_id").eqNullSafe(F.col("_id"))
                         & F.col("_row.source").eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_size")))

    out = joined(m.filter("_n % _rows = 0")).select("_row", F.expr("_n div _rows").alias("_copies"))
    # Only where a source is cut may some of them get one copy more: a group per source at most.
    uneven = m.filter("_n % _rows <> 0")
    if not uneven.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.col(f"_row.`{text}`")))
        some = joined(materialize(uneven, "mix-uneven")).withColumn("_nth", nth)
        out = out.unionByName(some.select("_row", F.expr(
            "_n div _rows + CASE WHEN _nth <= _n % _rows THEN 1 ELSE 0 END").alias("_copies")).filter("_copies > 0"))
    copies = F.sequence(F.lit(1), F.col("_copies").cast("int"))
    return out.select("_row", F.explode(copies).alias("_copy")).select("_row.*")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of :func:`mix`: plain windows, and the resharing done in rounds."""
    ws = ", ".join(map(str, WEIGHTS))
    digits = "" if MAX_EPOCHS is None else MAX_EPOCHS
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
         lambda x: x <> ''))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {table}),
p AS (SELECT source, sum(size)::BIGINT AS ss,
             [{ws}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w
      FROM d GROUP BY source),
r AS (
  SELECT source, ss, w, false AS capped, 0 AS i FROM p
  UNION ALL
  SELECT source, ss, w, capped OR {digits} * ss * wl <= rest * w, i + 1
  FROM (SELECT *, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS wl,
               sum(ss) OVER () - sum(CASE WHEN capped THEN {digits} * ss ELSE 0 END) OVER () AS rest FROM r)
  WHERE i < (SELECT count(*) FROM p)),
z AS (SELECT source, ss, w, capped, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS wl,
             sum(ss) OVER () - sum(CASE WHEN capped THEN {digits} * ss ELSE 0 END) OVER () AS rest
      FROM r WHERE i = (SELECT count(*) FROM p)),
t AS (SELECT source, ss, CASE WHEN capped THEN ({digits} * ss)::DOUBLE ELSE (rest * w)::DOUBLE / wl::DOUBLE END AS target FROM z),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d)
SELECT doc_id, o.source, size, ss AS source_size, target,
       (CASE WHEN ss = 0 THEN 0 ELSE floor(target)::BIGINT // ss * size
        + greatest(0, least(size, floor(target)::BIGINT % ss - before)) END)::BIGINT AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source"""
