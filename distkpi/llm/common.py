"""Shared helpers: the words of a text, intermediate tables, prefix sums."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from distkpi.session import scratch_path

# A word is a maximal run without ASCII white space. ``bytes.split()`` in
# Python splits at the same six characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"


# Spark removes the shuffle files of a query that has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough for local sessions and installations in one place; on other
    clusters the package is shipped with ``--py-files`` as any other.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [*known, ROOT] if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of executors without
    recomputing what led here, and a table used twice is computed once. The
    shuffle files of the write go with it, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text as an array (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: that of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column],
                values: dict[str, str]) -> DataFrame:
    """Running sums of ``values`` (name of the sum -> value column) within ``group``.

    ``bucket`` splits each group into ranges that follow the sort order, so no
    task sorts a whole group: sums run inside a bucket, and the totals of the
    earlier buckets are added from a table of one row per bucket. ``df`` should
    be cheap to read twice (a materialised table). The sums exclude the row
    itself. Null groups form a group of their own.
    """
    keys = [*group, bucket]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    before = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                           *[F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).alias(f"__b_{n}")
                             for n in values])
    inside = df.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"__i_{n}")
                              for n, v in values.items()])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return inside.join(before, on).select(
        *df.columns, *[(F.col(f"__i_{n}") + F.col(f"__b_{n}")).alias(n) for n in values])
