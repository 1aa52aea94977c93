"""Reference lists, counts and paging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from distkpi.constants import OTHERS
from distkpi.session import scratch_path
from distkpi.sources.tables import Tables

DEFAULT_PAGE_SIZE = 1000


def item_filter_list(t: Tables) -> DataFrame:
    """Distinct target items with their description and class (``Others`` when
    the item master has none)."""
    items = t.items.select("matnr", "matnr_desc", "classif")
    j = t.target_items.join(items, F.col("matnr") == F.col("material_code"), "left")
    return j.select(F.col("material_code").alias("item_code"),
                    F.col("matnr_desc").alias("item_description"),
                    F.coalesce("classif", F.lit(OTHERS)).alias("classification")).distinct()


def branch_list(t: Tables) -> DataFrame:
    """All branches."""
    return t.branches


def sku_count_by_class(t: Tables) -> DataFrame:
    """Number of product rows per class, the NULL class included."""
    return t.product_map.groupBy("classification").agg(F.count(F.lit(1)).alias("count"))


def table_page(df: DataFrame, order_by: list[str], limit: int = DEFAULT_PAGE_SIZE,
               offset: int = 0, after: list | None = None) -> DataFrame:
    """One page of a table. A sort key is required: an unordered page is not
    reproducible. Paging is the feature here, so the limit is the result.

    ``after`` is the sort key of the last row of the page before: the page
    starts behind it, and costs the same at any depth (a filter and a top-k of
    ``limit`` rows), while ``offset`` makes one task merge ``offset + limit``
    rows. Rows that share the whole key with that row are skipped, so the key
    should be unique.
    """
    if not order_by:
        raise ValueError("table_page needs a sort key")
    if after is not None:
        if len(after) != len(order_by):
            raise ValueError("after needs one value per sort key")
        df = df.where(_behind(order_by, after))
    return df.orderBy(*_ascending(order_by)).offset(offset).limit(limit)


def _ascending(order_by: list[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order_by]


def _behind(order_by: list[str], key: list, included: bool = False) -> Column:
    """Rows behind a sort key (ascending, NULL last), with or without the rows that have it."""
    behind, equal = F.lit(False), F.lit(True)
    for name, value in zip(order_by, key):
        c, v = F.col(name), F.lit(value)
        if value is not None:
            behind = behind | (equal & ((c > v) | c.isNull()))
        equal = equal & c.eqNullSafe(v)
    return behind | equal if included else behind


def page_fences(df: DataFrame, order_by: list[str], every: int = 100_000) -> DataFrame:
    """Every ``every``-th different sort key of a table with ``position``, the rows before it.

    To be written once per version of the table and handed to
    :func:`table_page_at`. Keys are counted, range-sorted and numbered where
    they lie; only the blocks of ``every`` keys are summed further, first
    within a range and then over the ranges. Rows that share a key stay
    together however many they are; an empty table has no fence.
    """
    counted = df.groupBy(*order_by).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = counted.repartitionByRange(*_ascending(order_by)).sortWithinPartitions(*_ascending(order_by)).withColumn(
        "_id", F.monotonically_increasing_id())          # the range above bit 33, the place in it below
    block = F.floor(F.col("_id").bitwiseAND((1 << 33) - 1) / every)
    blocks = numbered.groupBy(F.shiftright("_id", 33).alias("_range"), block.alias("_block")).agg(
        F.sum("_rows").alias("_rows"), F.min_by(F.struct(*order_by), "_id").alias("_key"))
    path = scratch_path(df.sparkSession, f"fences-{uuid.uuid4().hex}")
    blocks.write.parquet(path)                           # a second range sort might cut elsewhere
    blocks = df.sparkSession.read.schema(blocks.schema).parquet(path)

    def before(window: WindowSpec) -> Column:
        return F.coalesce(F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = blocks.groupBy("_range").agg(F.sum("_rows").alias("_rows"))         # one row per shuffle partition
    ranges = ranges.select("_range", before(Window.orderBy("_range")).alias("_before"))
    inside = blocks.select("_range", "_key", before(Window.partitionBy("_range").orderBy("_block")).alias("_inside"))
    return inside.join(ranges, "_range").select((F.col("_before") + F.col("_inside")).alias("position"), "_key.*")


def table_page_at(df: DataFrame, fences: DataFrame, order_by: list[str], limit: int = DEFAULT_PAGE_SIZE,
                  offset: int = 0) -> DataFrame:
    """The page of :func:`table_page` at ``offset``, from the last fence before it.

    The fence turns the offset into a filter on the sort key; what is left to
    skip is less than the rows of ``every`` keys, at any depth.
    """
    near = fences.where(F.col("position") <= offset).orderBy(F.desc("position")).limit(1).collect()   # one row
    if not near:
        return table_page(df, order_by, limit, offset)
    key = [near[0][c] for c in order_by]
    return table_page(df.where(_behind(order_by, key, included=True)), order_by, limit, offset - near[0]["position"])


def page(t: Tables, name: str, limit: int = DEFAULT_PAGE_SIZE, offset: int = 0,
         order_by: list[str] | None = None, after: list | None = None) -> DataFrame:
    """One page of a logical table chosen by name. Without ``order_by`` the
    page is ordered by all columns, a total order, so pages do not overlap."""
    tables = t.as_dict()
    if name not in tables:
        raise KeyError(f"unknown table {name!r}; tables: {sorted(tables)}")
    df = tables[name]
    return table_page(df, order_by or df.columns, limit=limit, offset=offset, after=after)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views visible in the current catalog and database."""
    return spark.sql("SHOW TABLES")


def tables(t: Tables) -> DataFrame:
    """The logical tables bound, with their number of rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in t.as_dict().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
