"""Dimension lookups and the monthly price pick.

Dimension joins carry no broadcast hint: the item master, the class view and
the locations are joined with Spark's size-checked choice
(``autoBroadcastJoinThreshold`` on the static estimate, AQE on the runtime
size), so a dimension that outgrows the threshold falls back to a shuffle join
instead of failing an executor.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distkpi.functions.columns import resolve_mapping_code
from distkpi.operators.filters import month_bounds
from distkpi.sources.tables import Tables

# Column names the lookups add (prefixed so they never clash with fact columns).
CLS_CODE, CLS_CLASS = "cls_mapping_code", "cls_classification"
ITM_MATNR, ITM_DESC, ITM_CLASSIF, ITM_MAPPING = "itm_matnr", "itm_desc", "itm_classif", "itm_mapping_code"
LOC_CODE, LOC_DESC = "loc_inv_sloc", "loc_inv_sloc_desc"


#: A key that holds more than one row in so many is split into parts of that size.
SHARE = 200


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark will send the whole of ``df`` to every task: its estimate is within the threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


BUCKETS = 8192


def _heavy_keys(counts: DataFrame, share: int) -> Column:
    """Scalar map of the keys with more than one row in ``share`` to the parts they are dealt to.

    ``counts`` has rows (_key, _n). One pass: the most frequent key of each of
    ``BUCKETS`` hash buckets is a candidate, so the map is bounded; of two
    heavy keys in one bucket only the heavier is split.
    """
    best = counts.where(F.col("_key").isNotNull()).groupBy(F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).alias("_b")).agg(
        F.sum("_n").alias("_s"), F.max(F.struct("_n", "_key")).alias("_m"))
    found = best.agg(F.sum("_s").alias("_t"), F.collect_list("_m").alias("_ms")).select(F.map_from_entries(F.transform(
        F.filter("_ms", lambda m: m["_n"] * share > F.col("_t")),
        lambda m: F.struct(m["_key"], F.ceil(m["_n"] * share / F.col("_t"))))))
    return found.scalar()


def spread_left_join(df: DataFrame, dim: DataFrame, key: Column, dim_key: str, spread: tuple[str, ...],
                     share: int = SHARE, counts: DataFrame | None = None) -> DataFrame:
    """Left join on ``key = dim_key`` as a shuffle join in which no key fills a task.

    Rows with a NULL key match nothing; they go to ``share`` tasks instead of
    one. Keys with more than one row in ``share`` are found by a count that is
    combined before it is shuffled (``counts`` gives it as rows (_key, _n) where
    it can be had for less); their rows are dealt to parts of that size, and the
    rows of ``dim`` with such a key are repeated for every part. ``spread`` names
    columns of ``df`` that tell rows of one key apart. The result is that of the
    plain join.
    """
    keyed = df.withColumn("_key", key)
    if counts is None:
        counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    heavy = _heavy_keys(counts, share)
    of = F.xxhash64(*spread)
    left = keyed.withColumn(
        "_part", F.when(F.col("_key").isNull(), -1 - F.pmod(of, F.lit(share)))
        .otherwise(F.coalesce(F.pmod(of, F.try_element_at(heavy, F.col("_key"))), F.lit(0))).cast("long"))
    right = dim.withColumn("_to", F.explode(F.sequence(
        F.lit(0).cast("long"), F.coalesce(F.try_element_at(heavy, F.col(dim_key)), F.lit(1)) - 1)))
    # No dimension row has a negative part, so the stand-in for NULL matches none.
    stand_in = F.lit("").cast(dim.schema[dim_key].dataType)
    joined = left.hint("merge").join(right, (F.coalesce("_key", stand_in) == F.col(dim_key))
                                     & (F.col("_part") == F.col("_to")), "left")
    return joined.select(*df.columns, *dim.columns)


def _left_join(df: DataFrame, dim: DataFrame, key: Column, dim_key: str, spread,
               counts: DataFrame | None = None) -> DataFrame:
    # A dimension that is broadcast shuffles no fact row, so no key can be hot.
    if not spread or _fits_broadcast(dim):
        return df.join(dim, key == F.col(dim_key), "left")
    return spread_left_join(df, dim, key, dim_key, spread, counts=counts)


def with_class(df: DataFrame, items_class: DataFrame, key: Column, spread: tuple[str, ...] = (),
               counts: DataFrame | None = None) -> DataFrame:
    """Left join to the item-class view on ``mapping_code = key``.

    Adds ``cls_mapping_code`` and ``cls_classification``; a duplicated mapping
    code in the view multiplies the fact rows, as an SQL join does. ``spread``:
    columns that spread hot and NULL keys when the view is too large to
    broadcast, ``counts``: rows by key (:func:`spread_left_join`).
    """
    dim = items_class.select(F.col("mapping_code").alias(CLS_CODE),
                             F.col("classification").alias(CLS_CLASS))
    return _left_join(df, dim, key, CLS_CODE, spread, counts)


def with_item(df: DataFrame, items: DataFrame, key: Column, spread: tuple[str, ...] = ()) -> DataFrame:
    """Left join to the item master on ``matnr = key``.

    Adds ``itm_matnr``, ``itm_desc``, ``itm_classif`` and the resolved mapping
    code ``itm_mapping_code`` (empty/NULL mapping falls back to ``matnr``;
    an item missing from the master resolves to NULL). ``spread`` as in
    :func:`with_class`.
    """
    dim = items.select(F.col("matnr").alias(ITM_MATNR), F.col("matnr_desc").alias(ITM_DESC),
                       F.col("classif").alias(ITM_CLASSIF),
                       resolve_mapping_code(F.col("mapping_code"), F.col("matnr")).alias(ITM_MAPPING))
    return _left_join(df, dim, key, ITM_MATNR, spread)


def with_item_class(df: DataFrame, items: DataFrame, items_class: DataFrame, key: Column,
                    spread: tuple[str, ...]) -> DataFrame:
    """:func:`with_item`, then :func:`with_class` of the resolved mapping code.

    Rows per mapping code are counted from rows per item, so the count does not
    repeat the join of the fact.
    """
    per = df.groupBy(key.alias("_item")).agg(F.count(F.lit(1)).alias("_rows"))
    counts = with_item(per, items, F.col("_item")).groupBy(F.col(ITM_MAPPING).alias("_key")).agg(
        F.sum("_rows").alias("_n"))
    return with_class(with_item(df, items, key, spread), items_class, F.col(ITM_MAPPING), spread, counts)


def with_location(df: DataFrame, locations: DataFrame, key: Column) -> DataFrame:
    """Left join to the locations on the location code compared as text."""
    dim = locations.select(F.col("inv_sloc").alias(LOC_CODE), F.col("inv_sloc_desc").alias(LOC_DESC))
    return df.join(dim, F.col(LOC_CODE).cast("string") == key.cast("string"), "left")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Duplicated keys of a dimension (empty when the dimension is clean). A duplicated
    key fans out every fact row that joins to it."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def check_dimensions(t: Tables) -> DataFrame:
    """Duplicated join keys of the dimension tables, as ``(table, key, count)``.

    Empty when every dimension is unique on the key the reports join on.
    """
    checks = [("items", t.items, "matnr"), ("items_class", t.items_class, "mapping_code"),
              ("locations", t.locations, "inv_sloc")]
    parts = [duplicate_keys(df, key).select(F.lit(name).alias("table"),
                                           F.col(key).cast("string").alias("key"), "count")
             for name, df, key in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pick_key(rank: Column, first_date: Column, price: Column) -> Column:
    # Ascending rank, then the newest date, then the highest price (NULL last),
    # as one orderable decimal: a plain min over it keeps the aggregate
    # hash-based with partial merge, and the pick does not depend on row order.
    newest = rank.cast("long") * F.lit(100_000_000) - F.unix_date(first_date).cast("long")
    tie = F.coalesce(price.cast("decimal(14,2)"), F.lit(Decimal("-99999999999")))
    return newest.cast("decimal(18,0)") * F.lit(Decimal(10) ** 12) - tie


def price_fixed(prices: DataFrame, end) -> DataFrame:
    """One price per item for the month of ``end`` with a one-month fallback.

    Candidates are the item's rows dated in the month of ``end`` or the month
    before. Preference: own month with a non-zero price, then the previous
    month (even a zero or NULL price), then the own month's zero/NULL price;
    within a rank the latest ``first_date``, on one date the highest price.
    Returns ``(item_code, price)``.
    """
    prev_lo, _ = month_bounds(end, back=1)
    own_lo, hi = month_bounds(end)
    d, p = F.col("first_date"), F.col("price")
    cand = prices.where((d >= F.lit(prev_lo)) & (d < F.lit(hi)))
    own = d >= F.lit(own_lo)
    rank = F.when(own & (F.coalesce(p, F.lit(0)) != 0), 0).when(~own, 1).otherwise(2)
    return (cand.groupBy("item_code")
            .agg(F.min_by(p, _pick_key(rank, d, p)).alias("price")))


def price_asof(prices: DataFrame, start=None, end=None) -> DataFrame:
    """Price per (item, month) with the same preference as :func:`price_fixed`,
    anchored at every month instead of one (an as-of join with one month of
    tolerance, expressed as an equi join).

    Each price row is a candidate for its own month (rank 0, or 2 when the
    price is 0/NULL) and for the month after (rank 1). Optional ``start`` /
    ``end`` restrict the result to months in that range and prune the scan.
    Returns ``(item_code, month, price)``.

    Hardly two candidates of a task share a key before the shuffle, so they are
    shuffled first: combining them there held nearly every row in memory and
    saved 1 % of the rows.
    """
    d, p = F.col("first_date"), F.col("price")
    if start is not None:
        lo, _ = month_bounds(start, back=1)
        prices = prices.where(d >= F.lit(lo))
    if end is not None:
        _, hi = month_bounds(end)
        prices = prices.where(d < F.lit(hi))
    m = F.trunc(d, "MM")
    own_rank = F.when(F.coalesce(p, F.lit(0)) != 0, 0).otherwise(2)
    cand = prices.select(
        "item_code", d.alias("first_date"), p.alias("price"),
        F.inline(F.array(
            F.struct(m.alias("month"), own_rank.alias("rank")),
            F.struct(F.add_months(m, 1).alias("month"), F.lit(1).alias("rank")))))
    if start is not None:
        cand = cand.where(F.col("month") >= F.lit(month_bounds(start)[0]))
    if end is not None:
        cand = cand.where(F.col("month") < F.lit(month_bounds(end)[1]))
    return (cand.repartition("item_code", "month").groupBy("item_code", "month")
            .agg(F.min_by(F.col("price"), _pick_key(F.col("rank"), F.col("first_date"), F.col("price"))).alias("price")))
