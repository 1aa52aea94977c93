"""Inventory reports: cover days, closing date, item x branch cover, thresholds,
service measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distkpi.functions.columns import (cover_days as cover_expr, count_share_pct, daily_target,
                                       days_in_month, round_ratio, threshold_for, THRESHOLD_DAYS)
from distkpi.operators.filters import in_filter, in_values
from distkpi.operators.lookup import (CLS_CLASS, CLS_CODE, ITM_DESC, ITM_MAPPING, LOC_CODE,
                                      LOC_DESC)
from distkpi.operators.measures import (classified_stock, classified_targets, opening_stock_by_mapping,
                                        optional_in, pivot_max, stock_value, target_value,
                                        targets_by_mapping, threshold_counts)

from distkpi.operators.snapshot import load_dates

from distkpi.constants import BRANCH_COLUMNS, COVER_CEILING, OTHERS, SELL_SUFFIX, UNKNOWN
from distkpi.sources.tables import Tables

SERVICE_BRANCHES = list(BRANCH_COLUMNS)


def cover_days(t: Tables, start, end, classification=None, sku=None, branch=None) -> DataFrame:
    """Cover days per item class: closing stock value against the month's target.

    The target side drives: a class with stock but no target is not listed.
    Stock is grouped by the raw class and labelled ``Others`` afterwards, so a
    NULL class and a literal ``Others`` class stay two stock rows.
    """
    days = days_in_month(end)
    rows = classified_stock(t, start, end, classification, sku, branch)
    stk = stock_value(rows, F.col(CLS_CLASS).alias("raw_class")).select(
        F.coalesce("raw_class", F.lit(OTHERS)).alias("stk_class"), "inv_val", "inv_val_efp", "quantity")
    tg = classified_targets(t, end, classification, sku, branch)
    ft = target_value(tg, F.coalesce(F.col(CLS_CLASS), F.lit(OTHERS)).alias("classification"))
    j = ft.join(stk, ft["classification"] == stk["stk_class"], "left")
    return (j.select(
        "classification",
        "inv_val",
        "inv_val_efp",
        "trg_value",
        "quantity",
        daily_target(F.col("trg_value"), days).alias("daily_target"),
        cover_expr(F.col("inv_val"), F.col("trg_value"), days).alias("cover_days"),
        cover_expr(F.col("inv_val_efp"), F.col("trg_value"), days).alias("cover_days_efp"))
        .orderBy(F.asc_nulls_last("classification")))


def closing_inventory_date(t: Tables) -> DataFrame:
    """Newest stock closing date in the whole history (one row)."""
    return load_dates(t, "stock").agg(F.max("stock_closing_date").alias("closing_date"))


def cover_days_total(t: Tables, start, end, classification=None, sku=None, branch=None) -> DataFrame:
    """:func:`cover_days` over all classes: exactly one row."""
    days = days_in_month(end)
    stk = stock_value(classified_stock(t, start, end, classification, sku, branch))
    ft = target_value(classified_targets(t, end, classification, sku, branch))
    # Both sides are global aggregates (one row each): the cross join is 1 x 1.
    j = stk.crossJoin(ft)
    return j.select(
        "inv_val",
        "trg_value",
        "quantity",
        "inv_val_efp",
        daily_target(F.col("trg_value"), days).alias("daily_target"),
        cover_expr(F.col("inv_val"), F.col("trg_value"), days).alias("cover_days"),
        cover_expr(F.col("inv_val_efp"), F.col("trg_value"), days).alias("cover_days_efp"))


def target_vs_actual_cover(t: Tables, start, end, classification=None, sku=None, branch=None,
                           thresholds: dict[str, int] | None = None) -> DataFrame:
    """Target cover days of each class next to the actual cover days.

    Raw classes on both sides, only the threshold classes of the target side.
    The class shown is the target side's (it is always set).
    """
    thresholds = thresholds or THRESHOLD_DAYS
    days = days_in_month(end)
    stk = stock_value(classified_stock(t, start, end, classification, sku, branch),
                      F.col(CLS_CLASS).alias("stk_class"))
    tg = classified_targets(t, end, classification, sku, branch)
    tg = tg.where(F.col(CLS_CLASS).isin(list(thresholds)))
    ft = target_value(tg, F.col(CLS_CLASS).alias("classification"))
    j = ft.join(stk, ft["classification"] == stk["stk_class"], "left")
    return (j.select(
        "classification",
        threshold_for(F.col("classification"), thresholds).alias("cover_days_tgt"),
        cover_expr(F.col("inv_val"), F.col("trg_value"), days).alias("cover_days"))
        .orderBy(F.asc_nulls_last("classification")))


def _item_branch_inventory(t: Tables, start, end, classification, sku, branch,
                           branches: list[str] | None = None, with_desc: bool = False) -> DataFrame:
    """Opening stock value per (branch, class, resolved mapping code)."""
    rows = opening_stock_by_mapping(t, start, end)
    rows = optional_in(rows, CLS_CLASS, classification)
    rows = optional_in(rows, CLS_CODE, sku)
    rows = optional_in(rows, LOC_CODE, branch)
    if branches is not None:
        rows = rows.where(in_values(F.col(LOC_CODE), rows.schema[LOC_CODE].dataType, branches))
    keys = [F.col(LOC_CODE).alias("branch_code"), F.col(CLS_CLASS).alias("raw_class"),
            F.col(ITM_MAPPING).alias("mapping_code")]
    if with_desc:
        keys.append(F.col(LOC_DESC).alias("branch_sloc_desc"))
    # max() over a text label runs as a sort-based aggregate (O(1) state per
    # group, spills); collecting the labels instead would be hash-based but its
    # state grows with the number of distinct labels of a hot group.
    iv = rows.groupBy(*keys).agg(F.max(ITM_DESC).alias("prd"),
                                 F.sum(F.col("qty") * F.col("trade_price")).alias("inv_val"))
    return iv.select(F.coalesce("raw_class", F.lit(OTHERS)).alias("classification"), "prd",
                     "branch_code", "inv_val", "mapping_code")


def _item_branch_targets(t: Tables, end, classification, sku, branch,
                         branches: list[str] | None = None) -> DataFrame:
    """Month target per (branch, class of the item code, resolved mapping code)."""
    rows = targets_by_mapping(t, end, class_on="item")
    rows = optional_in(rows, CLS_CLASS, classification)
    rows = optional_in(rows, CLS_CODE, sku)
    rows = optional_in(rows, "loc_code", branch)
    if branches is not None:
        rows = in_filter(rows, "loc_code", branches)
    ft = rows.groupBy(F.col("loc_code").alias("branch_code"), F.col(CLS_CLASS).alias("raw_class"),
                      F.col(ITM_MAPPING).alias("mapping_code")).agg(
        F.sum("target_value").alias("trg_value"))
    return ft.select(F.coalesce("raw_class", F.lit(OTHERS)).alias("classification"),
                     "branch_code", "trg_value", "mapping_code")


def inventory_days(t: Tables, start, end, classification=None, sku=None, branch=None,
                   branch_columns: dict[str, str] | None = None) -> DataFrame:
    """Cover days per (class, item) with one column per branch and their average.

    Stock drives (item x branch rows without a target get NULL cover). The
    ``total`` column averages the cover of *all* branches of the item, not
    only the listed ones.
    """
    branch_columns = branch_columns or BRANCH_COLUMNS
    days = days_in_month(end)
    iv = _item_branch_inventory(t, start, end, classification, sku, branch)
    ft = _item_branch_targets(t, end, classification, sku, branch).select(
        F.col("branch_code").alias("t_branch"), F.col("classification").alias("t_class"),
        F.col("mapping_code").alias("t_mapping"), "trg_value")
    j = iv.join(ft, (iv["branch_code"] == ft["t_branch"]) & (iv["classification"] == ft["t_class"])
                & (iv["mapping_code"] == ft["t_mapping"]), "left")
    detail = j.select("classification", "prd", "branch_code",
                      cover_expr(F.col("inv_val"), F.col("trg_value"), days).alias("cover_days"))
    wide = pivot_max(detail, ["classification", "prd"], "branch_code", branch_columns, "cover_days",
                     round_ratio(F.sum("cover_days"), F.count("cover_days"), 1).alias("total"))
    return (wide.orderBy(F.asc_nulls_last("classification"), F.asc_nulls_last("prd"))
            .select(F.coalesce("classification", F.lit(OTHERS)).alias("classification"),
                    F.coalesce("prd", F.lit(UNKNOWN)).alias("item_desc"),
                    *branch_columns.values(), "total"))


def above_below_threshold(t: Tables, start, end, sku=None, branch=None,
                          thresholds: dict[str, int] | None = None,
                          classification=None) -> DataFrame:
    """Per class, the number of SKUs whose cover is above / at-or-below the
    class threshold. SKUs come from the class view (threshold classes only);
    stock and targets are summed over all branches per mapping code. A SKU
    without target has NULL cover and is in neither count. ``classification``
    is accepted and not applied, as in the source report."""
    thresholds = thresholds or THRESHOLD_DAYS
    days = days_in_month(end)
    # Partitioned by the join key first: the distinct and both joins on
    # mapping_code then reuse one partitioning (one shuffle of the class view).
    base = (t.items_class.where(F.col("classification").isin(list(thresholds)))
            .select("mapping_code", F.coalesce("classification", F.lit(OTHERS)).alias("classification"))
            .repartition("mapping_code").distinct())
    srows = opening_stock_by_mapping(t, start, end)
    srows = optional_in(srows, CLS_CODE, sku)
    srows = in_filter(srows, "subinventory_code", branch)
    iv = srows.groupBy(F.col(ITM_MAPPING).alias("iv_mapping")).agg(
        F.sum(F.col("qty") * F.col("trade_price")).alias("inv_val"))
    trows = targets_by_mapping(t, end, class_on="mapping")
    trows = optional_in(trows, CLS_CODE, sku)
    trows = in_filter(trows, "loc_code", branch)
    ft = trows.groupBy(F.col(ITM_MAPPING).alias("ft_mapping")).agg(
        F.sum("target_value").alias("trg_value"))
    j = (base.join(iv, base["mapping_code"] == iv["iv_mapping"], "left")
         .join(ft, base["mapping_code"] == ft["ft_mapping"], "left"))
    cover = cover_expr(F.coalesce("inv_val", F.lit(0)), F.coalesce("trg_value", F.lit(0)), days,
                       snap=False)
    summary = j.select("classification", cover.alias("cover_days"))
    limit = threshold_for(F.col("classification"), thresholds)
    return (threshold_counts(summary, ["classification"], F.col("cover_days") > limit,
                             F.col("cover_days") <= limit, "skus_above", "skus_below")
            .orderBy(F.asc_nulls_last("classification")))


def service_measure(t: Tables, start, end, classification=None, sku=None, branch=None,
                    branches: list[str] | None = None,
                    thresholds: dict[str, int] | None = None) -> DataFrame:
    """Per branch, the share of target SKUs of each class whose cover lies
    above the class threshold (and below a ceiling of 9999 days).

    Targets drive; the branch whitelist filters a group key of the driving
    side, so it is applied to both inputs before any aggregate.
    """
    branches = [str(b) for b in (branches or SERVICE_BRANCHES)]
    thresholds = thresholds or THRESHOLD_DAYS
    days = days_in_month(end)
    iv = _item_branch_inventory(t, start, end, classification, sku, branch, branches,
                                with_desc=True).select(
        F.col("branch_code").alias("s_branch"), F.col("classification").alias("s_class"),
        F.col("mapping_code").alias("s_mapping"), "inv_val")
    ft = _item_branch_targets(t, end, classification, sku, branch, branches)
    loc = t.locations.select(
        F.col("inv_sloc").alias("l_sloc"),
        F.replace(F.col("inv_sloc_desc"), F.lit(SELL_SUFFIX), F.lit("")).alias("branch_desc"))
    j = (ft.join(iv, (ft["branch_code"] == iv["s_branch"]) & (ft["classification"] == iv["s_class"])
                 & (ft["mapping_code"] == iv["s_mapping"]), "left")
         .join(loc, F.col("l_sloc") == ft["branch_code"], "left"))
    cover = F.coalesce(cover_expr(F.col("inv_val"), F.col("trg_value"), days), F.lit(0))
    limit = threshold_for(F.col("classification"), thresholds)
    detail = j.select("branch_code", "branch_desc", "classification", "mapping_code",
                      ((cover > limit) & (cover < COVER_CEILING)).alias("above"))
    # COUNT(DISTINCT mapping) and COUNT(DISTINCT mapping if above) as two plain
    # aggregates: first one row per mapping code, then counts per class.
    per_sku = detail.groupBy("branch_code", "branch_desc", "classification", "mapping_code").agg(
        F.max("above").alias("above"))
    totals = per_sku.groupBy("branch_code", "branch_desc", "classification").agg(
        F.count("mapping_code").alias("total_sku"),
        F.count(F.when(F.col("above") & F.col("mapping_code").isNotNull(), 1)).alias("sku_above"))
    pct = count_share_pct(F.col("sku_above"), F.col("total_sku"))
    pct_cols = {c: f"sku_{c.lower()}_pct" for c in thresholds}
    wide = totals.groupBy("branch_code", "branch_desc").agg(
        *[F.max(F.when(F.col("classification") == c, pct)).alias(name)
          for c, name in pct_cols.items()])
    return (wide.orderBy(F.asc_nulls_last("branch_desc"))
            .select(F.col("branch_desc").alias("branch"), *pct_cols.values()))
