"""Sales reports: summary, forecast accuracy (monthly / yearly / by category),
distributor vs company target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distkpi.functions.columns import attainment, month_label, month_label_padded
from distkpi.operators.filters import (date_range, in_filter, in_month, lookback, month_bounds,
                                       not_null)
from distkpi.operators.lookup import price_asof, price_fixed
from distkpi.operators.measures import actual_vs_target, with_total_row

from distkpi.constants import OTHERS, TOTAL
from distkpi.sources.tables import Tables


def _sales(t: Tables, start, end, classification, sku, branch) -> DataFrame:
    s = date_range(t.sales, "billing_date", start, end)
    s = in_filter(s, "classification", classification)
    s = in_filter(s, "item_code", sku)
    return in_filter(s, "branch_id", branch)


def _targets(df: DataFrame, classification, sku, branch=None) -> DataFrame:
    df = in_filter(df, "classification", classification)
    df = in_filter(df, "item_code", sku)
    return in_filter(df, "loc_code", branch) if branch is not None else df


def sales_summary(t: Tables, start, end, classification=None, sku=None, branch=None) -> DataFrame:
    """Per class: number of items with a non-zero net amount, and the amount.

    Rows with a NULL class, branch or item are left out. Items whose amounts
    cancel to 0 (or are all NULL) are not counted.
    """
    s = not_null(_sales(t, start, end, classification, sku, branch),
                 "classification", "branch_id", "item_code")
    per_item = (s.groupBy("classification", "item_code").agg(F.sum("amount").alias("amount"))
                .where(F.col("amount") != 0))
    # One row per (class, item) already: COUNT(DISTINCT item) is COUNT(item).
    return per_item.groupBy("classification").agg(
        F.count("item_code").alias("sku"), F.sum("amount").alias("amount"))


def forecast_accuracy_monthly(t: Tables, start, end, classification=None, sku=None,
                              branch=None) -> DataFrame:
    """Sales in ``[start, end]`` against the targets of the month of ``end``.

    One row; ``pct`` is the unrounded ratio amount/target, NULL when the
    target is 0 (the source raised a division error there).
    """
    s = not_null(_sales(t, start, end, classification, sku, branch),
                 "classification", "branch_id", "item_code")
    a = s.agg(F.sum("amount").alias("amount"))
    tg = not_null(_targets(in_month(t.targets, "target_date", end), classification, sku, branch),
                  "loc_code", "item_code")
    b = tg.agg(F.sum("target_value").alias("target_value"))
    r = actual_vs_target(a, b, [])
    return r.select("amount",
                    "target_value",
                    attainment(F.col("amount"), F.col("target_value"), zero="raw").alias("pct"))


def target_to_date(t: Tables, start, end, classification=None, sku=None, branch=None) -> DataFrame:
    """Targets dated in ``[start, end]`` (one row; amount is a constant 0)."""
    tg = not_null(_targets(date_range(t.targets, "target_date", start, end), classification,
                           sku, branch), "loc_code", "item_code")
    return tg.agg(F.sum("target_value").alias("target_value")).select(
        F.lit(0).cast("decimal(18,4)").alias("amount"), "target_value")


def forecast_accuracy_yearly(t: Tables, start, end, classification=None, sku=None,
                             branch=None) -> DataFrame:
    """Sold quantity valued at the month-of-``end`` price against the budget.

    The price of an item is picked once (:func:`price_fixed`), so quantities
    are summed per item before the join: the join input is one row per item,
    not one per sale. ``pct`` is amount/budget rounded to 2 (a ratio, not a
    percent), 0 when either side is 0.
    """
    s = _sales(t, start, end, classification, sku, branch)
    qty = s.groupBy("classification", "item_code").agg(F.sum("sold_qty").alias("qty"))
    price = price_fixed(t.price_list, end)
    # Valued per class (no sales: no row, so an empty budget stays NULL).
    amount = (qty.join(price, "item_code", "left").groupBy("classification")
              .agg(F.sum(F.col("qty") * F.coalesce(F.col("price"), F.lit(0))).alias("amount")))
    bud = _targets(date_range(t.budget, "target_date", start, end), classification, sku)
    target = bud.agg(F.sum("value").alias("target_value"))
    r = actual_vs_target(amount.select("amount"), target, [])
    return r.select("amount",
                    "target_value",
                    attainment(F.col("amount"), F.col("target_value"), zero="zero", scale=1,
                               digits=2).alias("pct"))


def _by_class_month(actual: DataFrame, target: DataFrame, label) -> DataFrame:
    """Union-aligned (class, month) sums with the month label and percent."""
    keys = ["classification", "month_date"]
    r = actual_vs_target(actual, target, keys)
    return (r.orderBy(F.desc_nulls_first("month_date"), F.asc_nulls_last("classification"))
            .select("classification", label(F.col("month_date")).alias("month"),
                    "amount",
                    "target_value",
                    attainment(F.col("amount"), F.col("target_value"), zero="zero").alias("pct")))


def forecast_accuracy_category_monthly(t: Tables, end, classification=None, sku=None,
                                       branch=None) -> DataFrame:
    """Per (class, month) over the three months up to ``end``: sales against
    targets, the month labelled ``'Month YYYY'`` with the name padded to 9."""
    s = lookback(t.sales, "billing_date", end, 3, through="day")
    s = in_filter(in_filter(in_filter(s, "classification", classification), "item_code", sku),
                  "branch_id", branch)
    sa = s.groupBy(F.coalesce("classification", F.lit(OTHERS)).alias("classification"),
                   F.trunc("billing_date", "MM").alias("month_date")).agg(
        F.sum("amount").alias("amount"))
    tg = lookback(t.targets, "target_date", end, 3, through="day")
    tg = not_null(_targets(tg, classification, sku, branch), "loc_code", "item_code")
    ta = tg.groupBy(F.coalesce("classification", F.lit(OTHERS)).alias("classification"),
                    F.trunc("target_date", "MM").alias("month_date")).agg(
        F.sum("target_value").alias("target_value"))
    return _by_class_month(sa, ta, month_label_padded)


def forecast_accuracy_category_yearly(t: Tables, end, classification=None, sku=None,
                                      branch=None) -> DataFrame:
    """Per (class, month) over the three calendar months ending with the month
    of ``end``: sold quantity valued at the as-of price of its own month
    (falling back to the previous month) against the budget."""
    lo, _ = month_bounds(end, back=2)
    s = lookback(t.sales, "billing_date", end, 3, through="month")
    s = in_filter(in_filter(in_filter(s, "classification", classification), "item_code", sku),
                  "branch_id", branch)
    qty = s.groupBy("item_code", "classification",
                    F.trunc("billing_date", "MM").alias("month")).agg(F.sum("sold_qty").alias("qty"))
    price = price_asof(t.price_list, lo, end)
    sa = (qty.join(price, ["item_code", "month"], "left")
          .groupBy(F.coalesce("classification", F.lit(OTHERS)).alias("classification"),
                   F.col("month").alias("month_date"))
          .agg(F.sum(F.col("qty") * F.coalesce(F.col("price"), F.lit(0))).alias("amount")))
    b = lookback(t.budget, "target_date", end, 3, through="month")
    b = _targets(b, classification, sku)
    ta = b.groupBy(F.coalesce("classification", F.lit(OTHERS)).alias("classification"),
                   F.trunc("target_date", "MM").alias("month_date")).agg(
        F.sum("value").alias("target_value"))
    return _by_class_month(sa, ta, month_label)


def distributor_vs_company_target(t: Tables, end, classification=None, sku=None,
                                  branch=None) -> DataFrame:
    """Month-of-``end`` distributor targets against the company budget per
    class (full outer, missing side 0), plus a ``Total`` row whose percent
    is recomputed from the summed sides."""
    d = not_null(_targets(in_month(t.targets, "target_date", end), classification, sku, branch),
                 "loc_code", "item_code")
    d = d.groupBy(F.coalesce("classification", F.lit(OTHERS)).alias("classification")).agg(
        F.sum("target_value").alias("d_target"))
    c = not_null(_targets(in_month(t.budget, "target_date", end), classification, sku), "item_code")
    c = c.groupBy(F.coalesce("classification", F.lit(OTHERS)).alias("classification")).agg(
        F.sum("value").alias("c_target"))
    comb = d.join(c, "classification", "full").select(
        F.coalesce("classification", F.lit(OTHERS)).alias("classification"),
        F.coalesce("d_target", F.lit(0)).alias("distributor_target"),
        F.coalesce("c_target", F.lit(0)).alias("company_target"))

    def pct(a, b):
        return attainment(a, b, zero="denominator")

    comb = comb.withColumn("distributor_vs_company_pct",
                           pct(F.col("distributor_target"), F.col("company_target")))
    full = with_total_row(comb, "classification", TOTAL, ["distributor_target", "company_target"],
                          {"distributor_vs_company_pct": pct})
    return full.select("classification",
                       "distributor_target",
                       "company_target",
                       "distributor_vs_company_pct")
