"""

``entry(spark)`` runs the flagship report on sf0.001; ``queries()`` maps every
registered report/operator to a callable ``(spark, sf_dir) -> DataFrame``;
``oracle_sql()`` gives, for the same keys, DuckDB SQL over the raw test tables
(the logical tables are derived inside the SQL by the same derivation text the
Spark side uses). Every query reads the whole test tables.

The reports derive their logical tables from the raw tables on every call
(this is the correctness path): ``targets``, ``stock`` and ``budget`` are
aggregates of the whole lineitem table, and date filters on a derived month do
not reach Parquet. At scale the reports run on the marts of
``distkpi.sources.marts``, which ``bench.py`` measures.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from distkpi.functions.columns import normalize_item_code, resolve_mapping_code  # noqa: E402
from distkpi.operators import filters as flt  # noqa: E402
from distkpi.operators.lookup import CLS_CLASS, price_asof, price_fixed, with_class  # noqa: E402
from distkpi.operators.measures import (classified_stock, classified_targets, stock_value,  # noqa: E402
                                        target_value)
from distkpi.operators.snapshot import latest_snapshot  # noqa: E402
from distkpi.plans import documented as doc  # noqa: E402
from distkpi.plans import lists, sales, stock, supply  # noqa: E402
from distkpi.sources.testdata import load_tables  # noqa: E402

try:
    from distkpi.llm.queries import ORACLE_SQL as LLM_ORACLE_SQL, QUERIES as LLM_QUERIES
except ImportError:          # the subpackage is optional
    LLM_QUERIES, LLM_ORACLE_SQL = {}, {}
try:
    from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL, run as run_pipeline
except ImportError:
    run_pipeline = PIPELINE_SQL = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Report parameters of the registered queries (the test data spans 1995-2001).
S, E = "2000-03-01", "2000-03-31"            # one month window
DS, DE = "2000-01-01", "2000-03-31"          # documented metrics: one quarter
LS, LE = "2000-02-01", "2000-02-29"          # a leap February (29-day month arithmetic)
Q3 = "2000-09-30"                            # a quarter labelled July / August / September
BL = "P07"
# Report parameters under test in the *_filtered variants (a user's selection
# of classes, branches and SKUs; the unfiltered variants read everything).
FILTERS = {"classification": ["A", "C"],
           "branch": ["8003", "8010", "8021", "8042", "8057", "8066", "8078", "8090"]}
SKUS = {"sku": ["1013000001", "1013000005", "1013000014", "F00000000017", "F00000000034", "1013000101",
                "1013000250", "402", "777", "999", "1203", "1013001508"]}
ALL = {**FILTERS, **SKUS}
SERVICE = {"classification": ["A", "B"], "branch": ["8006", "8018", "8035", "8046", "8072"]}

_cache: list = []   # [(session, sf_dir, tables)]: the lazy tables of the last call


def _tables(spark: SparkSession, sf_dir):
    sf_dir = str(sf_dir)
    if not (_cache and _cache[0][0] is spark and _cache[0][1] == sf_dir):
        _cache[:] = [(spark, sf_dir, load_tables(spark, sf_dir))]
    return _cache[0][2]


def _as_double(df: DataFrame) -> DataFrame:
    """Reports return exact decimals; only the comparison reads them as doubles."""
    return _dbl(df, *[f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)])


def _dbl(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# Operator-level views (each exposes one reusable operator on whole tables).

def _op_filter_optional_in(t):
    s = flt.in_filter(flt.in_filter(t.sales, "classification", FILTERS["classification"]),
                      "branch_id", FILTERS["branch"])
    return s.groupBy("classification", "branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


def _op_filter_lookback(t):
    s = flt.lookback(t.sales, "billing_date", E, 3, through="day")
    return s.groupBy(F.trunc("billing_date", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


def _op_latest_snapshot(t):
    snap = latest_snapshot(t.stock, "stock_closing_date", S, E,
                           where=F.col("busline_code").isin(list(flt.BUSINESS_LINES)))
    return _dbl(snap, "qty", "trade_price", "item_cost")


def _op_item_code_normalized(t):
    return t.stock.select("item_code",
                          normalize_item_code(F.col("item_code")).alias("normalized_code")).distinct()


def _op_mapping_code_resolved(t):
    return t.items.select("matnr", resolve_mapping_code(F.col("mapping_code"),
                                                        F.col("matnr")).alias("mapping_code"))


def _op_classified(t):
    c = with_class(t.stock, t.items_class, normalize_item_code(F.col("item_code")))
    return c.groupBy(F.col(CLS_CLASS).alias("classification")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").cast("double").alias("qty"))


def _op_stock_value_by_class(t):
    v = stock_value(classified_stock(t, S, E), F.col(CLS_CLASS).alias("classification"))
    return _dbl(v, "inv_val", "inv_val_efp", "quantity")


def _op_target_value_by_class(t):
    v = target_value(classified_targets(t, E),
                     F.coalesce(F.col(CLS_CLASS), F.lit("Others")).alias("classification"))
    return _dbl(v, "trg_value")


def _op_price_fixed_month(t):
    return _dbl(price_fixed(t.price_list, E), "price")


def _op_price_asof_month(t):
    return _dbl(price_asof(t.price_list), "price")


def _op_stock_rows_nonzero(t):
    """Sellable rows of the newest load with stock, by class: decides the sub-inventory,
    zero-quantity, duplicated-code and raw-class rules."""
    rows = classified_stock(t, S, E)
    return rows.groupBy(F.col(CLS_CLASS).alias("classification"), "subinventory_code").agg(
        F.count(F.lit(1)).alias("n"))


def _op_common_filter(t):
    h = flt.common_sales_filter(t.sales_header, DS, DE)
    return h.groupBy("data_flag", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross_amount").cast("double").alias("gross_amount"))


CASES: dict[str, Callable] = {
    # Mounted reports.
    "sales_summary": lambda t: sales.sales_summary(t, S, E),
    "sales_summary_filtered": lambda t: sales.sales_summary(t, S, E, **FILTERS),
    "sales_summary_sku": lambda t: sales.sales_summary(t, S, E, **SKUS),
    "cover_days": lambda t: stock.cover_days(t, S, E),
    "cover_days_filtered": lambda t: stock.cover_days(t, S, E, **FILTERS),
    "cover_days_sku": lambda t: stock.cover_days(t, S, E, **SKUS),
    "cover_days_leap_february": lambda t: stock.cover_days(t, LS, LE),
    "closing_inventory_date": lambda t: stock.closing_inventory_date(t),
    "cover_days_total": lambda t: stock.cover_days_total(t, S, E),
    "cover_days_total_filtered": lambda t: stock.cover_days_total(t, S, E, **FILTERS),
    "forecast_accuracy_monthly": lambda t: sales.forecast_accuracy_monthly(t, S, E),
    "forecast_accuracy_monthly_filtered": lambda t: sales.forecast_accuracy_monthly(t, S, E, **FILTERS),
    "target_to_date": lambda t: sales.target_to_date(t, S, E),
    "target_to_date_filtered": lambda t: sales.target_to_date(t, S, E, **ALL),
    "forecast_accuracy_yearly": lambda t: sales.forecast_accuracy_yearly(t, DS, DE),
    "forecast_accuracy_yearly_filtered": lambda t: sales.forecast_accuracy_yearly(t, DS, DE, **ALL),
    "inventory_days": lambda t: stock.inventory_days(t, S, E),
    "inventory_days_filtered": lambda t: stock.inventory_days(t, S, E, **FILTERS),
    "inventory_days_sku": lambda t: stock.inventory_days(t, S, E, **SKUS),
    "inventory_days_leap_february": lambda t: stock.inventory_days(t, LS, LE),
    "above_below_threshold": lambda t: stock.above_below_threshold(t, S, E),
    "above_below_threshold_filtered": lambda t: stock.above_below_threshold(
        t, S, E, sku=ALL["sku"], branch=ALL["branch"]),
    "forecast_accuracy_category_monthly": lambda t: sales.forecast_accuracy_category_monthly(t, E),
    "forecast_accuracy_category_monthly_filtered":
        lambda t: sales.forecast_accuracy_category_monthly(t, E, **FILTERS),
    "forecast_accuracy_category_monthly_q3":
        lambda t: sales.forecast_accuracy_category_monthly(t, Q3),
    "forecast_accuracy_category_yearly": lambda t: sales.forecast_accuracy_category_yearly(t, E),
    "forecast_accuracy_category_yearly_q3": lambda t: sales.forecast_accuracy_category_yearly(t, Q3),
    "forecast_accuracy_category_yearly_filtered":
        lambda t: sales.forecast_accuracy_category_yearly(t, E, **ALL),
    "distributor_vs_company_target": lambda t: sales.distributor_vs_company_target(t, E),
    "distributor_vs_company_target_filtered":
        lambda t: sales.distributor_vs_company_target(t, E, **FILTERS),
    "service_measure": lambda t: stock.service_measure(t, S, E),
    "service_measure_filtered": lambda t: stock.service_measure(t, S, E, **SERVICE),
    "target_vs_actual_cover": lambda t: stock.target_vs_actual_cover(t, S, E),
    "target_vs_actual_cover_filtered": lambda t: stock.target_vs_actual_cover(t, S, E, **FILTERS),
    "dispatch_vs_order": lambda t: supply.dispatch_vs_order(t, S, E),
    "dispatch_vs_order_filtered": lambda t: supply.dispatch_vs_order(
        t, S, E, classification=FILTERS["classification"]),
    "dispatch_vs_order_sku": lambda t: supply.dispatch_vs_order(t, S, E, **SKUS),
    "wip": lambda t: supply.wip(t, S, E),
    "stock_valuation": lambda t: supply.stock_valuation(t, S, E),
    "item_filter_list": lambda t: lists.item_filter_list(t),
    "branch_list": lambda t: lists.branch_list(t),
    "sku_count_by_class": lambda t: lists.sku_count_by_class(t),
    "list_tables": lambda t: lists.tables(t),
    "table_page": lambda t: lists.table_page(t.items, ["matnr"], limit=1000, offset=100),
    "table_page_at": lambda t: lists.table_page_at(t.items, lists.page_fences(t.items, ["matnr"], every=256), ["matnr"],
                                                   limit=500, offset=1000),
    "table_page_after": lambda t: lists.table_page(t.items, ["matnr"], limit=1000, after=["0000000099"]),
    # Documented sales metrics.
    "gross_summary": lambda t: doc.gross_summary(t, DS, DE),
    "revenue_total": lambda t: doc.revenue_total(t, DS, DE),
    "customer_universe": lambda t: doc.customer_universe(t, DS, DE),
    "purchase_frequency": lambda t: doc.purchase_frequency(t, DS, DE),
    "outlets_4_plus_purchases": lambda t: doc.outlets_with_n_purchases(t, DS, DE, 4),
    "outlets_3_purchases": lambda t: doc.outlets_with_n_purchases(t, DS, DE, 3),
    "outlets_2_purchases": lambda t: doc.outlets_with_n_purchases(t, DS, DE, 2),
    "outlets_1_purchase": lambda t: doc.outlets_with_n_purchases(t, DS, DE, 1),
    "productive_outlets": lambda t: doc.productive_outlets(t, DS, DE),
    "top_sku_class_a": lambda t: doc.top_sku_class_a(t, DS, DE),
    "business_lines": lambda t: doc.business_lines(t),
    "products": lambda t: doc.products(t, BL),
    "locations": lambda t: doc.locations(t, BL),
    "regional_distributors": lambda t: doc.regional_distributors(t, BL),
    # Reusable operators on their own.
    "filter_optional_in": _op_filter_optional_in,
    "filter_lookback": _op_filter_lookback,
    "latest_snapshot": _op_latest_snapshot,
    "item_code_normalized": _op_item_code_normalized,
    "mapping_code_resolved": _op_mapping_code_resolved,
    "classified": _op_classified,
    "stock_value_by_class": _op_stock_value_by_class,
    "target_value_by_class": _op_target_value_by_class,
    "price_fixed_month": _op_price_fixed_month,
    "price_asof_month": _op_price_asof_month,
    "common_filter": _op_common_filter,
    "stock_rows_nonzero": _op_stock_rows_nonzero,
    "outlets_4_plus_purchases_history": lambda t: doc.outlets_with_n_purchases(t, "1995-01-01", "2001-12-31", 4),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship report (cover days per class) on the sf0.001 tables."""
    return stock.cover_days(_tables(spark, SMOKE_DIR), S, E)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, _f=fn: _as_double(_f(_tables(spark, sf_dir))))
           for name, fn in CASES.items()}
    out.update(LLM_QUERIES)
    if run_pipeline is not None:
        out["pipeline"] = run_pipeline
    return out


def oracle_sql() -> dict[str, str]:
    from kpi_oracle import sql as o
    out = {
        "sales_summary": o.sales_summary(S, E),
        "sales_summary_filtered": o.sales_summary(S, E, **FILTERS),
        "sales_summary_sku": o.sales_summary(S, E, **SKUS),
        "cover_days": o.cover_days(S, E),
        "cover_days_filtered": o.cover_days(S, E, **FILTERS),
        "cover_days_sku": o.cover_days(S, E, **SKUS),
        "cover_days_leap_february": o.cover_days(LS, LE),
        "closing_inventory_date": o.closing_inventory_date(),
        "cover_days_total": o.cover_days_total(S, E),
        "cover_days_total_filtered": o.cover_days_total(S, E, **FILTERS),
        "forecast_accuracy_monthly": o.forecast_accuracy_monthly(S, E),
        "forecast_accuracy_monthly_filtered": o.forecast_accuracy_monthly(S, E, **FILTERS),
        "target_to_date": o.target_to_date(S, E),
        "target_to_date_filtered": o.target_to_date(S, E, **ALL),
        "forecast_accuracy_yearly": o.forecast_accuracy_yearly(DS, DE),
        "forecast_accuracy_yearly_filtered": o.forecast_accuracy_yearly(DS, DE, **ALL),
        "inventory_days": o.inventory_days(S, E),
        "inventory_days_filtered": o.inventory_days(S, E, **FILTERS),
        "inventory_days_sku": o.inventory_days(S, E, **SKUS),
        "inventory_days_leap_february": o.inventory_days(LS, LE),
        "above_below_threshold": o.above_below_threshold(S, E),
        "above_below_threshold_filtered": o.above_below_threshold(S, E, sku=ALL["sku"],
                                                                  branch=ALL["branch"]),
        "forecast_accuracy_category_monthly": o.forecast_accuracy_category_monthly(E),
        "forecast_accuracy_category_monthly_filtered":
            o.forecast_accuracy_category_monthly(E, **FILTERS),
        "forecast_accuracy_category_monthly_q3": o.forecast_accuracy_category_monthly(Q3),
        "forecast_accuracy_category_yearly": o.forecast_accuracy_category_yearly(E),
        "forecast_accuracy_category_yearly_q3": o.forecast_accuracy_category_yearly(Q3),
        "forecast_accuracy_category_yearly_filtered": o.forecast_accuracy_category_yearly(E, **ALL),
        "distributor_vs_company_target": o.distributor_vs_company_target(E),
        "distributor_vs_company_target_filtered": o.distributor_vs_company_target(E, **FILTERS),
        "service_measure": o.service_measure(S, E),
        "service_measure_filtered": o.service_measure(S, E, **SERVICE),
        "target_vs_actual_cover": o.target_vs_actual_cover(S, E),
        "target_vs_actual_cover_filtered": o.target_vs_actual_cover(S, E, **FILTERS),
        "dispatch_vs_order": o.dispatch_vs_order(S, E),
        "dispatch_vs_order_filtered": o.dispatch_vs_order(S, E,
                                                          classification=FILTERS["classification"]),
        "dispatch_vs_order_sku": o.dispatch_vs_order(S, E, **SKUS),
        "wip": o.wip(S, E),
        "stock_valuation": o.stock_valuation(S, E),
        "item_filter_list": o.item_filter_list(),
        "branch_list": o.branch_list(),
        "sku_count_by_class": o.sku_count_by_class(),
        "list_tables": o.list_tables(),
        "table_page": o.table_page("items", ["matnr"], 1000, 100),
        "table_page_at": o.table_page("items", ["matnr"], 500, 1000),
        "table_page_after": o.table_page_after("items", "matnr", "0000000099", 1000),
        "gross_summary": o.gross_summary(DS, DE),
        "revenue_total": o.revenue_total(DS, DE),
        "customer_universe": o.customer_universe(DS, DE),
        "purchase_frequency": o.purchase_frequency(DS, DE),
        "outlets_4_plus_purchases": o.outlets_with_n_purchases(DS, DE, 4),
        "outlets_3_purchases": o.outlets_with_n_purchases(DS, DE, 3),
        "outlets_2_purchases": o.outlets_with_n_purchases(DS, DE, 2),
        "outlets_1_purchase": o.outlets_with_n_purchases(DS, DE, 1),
        "productive_outlets": o.productive_outlets(DS, DE),
        "top_sku_class_a": o.top_sku_class_a(DS, DE),
        "business_lines": o.business_lines(),
        "products": o.products(BL),
        "locations": o.locations(BL),
        "regional_distributors": o.regional_distributors(BL),
        "stock_rows_nonzero": o.stock_rows_nonzero(S, E),
        "outlets_4_plus_purchases_history": o.outlets_with_n_purchases("1995-01-01", "2001-12-31", 4),
    }
    out.update(o.operator_sql(S, E, DS, DE, FILTERS))
    out.update(LLM_ORACLE_SQL)
    if PIPELINE_SQL:
        out["pipeline"] = PIPELINE_SQL
    return out
