"""Sales metrics over the sales header: gross amount, revenue, customer
universe, purchase frequency, productive outlets, class-A SKU productivity,
and the business-line lists.

Every metric applies :func:`common_sales_filter` (date range, sellable business
lines, reason ``Sales``, minus primary sales of the excluded channel). The
lists take no date range and list every row of the header.
Choices where the source only documents the shape: a customer is counted
distinct, a purchase is a distinct document, an outlet is a customer, and a
purchase frequency is counted once per (outlet, month).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distkpi.operators.filters import common_sales_filter, in_filter
from distkpi.sources.tables import Tables

PURCHASE_BUCKETS = {4: "outlets_4_plus", 3: "outlets_3", 2: "outlets_2", 1: "outlets_1"}


def _distinct_count(c: str, approx: bool) -> Column:
    return F.approx_count_distinct(c) if approx else F.count_distinct(F.col(c))


def gross_summary(t: Tables, start, end, approx: bool = False) -> DataFrame:
    h = common_sales_filter(t.sales_header, start, end)
    return h.groupBy("data_flag").agg(
        F.sum("gross_amount").alias("gross_amount"),
        _distinct_count("customer_code", approx).alias("customer_count"))


def revenue_total(t: Tables, start, end) -> DataFrame:
    h = common_sales_filter(t.sales_header, start, end)
    return h.groupBy("data_flag").agg(F.sum("gross_amount").alias("gross_amount"))


def customer_universe(t: Tables, start, end, approx: bool = False) -> DataFrame:
    h = common_sales_filter(t.sales_header, start, end)
    return h.groupBy("data_flag").agg(_distinct_count("customer_code", approx).alias("customer_count"))


def purchases_per_outlet_month(t: Tables, start, end) -> DataFrame:
    """Distinct documents per (flag, outlet, month)."""
    h = common_sales_filter(t.sales_header, start, end)
    return h.groupBy("data_flag", "customer_code",
                     F.trunc("billing_date", "MM").alias("month")).agg(
        F.count_distinct(F.col("document_no")).alias("purchases"))


def _bucket_cond(n: int) -> Column:
    p = F.col("purchases")
    return p >= 4 if n == 4 else p == n


def purchase_frequency(t: Tables, start, end) -> DataFrame:
    """Per flag, (outlet, month) pairs with 4+, 3, 2 and 1 purchases."""
    per = purchases_per_outlet_month(t, start, end)
    return per.groupBy("data_flag").agg(
        *[F.count(F.when(_bucket_cond(n), 1)).alias(name) for n, name in PURCHASE_BUCKETS.items()])


def outlets_with_n_purchases(t: Tables, start, end, n: int) -> DataFrame:
    """Per flag, (outlet, month) pairs with exactly ``n`` purchases; ``n = 4`` means 4 or more."""
    if n not in PURCHASE_BUCKETS:
        raise ValueError(f"n must be one of {sorted(PURCHASE_BUCKETS)}, where 4 means 4 or more")
    per = purchases_per_outlet_month(t, start, end).where(_bucket_cond(n))
    return per.groupBy("data_flag").agg(F.count(F.lit(1)).alias("outlet_count"))


def productive_outlets(t: Tables, start, end, approx: bool = False) -> DataFrame:
    h = common_sales_filter(t.sales_header, start, end)
    return h.groupBy("data_flag").agg(_distinct_count("customer_code", approx).alias("outlet_count"))


def top_sku_class_a(t: Tables, start, end, classification="A") -> DataFrame:
    """Documents per (month, item, brand, category) for class-A items (or the
    classes given), busiest first within a month."""
    h = in_filter(common_sales_filter(t.sales_header, start, end), "classification",
                  classification or "A")
    r = h.groupBy(F.trunc("billing_date", "MM").alias("month_"), "item_description", "grp_brand",
                  "catg_theraptic").agg(F.count_distinct(F.col("document_no")).alias("doc_cnt"))
    return r.orderBy(F.desc("month_"), F.desc("doc_cnt"), F.asc_nulls_last("item_description"),
                     F.asc_nulls_last("grp_brand"), F.asc_nulls_last("catg_theraptic"))


#: The lists and their columns; the marts keep each as a small table.
LISTS = {"business_lines": ["business_line_id", "business_line_desc"],
         "products": ["business_line_id", "item_code", "item_description"],
         "locations": ["business_line_id", "branch_id", "branch_desc"],
         "regional_distributors": ["business_line_id", "distributor_code", "distributor_desc"]}


def header_list(t: Tables, name: str) -> DataFrame:
    """Distinct rows of a list: from its own table, else from the whole header."""
    if t.header_lists is not None:
        return t.header_lists[name]
    return t.sales_header.select(*LISTS[name]).distinct()


def business_lines(t: Tables) -> DataFrame:
    return header_list(t, "business_lines")


def _for_line(t: Tables, business_line: str, name: str) -> DataFrame:
    if not business_line:
        raise ValueError("a business line is required")
    rows = header_list(t, name).where(F.col("business_line_id") == business_line)
    return rows.select(*LISTS[name][1:])


def products(t: Tables, business_line: str) -> DataFrame:
    return _for_line(t, business_line, "products")


def locations(t: Tables, business_line: str) -> DataFrame:
    return _for_line(t, business_line, "locations")


def regional_distributors(t: Tables, business_line: str) -> DataFrame:
    return _for_line(t, business_line, "regional_distributors")
