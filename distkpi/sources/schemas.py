"""Explicit schemas of the logical tables (no inference at load time).

Measures are decimals so that sums are exact and independent of the order in
which partitions are combined; reports return them as decimals. Business keys
(branch, location, customer, item) are text, as the reports compare them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from distkpi.constants import QTY_BUCKETS, VALUATION_KEYS, VALUE_BUCKETS  # noqa: F401

S, I, L = T.StringType(), T.IntegerType(), T.LongType()
D, TS = T.DateType(), T.TimestampNTZType()
Q = T.DecimalType(12, 2)      # quantities and unit prices
V = T.DecimalType(18, 4)      # values / amounts


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "sales": _schema(("item_code", S), ("classification", S), ("branch_id", S),
                     ("billing_date", D), ("sold_qty", Q), ("amount", V)),
    "targets": _schema(("item_code", S), ("loc_code", S), ("classification", S),
                       ("target_date", D), ("target_value", V)),
    "budget": _schema(("item_code", S), ("classification", S), ("target_date", D),
                      ("value", V)),
    "stock": _schema(("item_code", S), ("subinventory_code", S), ("busline_code", S),
                     ("qty", T.DecimalType(18, 2)), ("trade_price", Q), ("item_cost", Q),
                     ("stock_opening_date", D), ("stock_closing_date", D)),
    "items": _schema(("matnr", S), ("matnr_desc", S), ("mapping_code", S), ("classif", S)),
    "items_class": _schema(("mapping_code", S), ("classification", S)),
    "locations": _schema(("inv_sloc", S), ("inv_sloc_desc", S)),
    "price_list": _schema(("item_code", S), ("first_date", D), ("price", Q)),
    "wip": _schema(("storage_loc", I), ("storage_loc_desc", S), ("plant", I),
                   ("plnt_desc", S), ("material_type_description", S),
                   ("type_description", S), ("order_number", L), ("item_qty", Q),
                   ("good_received_qty", Q), ("wip_value", V), ("wip", Q),
                   ("item_code", S), ("record_created_date", TS)),
    "valuation": _schema(("materialname", S), ("producttype", S), ("plant", I),
                         ("storagelocation", I), ("storagelocationname", S),
                         ("plantname", S), ("executiondate", D),
                         *[(c, V) for c, _ in VALUE_BUCKETS],
                         *[(c, Q) for c, _, _ in QTY_BUCKETS]),
    "dispatch": _schema(("material_name", S), ("material_no", S), ("channel_type", S),
                        ("so_quantity", Q), ("deliverd_qty", Q), ("actual_gm_date", D)),
    "target_items": _schema(("material_code", S)),
    "product_map": _schema(("classification", S)),
    "branches": _schema(("branch_id", S), ("branch_desc", S)),
    "sales_header": _schema(("data_flag", S), ("channel", S), ("business_line_id", S),
                            ("business_line_desc", S), ("reason_code", S),
                            ("customer_code", S), ("branch_id", S), ("branch_desc", S),
                            ("distributor_code", S), ("distributor_desc", S),
                            ("document_no", L), ("billing_date", D), ("item_code", S),
                            ("item_description", S), ("grp_brand", S),
                            ("catg_theraptic", S), ("classification", S),
                            ("gross_amount", V)),
}

TABLE_NAMES = list(SCHEMAS)


def check_schema(name: str, df: DataFrame) -> DataFrame:
    """Fail fast when a table does not have the expected column names and types."""
    want = [(f.name, f.dataType) for f in SCHEMAS[name].fields]
    got = [(f.name, f.dataType) for f in df.schema.fields]
    if want != got:
        raise ValueError(f"table {name!r}: expected {want}, got {got}")
    return df
