"""Logical tables derived from the generated TPC-H-like test data.

The reports run on a distribution star schema (sales, targets, budget, stock,
item master, ...). The test data ships TPC-H tables instead, so each logical
table is derived from them by one SQL statement. The very same statement text
is used by Spark (here) and by the DuckDB oracle (``kpi_oracle/``), so both engines
see identical inputs and a mismatch can only come from the report logic.

Placeholders ``{lineitem}``, ``{part}`` ... name the raw tables; Spark binds
them to DataFrames through ``spark.sql(text, **frames)``, the oracle to its
pre-registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from distkpi.sources.schemas import QTY_BUCKETS, VALUE_BUCKETS, check_schema
from distkpi.sources.tables import Tables

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Shorthands of the derivation (fixed values of the test-data mapping).
# Master and stock use RAW, the class view and the facts CODE. They differ for
# a third of the items, whose master code has leading zeros: a target of these
# has no direct match in the master. F codes are 12 characters long.
LONG = "concat('F', lpad(CAST(p_partkey AS STRING), 11, '0'))"
PLAIN = "CAST(1013000000 + p_partkey AS STRING)"
RAW = (f"CASE WHEN p_partkey % 17 = 0 THEN {LONG} WHEN p_partkey % 3 = 0 "
       f"THEN lpad(CAST(p_partkey AS STRING), 10, '0') ELSE {PLAIN} END")
CODE = (f"CASE WHEN p_partkey % 17 = 0 THEN {LONG} WHEN p_partkey % 3 = 0 "
        f"THEN CAST(p_partkey AS STRING) ELSE {PLAIN} END")
CLS = ("CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'A' WHEN p_type = 'MEDIUM' THEN 'B' "
       "WHEN p_type = 'LARGE' THEN 'C' END")
BL = ("CASE p_size % 4 WHEN 0 THEN 'P07' WHEN 1 THEN 'P08' WHEN 2 THEN 'P12' "
      "ELSE 'P99' END")
MONTH = "CAST(date_trunc('month', l_shipdate) AS DATE)"
QTY = "CAST(l_quantity AS DECIMAL(12,2))"
EXT = "CAST(l_extendedprice AS DECIMAL(14,2))"
PRICE = "CAST(p_retailprice AS DECIMAL(12,2))"
LP = "{lineitem} JOIN {part} ON p_partkey = l_partkey"


def _valuation_sql() -> str:
    slot = "(l_linenumber + l_suppkey) % 10"
    cols = []
    for i, (name, _) in enumerate(VALUE_BUCKETS):
        cols.append(f"CAST(CASE WHEN {slot} = {i} THEN {EXT} WHEN l_partkey % 97 = {i} "
                    f"THEN NULL ELSE 0 END AS DECIMAL(18,4)) AS {name}")
    for i, (name, _, _) in enumerate(QTY_BUCKETS):
        cols.append(f"CAST(CASE WHEN {slot} = {i} THEN {QTY} WHEN l_partkey % 97 = {i} "
                    f"THEN NULL ELSE 0 END AS DECIMAL(12,2)) AS {name}")
    return f"""
SELECT p_name AS materialname, p_type AS producttype,
       CAST(l_suppkey % 5 AS INT) AS plant,
       CAST(8000 + l_suppkey AS INT) AS storagelocation,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL
            ELSE concat('SL-', CAST(l_suppkey AS STRING)) END AS storagelocationname,
       concat('PLANT-', CAST(l_suppkey % 5 AS STRING)) AS plantname,
       last_day(CAST(l_shipdate AS DATE)) AS executiondate,
       {", ".join(cols)}
FROM {LP}"""


DERIVATIONS: dict[str, str] = {
    "items": f"""
SELECT {RAW} AS matnr, p_name AS matnr_desc,
       CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN NULL
            ELSE {CODE} END AS mapping_code,
       {CLS} AS classif
FROM {{part}}""",
    # With a literal 'Others' class and with duplicated mapping codes.
    "items_class": f"""
SELECT {CODE} AS mapping_code,
       CASE WHEN p_partkey % 41 = 0 THEN 'Others' ELSE {CLS} END AS classification
FROM {{part}} WHERE p_type <> 'PROMO'
UNION ALL
SELECT {CODE} AS mapping_code, {CLS} AS classification
FROM {{part}} WHERE p_type <> 'PROMO' AND p_partkey % 53 = 0""",
    "locations": """
SELECT CAST(8000 + s_suppkey AS STRING) AS inv_sloc, concat(s_name, ' SELL') AS inv_sloc_desc
FROM {supplier}""",
    "sales": f"""
SELECT {CODE} AS item_code, {CLS} AS classification,
       CAST(8000 + l_suppkey AS STRING) AS branch_id,
       CAST(l_shipdate AS DATE) AS billing_date,
       {QTY} AS sold_qty,
       -- Items that net to 0 in every window.
       CAST(CASE WHEN p_partkey % 37 = 0 THEN 0
                 ELSE {EXT} * (1 - CAST(l_discount AS DECIMAL(4,2))) END AS DECIMAL(18,4)) AS amount
FROM {LP}""",
    "targets": f"""
SELECT {CODE} AS item_code, CAST(8000 + l_suppkey AS STRING) AS loc_code,
       {CLS} AS classification, {MONTH} AS target_date,
       CAST(sum({QTY} * {PRICE}) AS DECIMAL(18,4)) AS target_value
FROM {LP}
GROUP BY p_partkey, p_type, l_suppkey, {MONTH}""",
    "budget": f"""
SELECT {CODE} AS item_code, {CLS} AS classification, {MONTH} AS target_date,
       CAST(sum({EXT}) AS DECIMAL(18,4)) AS value
FROM {LP}
GROUP BY p_partkey, p_type, {MONTH}""",
    "stock": f"""
SELECT {RAW} AS item_code,
       -- The two extra sub-inventories and one that does not count.
       CASE l_suppkey % 20 WHEN 7 THEN '8206' WHEN 13 THEN '8210'
            WHEN 19 THEN concat('99', CAST(l_suppkey AS STRING))
            ELSE CAST(8000 + l_suppkey AS STRING) END AS subinventory_code,
       {BL} AS busline_code,
       CAST(CASE WHEN (p_partkey + l_suppkey) % 13 = 0 THEN 0 ELSE
            sum(CASE WHEN l_returnflag = 'R' THEN -{QTY} ELSE {QTY} END) END AS DECIMAL(18,2)) AS qty,
       {PRICE} AS trade_price,
       CAST({PRICE} * 0.8 AS DECIMAL(12,2)) AS item_cost,
       {MONTH} AS stock_opening_date,
       last_day({MONTH}) AS stock_closing_date
FROM {LP}
GROUP BY p_partkey, p_size, p_retailprice, l_suppkey, {MONTH}""",
    "price_list": f"""
WITH pm AS (
  SELECT DISTINCT l_partkey, {MONTH} AS m FROM {{lineitem}}),
pp AS (
  SELECT p_partkey, p_retailprice, m, p_partkey + month(m) AS k
  FROM pm JOIN {{part}} ON p_partkey = l_partkey)
SELECT {CODE} AS item_code, m AS first_date,
       CAST(CASE WHEN k % 5 = 0 THEN 0 WHEN k % 7 = 0 THEN NULL
                 ELSE {PRICE} + month(m) END AS DECIMAL(12,2)) AS price
FROM pp WHERE k % 3 <> 0
UNION ALL
SELECT {CODE} AS item_code, last_day(m) AS first_date,
       CAST({PRICE} + 100 + month(m) AS DECIMAL(12,2)) AS price
FROM pp WHERE k % 4 = 1
UNION ALL
-- A second price on one date.
SELECT {CODE} AS item_code, m AS first_date, CAST({PRICE} + 7 AS DECIMAL(12,2)) AS price
FROM pp WHERE k % 3 <> 0 AND k % 2 = 0""",
    "wip": f"""
SELECT CAST(8000 + l_suppkey AS INT) AS storage_loc,
       concat('SL-', CAST(l_suppkey AS STRING)) AS storage_loc_desc,
       CAST(l_suppkey % 5 AS INT) AS plant,
       concat('PLANT-', CAST(l_suppkey % 5 AS STRING)) AS plnt_desc,
       p_type AS material_type_description, p_name AS type_description,
       CAST(l_orderkey AS BIGINT) AS order_number, {QTY} AS item_qty,
       CAST(CASE WHEN l_linestatus = 'F' THEN {QTY} ELSE 0 END AS DECIMAL(12,2)) AS good_received_qty,
       CAST({EXT} AS DECIMAL(18,4)) AS wip_value, {QTY} AS wip,
       {CODE} AS item_code, l_shipdate AS record_created_date
FROM {LP} WHERE l_returnflag = 'N'""",
    "valuation": _valuation_sql(),
    "dispatch": f"""
SELECT p_name AS material_name, {CODE} AS material_no, o_orderpriority AS channel_type,
       {QTY} AS so_quantity,
       CAST(CASE WHEN l_linestatus = 'F' THEN {QTY} ELSE 0 END AS DECIMAL(12,2)) AS deliverd_qty,
       CAST(l_shipdate AS DATE) AS actual_gm_date
FROM {LP} JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "target_items": f"SELECT {RAW} AS material_code FROM {{part}}",
    "product_map": f"SELECT {CLS} AS classification FROM {{part}}",
    "branches": """
SELECT CAST(8000 + s_suppkey AS STRING) AS branch_id, s_name AS branch_desc FROM {supplier}""",
    "sales_header": f"""
SELECT CASE WHEN l_linestatus = 'F' THEN 'Primary Sales' ELSE 'Secondary Sales' END AS data_flag,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'Distributor - A'
            WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS channel,
       {BL} AS business_line_id, concat('Line ', {BL}) AS business_line_desc,
       CASE WHEN l_returnflag = 'R' THEN 'Return' ELSE 'Sales' END AS reason_code,
       -- Coarse enough that some outlets buy four times in a month.
       CAST(o_custkey % 200 AS STRING) AS customer_code,
       CAST(8000 + l_suppkey AS STRING) AS branch_id, s_name AS branch_desc,
       concat('D', lpad(CAST(s_nationkey AS STRING), 3, '0')) AS distributor_code,
       n_name AS distributor_desc,
       CAST(l_orderkey AS BIGINT) AS document_no,
       CAST(l_shipdate AS DATE) AS billing_date,
       {CODE} AS item_code, p_name AS item_description, p_brand AS grp_brand,
       p_type AS catg_theraptic, {CLS} AS classification,
       CAST({EXT} AS DECIMAL(18,4)) AS gross_amount
FROM {LP}
JOIN {{orders}} ON o_orderkey = l_orderkey
JOIN {{customer}} ON c_custkey = o_custkey
JOIN {{supplier}} ON s_suppkey = l_suppkey
JOIN {{nation}} ON n_nationkey = s_nationkey""",
}


def derivation_sql(name: str, table_ref=lambda t: t) -> str:
    """Derivation text of one logical table with raw table names substituted."""
    return DERIVATIONS[name].format(**{t: table_ref(t) for t in RAW_TABLES})


def read_raw(spark: SparkSession, sf_dir) -> dict[str, DataFrame]:
    base = str(sf_dir).rstrip("/")
    return {t: spark.read.parquet(f"{base}/{t}.parquet") for t in RAW_TABLES}


def derive(spark: SparkSession, name: str, raw: dict[str, DataFrame]) -> DataFrame:
    """One logical table as a lazy DataFrame over the raw test tables."""
    used = {t: df for t, df in raw.items() if "{" + t + "}" in DERIVATIONS[name]}
    return check_schema(name, spark.sql(DERIVATIONS[name], **used))


def load_tables(spark: SparkSession, sf_dir) -> Tables:
    """All logical tables, lazily derived from ``sf_dir`` (nothing is computed here)."""
    raw = read_raw(spark, sf_dir)
    return Tables(**{name: derive(spark, name, raw) for name in DERIVATIONS})
