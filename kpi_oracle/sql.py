"""DuckDB statements of every registered query, written from the report

Where the plans rewrite a construct, the SQL keeps the plain relational form,
so a mismatch points at the rewrite: the price picks are lateral top-1
subqueries (the plans use a ``min_by`` aggregate), month filters of some
reports are truncation equalities (the plans use ranges), snapshots are
scalar subqueries, pivots and conditional counts use ``FILTER`` clauses.
"""

from __future__ import annotations

from distkpi.constants import BRANCH_COLUMNS as BRANCHES
from distkpi.constants import (BUSINESS_LINES, COVER_CEILING, EXCLUDED_FLAG_CHANNEL,
                               NOT_AVAILABLE, OTHERS, QTY_BUCKETS, SALES_REASON, SELL_SUFFIX,
                               SNAP_EPSILON, SUBINVENTORY_EXTRA, SUBINVENTORY_PREFIX,
                               THRESHOLD_DAYS, TOTAL, UNKNOWN, VALUE_BUCKETS)
from distkpi.sources.testdata import derivation_sql

# The fixed values (distkpi.constants) rendered as SQL.
LINES = "(" + ", ".join(f"'{b}'" for b in BUSINESS_LINES) + ")"
LIMIT_DAYS = ("CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLD_DAYS.items())
              + " END")
BRANCH_COLUMNS = [(f"'{code}'", name) for code, name in BRANCHES.items()]
OTH = f"'{OTHERS}'"
EXTRA = ", ".join(f"'{c}'" for c in SUBINVENTORY_EXTRA)


# Building blocks ----------------------------------------------------------------

def derive(tables: list[str], body: str) -> str:
    """Put the logical-table derivations in front of ``body`` as CTEs."""
    defs = ",\n".join(f"{t} AS ({derivation_sql(t)})" for t in tables)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {defs},\n{body[5:]}"
    return f"WITH {defs}\n{body}"


def day(v) -> str:
    return f"DATE '{v}'"


def month_of(v) -> str:
    return f"date_trunc('month', {day(v)})"


def days_in(v) -> str:
    return f"day(last_day({day(v)}))"


def text_in(expr: str, values) -> str:
    """``AND expr-as-text IN (...)``, or nothing when no values are given."""
    if values in (None, "") or (isinstance(values, (list, tuple)) and not values):
        return ""
    items = [values] if isinstance(values, (str, int)) else list(values)
    quoted = ", ".join("'" + str(v).replace("'", "''") + "'" for v in items)
    return f"AND CAST({expr} AS VARCHAR) IN ({quoted})"


def short_code(col: str) -> str:
    """Leading zeros dropped through an integer, except codes starting with F."""
    return f"CASE WHEN {col} LIKE 'F%' THEN {col} ELSE CAST(CAST({col} AS INTEGER) AS VARCHAR) END"


def master_code(mapping: str, matnr: str) -> str:
    return f"CASE WHEN coalesce({mapping}, '') = '' THEN {matnr} ELSE {mapping} END"


def sellable(sub: str) -> str:
    return f"({sub} LIKE '{SUBINVENTORY_PREFIX}%' OR {sub} IN ({EXTRA}))"


def cover_expr(inv: str, trg: str, days: str, snap: bool = True) -> str:
    v = f"coalesce({inv}, 0)"
    if snap:
        v = f"(CASE WHEN abs({v}) < {SNAP_EPSILON} THEN 0 ELSE {v} END)"
    return exact_round(f"{v} * {days}", trg, 1)


def exact_round(num: str, den: str, digits: int) -> str:
    """num / den rounded half away from zero, in integers (the sums have at most 4 decimals)."""
    n = f"CAST(({num}) * 10000 AS HUGEINT)"
    d = f"nullif(CAST(({den}) * 10000 AS HUGEINT), 0)"
    unit = 10 ** digits
    return (f"(CAST((CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END) "
            f"* ((2 * {unit} * abs({n}) + abs({d})) // (2 * abs({d}))) AS DOUBLE) / {unit})")


def pct_both_nonzero(a: str, t: str, scale: str = " * 100") -> str:
    return f"CASE WHEN {a} <> 0 AND {t} <> 0 THEN {exact_round(a + scale, t, 2)} ELSE 0 END"


def price_pick(item: str, anchor: str) -> str:
    """Lateral top-1 price for ``item`` in the month of ``anchor``: own month
    with a non-zero price, else the previous month, else the own month's
    zero/NULL price; newest date first within a rank."""
    own = f"date_trunc('month', {anchor})"
    return f"""LEFT JOIN LATERAL (
    SELECT c.price FROM price_list c
    WHERE c.item_code = {item}
      AND c.first_date >= {own} - INTERVAL 1 MONTH AND c.first_date < {own} + INTERVAL 1 MONTH
    ORDER BY CASE WHEN c.first_date < {own} THEN 1
                  WHEN coalesce(c.price, 0) <> 0 THEN 0 ELSE 2 END,
             c.first_date DESC, c.price DESC NULLS LAST
    LIMIT 1) pick ON TRUE"""


def closing_stock_cte(s, e, classification, sku, branch) -> str:
    """Rows of the newest closing load, classified through the short item code."""
    return f"""closing AS (
  SELECT max(stock_closing_date) AS snap FROM stock
  WHERE stock_closing_date BETWEEN {day(s)} AND {day(e)} AND busline_code IN {LINES}),
on_hand AS (
  SELECT cv.classification AS cls, st.qty, st.qty * st.trade_price AS at_price,
         st.qty * st.item_cost AS at_cost
  FROM stock st
  LEFT JOIN items_class cv ON cv.mapping_code = {short_code('st.item_code')}
  LEFT JOIN locations lc ON CAST(lc.inv_sloc AS VARCHAR) = st.subinventory_code
  WHERE st.stock_closing_date = (SELECT snap FROM closing)
    AND st.busline_code IN {LINES} AND {sellable('st.subinventory_code')} AND st.qty <> 0
    {text_in('cv.classification', classification)} {text_in('cv.mapping_code', sku)}
    {text_in('lc.inv_sloc', branch)})"""


def month_targets_cte(e, classification, sku, branch) -> str:
    """Target rows of the month of ``e`` with the class of their item code."""
    return f"""month_targets AS (
  SELECT cv.classification AS cls, tg.target_value
  FROM targets tg
  LEFT JOIN items_class cv ON cv.mapping_code = tg.item_code
  WHERE tg.target_date >= {month_of(e)} AND tg.target_date < {month_of(e)} + INTERVAL 1 MONTH
    {text_in('cv.classification', classification)} {text_in('cv.mapping_code', sku)}
    {text_in('tg.loc_code', branch)})"""


def opening_stock_from(s, e) -> str:
    """FROM/WHERE of the newest opening load resolved through the item master."""
    return f"""FROM stock st
  LEFT JOIN items it ON it.matnr = st.item_code
  LEFT JOIN items_class cv ON cv.mapping_code = {master_code('it.mapping_code', 'it.matnr')}
  LEFT JOIN locations lc ON CAST(lc.inv_sloc AS VARCHAR) = st.subinventory_code
  WHERE st.stock_opening_date = (
          SELECT max(stock_opening_date) FROM stock
          WHERE stock_opening_date BETWEEN {day(s)} AND {day(e)} AND busline_code IN {LINES})
    AND st.busline_code IN {LINES} AND {sellable('st.subinventory_code')}"""


def branch_targets_cte(e, classification, sku, branch) -> str:
    """Month target per (branch, class of the item code, master code)."""
    code = master_code("it.mapping_code", "it.matnr")
    return f"""branch_targets AS (
  SELECT tg.loc_code AS branch, coalesce(cv.classification, {OTH}) AS cls, {code} AS code,
         sum(tg.target_value) AS trg
  FROM targets tg
  LEFT JOIN items_class cv ON cv.mapping_code = tg.item_code
  LEFT JOIN items it ON it.matnr = tg.item_code
  WHERE date_trunc('month', tg.target_date) = {month_of(e)}
    {text_in('cv.classification', classification)} {text_in('cv.mapping_code', sku)}
    {text_in('tg.loc_code', branch)}
  GROUP BY tg.loc_code, cv.classification, {code})"""


# Stock reports --------------------------------------------------------------------

def cover_days(s, e, classification=None, sku=None, branch=None) -> str:
    n = days_in(e)
    return derive(["stock", "items_class", "locations", "targets"], f"""
WITH {closing_stock_cte(s, e, classification, sku, branch)},
{month_targets_cte(e, classification, sku, branch)},
stock_side AS (
  SELECT coalesce(cls, {OTH}) AS label, sum(at_price) AS inv, sum(at_cost) AS inv_cost,
         sum(qty) AS units
  FROM on_hand GROUP BY cls),
target_side AS (
  SELECT coalesce(cls, {OTH}) AS label, sum(target_value) AS trg
  FROM month_targets GROUP BY coalesce(cls, {OTH}))
SELECT tg.label AS classification,
       CAST(st.inv AS DOUBLE) AS inv_val, CAST(st.inv_cost AS DOUBLE) AS inv_val_efp,
       CAST(tg.trg AS DOUBLE) AS trg_value, CAST(st.units AS DOUBLE) AS quantity,
       {exact_round('tg.trg', n, 1)} AS daily_target,
       {cover_expr('st.inv', 'tg.trg', n)} AS cover_days,
       {cover_expr('st.inv_cost', 'tg.trg', n)} AS cover_days_efp
FROM target_side tg LEFT JOIN stock_side st ON st.label = tg.label
ORDER BY tg.label""")


def stock_rows_nonzero(s, e) -> str:
    return derive(["stock", "items_class", "locations"], f"""
SELECT cv.classification, st.subinventory_code, count(*) AS n
FROM stock st
LEFT JOIN items_class cv ON cv.mapping_code = {short_code('st.item_code')}
LEFT JOIN locations lc ON CAST(lc.inv_sloc AS VARCHAR) = st.subinventory_code
WHERE st.stock_closing_date = (SELECT max(stock_closing_date) FROM stock
                               WHERE stock_closing_date BETWEEN {day(s)} AND {day(e)} AND busline_code IN {LINES})
  AND st.busline_code IN {LINES} AND {sellable('st.subinventory_code')} AND st.qty <> 0
GROUP BY ALL""")


def closing_inventory_date() -> str:
    return derive(["stock"], "SELECT max(stock_closing_date) AS closing_date FROM stock")


def cover_days_total(s, e, classification=None, sku=None, branch=None) -> str:
    n = days_in(e)
    return derive(["stock", "items_class", "locations", "targets"], f"""
WITH {closing_stock_cte(s, e, classification, sku, branch)},
{month_targets_cte(e, classification, sku, branch)},
stock_total AS (SELECT sum(at_price) AS inv, sum(at_cost) AS inv_cost, sum(qty) AS units FROM on_hand),
target_total AS (SELECT sum(target_value) AS trg FROM month_targets)
SELECT CAST(st.inv AS DOUBLE) AS inv_val, CAST(tg.trg AS DOUBLE) AS trg_value,
       CAST(st.units AS DOUBLE) AS quantity, CAST(st.inv_cost AS DOUBLE) AS inv_val_efp,
       {exact_round('tg.trg', n, 1)} AS daily_target,
       {cover_expr('st.inv', 'tg.trg', n)} AS cover_days,
       {cover_expr('st.inv_cost', 'tg.trg', n)} AS cover_days_efp
FROM stock_total st CROSS JOIN target_total tg""")


def target_vs_actual_cover(s, e, classification=None, sku=None, branch=None) -> str:
    n = days_in(e)
    return derive(["stock", "items_class", "locations", "targets"], f"""
WITH {closing_stock_cte(s, e, classification, sku, branch)},
{month_targets_cte(e, classification, sku, branch)},
stock_side AS (SELECT cls, sum(at_price) AS inv FROM on_hand GROUP BY cls),
target_side AS (SELECT cls, sum(target_value) AS trg FROM month_targets GROUP BY cls)
SELECT tg.cls AS classification, {LIMIT_DAYS.format(c='tg.cls')} AS cover_days_tgt,
       {cover_expr('st.inv', 'tg.trg', n)} AS cover_days
FROM target_side tg LEFT JOIN stock_side st ON st.cls = tg.cls
WHERE tg.cls IN ('A', 'B', 'C')
ORDER BY tg.cls""")


def inventory_days(s, e, classification=None, sku=None, branch=None) -> str:
    n = days_in(e)
    code = master_code("it.mapping_code", "it.matnr")
    pivot = ",\n       ".join(f"max(cover) FILTER (WHERE branch = {b}) AS {name}"
                              for b, name in BRANCH_COLUMNS)
    return derive(["stock", "items", "items_class", "locations", "targets"], f"""
WITH stock_side AS (
  SELECT lc.inv_sloc AS branch, coalesce(cv.classification, {OTH}) AS cls, {code} AS code,
         max(it.matnr_desc) AS label, sum(st.qty * st.trade_price) AS inv
  {opening_stock_from(s, e)}
    {text_in('cv.classification', classification)} {text_in('cv.mapping_code', sku)}
    {text_in('lc.inv_sloc', branch)}
  GROUP BY lc.inv_sloc, cv.classification, {code}),
{branch_targets_cte(e, classification, sku, branch)},
item_branch AS (
  SELECT sd.cls, sd.label, sd.branch, {cover_expr('sd.inv', 'bt.trg', n)} AS cover
  FROM stock_side sd
  LEFT JOIN branch_targets bt ON bt.branch = sd.branch AND bt.cls = sd.cls AND bt.code = sd.code)
SELECT coalesce(cls, {OTH}) AS classification, coalesce(label, '{UNKNOWN}') AS item_desc,
       {pivot},
       {exact_round('sum(CAST(cover AS DECIMAL(18,1)))', 'count(cover)', 1)} AS total
FROM item_branch
GROUP BY cls, label
ORDER BY cls, label""")


def above_below_threshold(s, e, sku=None, branch=None) -> str:
    n = days_in(e)
    code = master_code("it.mapping_code", "it.matnr")
    return derive(["stock", "items", "items_class", "locations", "targets"], f"""
WITH skus AS (
  SELECT DISTINCT mapping_code AS code, classification AS cls
  FROM items_class WHERE classification IN ('A', 'B', 'C')),
stock_by_code AS (
  SELECT {code} AS code, sum(st.qty * st.trade_price) AS inv
  {opening_stock_from(s, e)}
    {text_in('cv.mapping_code', sku)} {text_in('st.subinventory_code', branch)}
  GROUP BY {code}),
target_by_code AS (
  SELECT {code} AS code, sum(tg.target_value) AS trg
  FROM targets tg
  LEFT JOIN items it ON it.matnr = tg.item_code
  LEFT JOIN items_class cv ON cv.mapping_code = {code}
  WHERE date_trunc('month', tg.target_date) = {month_of(e)}
    {text_in('cv.mapping_code', sku)} {text_in('tg.loc_code', branch)}
  GROUP BY {code}),
scored AS (
  SELECT k.cls, {LIMIT_DAYS.format(c='k.cls')} AS limit_days,
         {cover_expr('sb.inv', 'coalesce(tb.trg, 0)', n, snap=False)} AS cover
  FROM skus k
  LEFT JOIN stock_by_code sb ON sb.code = k.code
  LEFT JOIN target_by_code tb ON tb.code = k.code)
SELECT cls AS classification,
       count(*) FILTER (WHERE cover > limit_days) AS skus_above,
       count(*) FILTER (WHERE cover <= limit_days) AS skus_below
FROM scored GROUP BY cls ORDER BY cls""")


def service_measure(s, e, classification=None, sku=None, branch=None) -> str:
    n = days_in(e)
    code = master_code("it.mapping_code", "it.matnr")
    whitelist = ", ".join(str(b) for b, _ in BRANCH_COLUMNS)
    # Half-up rounding of n_above / n_all * 100 to 2 decimals in integers.
    share = "CAST((n_above * 20000 + n_all) // nullif(2 * n_all, 0) AS DOUBLE) / 100"
    return derive(["stock", "items", "items_class", "locations", "targets"], f"""
WITH stock_side AS (
  SELECT lc.inv_sloc AS branch, coalesce(cv.classification, {OTH}) AS cls, {code} AS code,
         sum(st.qty * st.trade_price) AS inv
  {opening_stock_from(s, e)}
    {text_in('cv.classification', classification)} {text_in('cv.mapping_code', sku)}
    {text_in('lc.inv_sloc', branch)}
  GROUP BY lc.inv_sloc, cv.classification, lc.inv_sloc_desc, {code}),
{branch_targets_cte(e, classification, sku, branch)},
per_sku AS (
  SELECT bt.branch, replace(lc.inv_sloc_desc, '{SELL_SUFFIX}', '') AS branch_name, bt.cls, bt.code,
         coalesce({cover_expr('sd.inv', 'bt.trg', n)}, 0) AS cover
  FROM branch_targets bt
  LEFT JOIN stock_side sd ON sd.branch = bt.branch AND sd.cls = bt.cls AND sd.code = bt.code
  LEFT JOIN locations lc ON lc.inv_sloc = bt.branch),
shares AS (
  SELECT branch, branch_name, cls, count(DISTINCT code) AS n_all,
         count(DISTINCT code) FILTER (
           WHERE cover > {LIMIT_DAYS.format(c='cls')} AND cover < {COVER_CEILING}) AS n_above
  FROM per_sku GROUP BY branch, branch_name, cls)
SELECT branch_name AS branch,
       max({share}) FILTER (WHERE cls = 'A') AS sku_a_pct,
       max({share}) FILTER (WHERE cls = 'B') AS sku_b_pct,
       max({share}) FILTER (WHERE cls = 'C') AS sku_c_pct
FROM shares
WHERE branch IN ({whitelist})
GROUP BY branch, branch_name
ORDER BY branch_name""")


# Sales reports ----------------------------------------------------------------------

def sales_summary(s, e, classification=None, sku=None, branch=None) -> str:
    return derive(["sales"], f"""
WITH per_item AS (
  SELECT classification, item_code, sum(amount) AS net
  FROM sales
  WHERE billing_date BETWEEN {day(s)} AND {day(e)}
    AND classification IS NOT NULL AND branch_id IS NOT NULL AND item_code IS NOT NULL
    {text_in('classification', classification)} {text_in('item_code', sku)}
    {text_in('branch_id', branch)}
  GROUP BY classification, item_code)
SELECT classification, count(DISTINCT item_code) AS sku, CAST(sum(net) AS DOUBLE) AS amount
FROM per_item WHERE net <> 0
GROUP BY classification""")


def forecast_accuracy_monthly(s, e, classification=None, sku=None, branch=None) -> str:
    return derive(["sales", "targets"], f"""
WITH sold AS (
  SELECT sum(amount) AS v FROM sales
  WHERE billing_date BETWEEN {day(s)} AND {day(e)}
    AND classification IS NOT NULL AND branch_id IS NOT NULL AND item_code IS NOT NULL
    {text_in('classification', classification)} {text_in('item_code', sku)}
    {text_in('branch_id', branch)}),
planned AS (
  SELECT sum(target_value) AS v FROM targets
  WHERE target_date >= {month_of(e)} AND target_date < {month_of(e)} + INTERVAL 1 MONTH
    AND loc_code IS NOT NULL AND item_code IS NOT NULL
    {text_in('classification', classification)} {text_in('item_code', sku)}
    {text_in('loc_code', branch)}),
both_sides AS (
  SELECT coalesce(sold.v, 0) AS amount, coalesce(planned.v, 0) AS target_value
  FROM sold CROSS JOIN planned)
SELECT CAST(amount AS DOUBLE) AS amount, CAST(target_value AS DOUBLE) AS target_value,
       CAST(amount AS DOUBLE) / nullif(CAST(target_value AS DOUBLE), 0) AS pct
FROM both_sides""")


def target_to_date(s, e, classification=None, sku=None, branch=None) -> str:
    return derive(["targets"], f"""
SELECT CAST(0 AS DOUBLE) AS amount, CAST(sum(target_value) AS DOUBLE) AS target_value
FROM targets
WHERE target_date BETWEEN {day(s)} AND {day(e)}
  AND loc_code IS NOT NULL AND item_code IS NOT NULL
  {text_in('classification', classification)} {text_in('item_code', sku)}
  {text_in('loc_code', branch)}""")


def forecast_accuracy_yearly(s, e, classification=None, sku=None, branch=None) -> str:
    return derive(["sales", "price_list", "budget"], f"""
WITH valued AS (
  SELECT a.classification, sum(a.sold_qty * coalesce(pick.price, 0)) AS amount
  FROM sales a
  {price_pick('a.item_code', day(e))}
  WHERE a.billing_date BETWEEN {day(s)} AND {day(e)}
    {text_in('a.classification', classification)} {text_in('a.item_code', sku)}
    {text_in('a.branch_id', branch)}
  GROUP BY a.classification),
budgeted AS (
  SELECT sum(value) AS target_value FROM budget
  WHERE target_date BETWEEN {day(s)} AND {day(e)}
    {text_in('classification', classification)} {text_in('item_code', sku)}),
aligned AS (
  SELECT amount, 0 AS target_value FROM valued
  UNION ALL
  SELECT 0, target_value FROM budgeted)
SELECT CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(target_value) AS DOUBLE) AS target_value,
       {pct_both_nonzero('sum(amount)', 'sum(target_value)', '')} AS pct
FROM aligned""")


def forecast_accuracy_category_monthly(e, classification=None, sku=None, branch=None) -> str:
    lo, hi = f"{month_of(e)} - INTERVAL 2 MONTH", f"{day(e)} + INTERVAL 1 DAY"
    return derive(["sales", "targets"], f"""
WITH sold AS (
  SELECT coalesce(classification, {OTH}) AS cls, date_trunc('month', billing_date) AS m,
         sum(amount) AS amount
  FROM sales
  WHERE billing_date >= {lo} AND billing_date < {hi}
    {text_in('classification', classification)} {text_in('item_code', sku)}
    {text_in('branch_id', branch)}
  GROUP BY 1, 2),
planned AS (
  SELECT coalesce(classification, {OTH}) AS cls, date_trunc('month', target_date) AS m,
         sum(target_value) AS target_value
  FROM targets
  WHERE target_date >= {lo} AND target_date < {hi}
    AND loc_code IS NOT NULL AND item_code IS NOT NULL
    {text_in('classification', classification)} {text_in('item_code', sku)}
    {text_in('loc_code', branch)}
  GROUP BY 1, 2),
aligned AS (
  SELECT cls, m, amount, 0 AS target_value FROM sold
  UNION ALL
  SELECT cls, m, 0, target_value FROM planned)
SELECT cls AS classification,
       rpad(monthname(m), 9, ' ') || ' ' || CAST(year(m) AS VARCHAR) AS month,
       CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(target_value) AS DOUBLE) AS target_value,
       {pct_both_nonzero('sum(amount)', 'sum(target_value)')} AS pct
FROM aligned
GROUP BY cls, m
ORDER BY m DESC, cls""")


def forecast_accuracy_category_yearly(e, classification=None, sku=None, branch=None) -> str:
    lo, hi = f"{month_of(e)} - INTERVAL 2 MONTH", f"{month_of(e)} + INTERVAL 1 MONTH"
    return derive(["sales", "price_list", "budget"], f"""
WITH valued AS (
  SELECT coalesce(a.classification, {OTH}) AS cls, date_trunc('month', a.billing_date) AS m,
         sum(a.sold_qty * coalesce(pick.price, 0)) AS amount
  FROM sales a
  {price_pick('a.item_code', 'a.billing_date')}
  WHERE a.billing_date >= {lo} AND a.billing_date < {hi}
    {text_in('a.classification', classification)} {text_in('a.item_code', sku)}
    {text_in('a.branch_id', branch)}
  GROUP BY 1, 2),
budgeted AS (
  SELECT coalesce(classification, {OTH}) AS cls, date_trunc('month', target_date) AS m,
         sum(value) AS target_value
  FROM budget
  WHERE target_date >= {lo} AND target_date < {hi}
    {text_in('classification', classification)} {text_in('item_code', sku)}
  GROUP BY 1, 2),
aligned AS (
  SELECT cls, m, amount, 0 AS target_value FROM valued
  UNION ALL
  SELECT cls, m, 0, target_value FROM budgeted)
SELECT cls AS classification, strftime(m, '%B %Y') AS month,
       CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(target_value) AS DOUBLE) AS target_value,
       {pct_both_nonzero('sum(amount)', 'sum(target_value)')} AS pct
FROM aligned
GROUP BY cls, m
ORDER BY m DESC, cls""")


def distributor_vs_company_target(e, classification=None, sku=None, branch=None) -> str:
    return derive(["targets", "budget"], f"""
WITH dist AS (
  SELECT coalesce(classification, {OTH}) AS cls, sum(target_value) AS v
  FROM targets
  WHERE date_trunc('month', target_date) = {month_of(e)}
    AND loc_code IS NOT NULL AND item_code IS NOT NULL
    {text_in('classification', classification)} {text_in('item_code', sku)}
    {text_in('loc_code', branch)}
  GROUP BY 1),
comp AS (
  SELECT coalesce(classification, {OTH}) AS cls, sum(value) AS v
  FROM budget
  WHERE date_trunc('month', target_date) = {month_of(e)} AND item_code IS NOT NULL
    {text_in('classification', classification)} {text_in('item_code', sku)}
  GROUP BY 1),
lined AS (
  SELECT coalesce(dist.cls, comp.cls) AS cls, coalesce(dist.v, 0) AS dv, coalesce(comp.v, 0) AS cv
  FROM dist FULL OUTER JOIN comp ON dist.cls = comp.cls),
with_total AS (
  SELECT cls, dv, cv FROM lined
  UNION ALL
  SELECT '{TOTAL}', sum(dv), sum(cv) FROM lined)
SELECT cls AS classification, CAST(dv AS DOUBLE) AS distributor_target,
       CAST(cv AS DOUBLE) AS company_target,
       CASE WHEN cv <> 0 THEN {exact_round('dv * 100', 'cv', 2)} ELSE 0 END
         AS distributor_vs_company_pct
FROM with_total""")


# Supply reports ---------------------------------------------------------------------

def dispatch_vs_order(s, e, classification=None, sku=None) -> str:
    return derive(["dispatch", "items_class"], f"""
SELECT d.material_name, d.channel_type,
       CAST(sum(d.so_quantity) AS DOUBLE) AS total_order_qty,
       CAST(sum(d.deliverd_qty) AS DOUBLE) AS total_delivery_qty,
       {exact_round('sum(d.deliverd_qty) * 100', 'sum(d.so_quantity)', 2)} AS delivery_pct
FROM dispatch d
LEFT JOIN items_class cv ON cv.mapping_code = d.material_no
WHERE d.actual_gm_date BETWEEN {day(s)} AND {day(e)}
  {text_in('cv.classification', classification)} {text_in('cv.mapping_code', sku)}
GROUP BY d.material_name, d.channel_type""")


def wip(s, e) -> str:
    return derive(["wip", "items_class"], f"""
WITH last_load AS (
  SELECT max(record_created_date) AS ts FROM wip
  WHERE CAST(record_created_date AS DATE) BETWEEN {day(s)} AND {day(e)})
SELECT w.storage_loc, w.storage_loc_desc, w.plant, w.plnt_desc, w.material_type_description,
       w.type_description AS material_name, w.order_number,
       CAST(w.item_qty AS DOUBLE) AS item_qty, CAST(w.good_received_qty AS DOUBLE) AS good_received_qty,
       CAST(sum(w.wip_value) AS DOUBLE) AS wip_value, CAST(sum(w.wip) AS DOUBLE) AS quantity
FROM wip w
LEFT JOIN items_class cv ON cv.mapping_code = w.item_code
WHERE w.record_created_date = (SELECT ts FROM last_load)
GROUP BY w.storage_loc, w.storage_loc_desc, w.plant, w.plnt_desc, w.material_type_description,
         w.type_description, w.order_number, w.item_qty, w.good_received_qty""")


def stock_valuation(s, e) -> str:
    sums = [f"CAST(sum(v.{src}) AS DOUBLE) AS {out}" for src, out in VALUE_BUCKETS]
    sums.append("CAST(sum(" + " + ".join(f"v.{src}" for src, _ in VALUE_BUCKETS) + ") AS DOUBLE) AS total_val")
    sums += [f"CAST(sum(v.{src}) AS DOUBLE) AS {out}" for src, out, _ in QTY_BUCKETS]
    sums.append("CAST(sum(" + " + ".join(f"v.{src}" for src, _, keep in QTY_BUCKETS if keep)
                + ") AS DOUBLE) AS total_qty")
    body = ",\n       ".join(sums)
    return derive(["valuation"], f"""
SELECT v.materialname, v.producttype, v.plant, v.storagelocation,
       coalesce(v.storagelocationname, '{NOT_AVAILABLE}') AS storagelocationname, v.plantname,
       {body}
FROM valuation v
WHERE v.executiondate = (SELECT max(executiondate) FROM valuation
                         WHERE executiondate BETWEEN {day(s)} AND {day(e)})
GROUP BY v.materialname, v.producttype, v.plant, v.storagelocation,
         coalesce(v.storagelocationname, '{NOT_AVAILABLE}'), v.plantname""")


# Lists ------------------------------------------------------------------------------

def item_filter_list() -> str:
    return derive(["target_items", "items"], f"""
SELECT DISTINCT ti.material_code AS item_code, it.matnr_desc AS item_description,
       coalesce(it.classif, {OTH}) AS classification
FROM target_items ti LEFT JOIN items it ON it.matnr = ti.material_code""")


def branch_list() -> str:
    return derive(["branches"], "SELECT branch_id, branch_desc FROM branches")


def sku_count_by_class() -> str:
    return derive(["product_map"],
                  'SELECT classification, count(*) AS "count" FROM product_map GROUP BY classification')


def list_tables() -> str:
    names = ["sales", "targets", "budget", "stock", "items", "items_class", "locations", "price_list", "wip",
             "valuation", "dispatch", "target_items", "product_map", "branches", "sales_header"]
    return derive(names, " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in names))


def table_page(table: str, order_by: list[str], limit: int, offset: int) -> str:
    keys = ", ".join(f"{k} ASC NULLS LAST" for k in order_by)
    return derive([table], f"SELECT * FROM {table} ORDER BY {keys} LIMIT {limit} OFFSET {offset}")


def table_page_after(table: str, key: str, value: str, limit: int) -> str:
    return derive([table], f"SELECT * FROM {table} WHERE {key} > '{value}' ORDER BY {key} LIMIT {limit}")


# Documented sales metrics -------------------------------------------------------------

def metric_rows(s, e) -> str:
    return (f"billing_date BETWEEN {day(s)} AND {day(e)} AND business_line_id IN {LINES} "
            f"AND reason_code = '{SALES_REASON}' "
            f"AND NOT (data_flag = '{EXCLUDED_FLAG_CHANNEL[0]}' AND channel = '{EXCLUDED_FLAG_CHANNEL[1]}')")


def gross_summary(s, e) -> str:
    return derive(["sales_header"], f"""
SELECT data_flag, CAST(sum(gross_amount) AS DOUBLE) AS gross_amount,
       count(DISTINCT customer_code) AS customer_count
FROM sales_header WHERE {metric_rows(s, e)} GROUP BY data_flag""")


def revenue_total(s, e) -> str:
    return derive(["sales_header"], f"""
SELECT data_flag, CAST(sum(gross_amount) AS DOUBLE) AS gross_amount
FROM sales_header WHERE {metric_rows(s, e)} GROUP BY data_flag""")


def customer_universe(s, e) -> str:
    return derive(["sales_header"], f"""
SELECT data_flag, count(DISTINCT customer_code) AS customer_count
FROM sales_header WHERE {metric_rows(s, e)} GROUP BY data_flag""")


def productive_outlets(s, e) -> str:
    return derive(["sales_header"], f"""
SELECT data_flag, count(DISTINCT customer_code) AS outlet_count
FROM sales_header WHERE {metric_rows(s, e)} GROUP BY data_flag""")


def outlet_months(s, e) -> str:
    return f"""outlet_months AS (
  SELECT data_flag, customer_code, date_trunc('month', billing_date) AS m,
         count(DISTINCT document_no) AS purchases
  FROM sales_header WHERE {metric_rows(s, e)}
  GROUP BY data_flag, customer_code, date_trunc('month', billing_date))"""


def purchase_frequency(s, e) -> str:
    return derive(["sales_header"], f"""
WITH {outlet_months(s, e)}
SELECT data_flag,
       count(*) FILTER (WHERE purchases >= 4) AS outlets_4_plus,
       count(*) FILTER (WHERE purchases = 3) AS outlets_3,
       count(*) FILTER (WHERE purchases = 2) AS outlets_2,
       count(*) FILTER (WHERE purchases = 1) AS outlets_1
FROM outlet_months GROUP BY data_flag""")


def outlets_with_n_purchases(s, e, n: int) -> str:
    cond = "purchases >= 4" if n >= 4 else f"purchases = {n}"
    return derive(["sales_header"], f"""
WITH {outlet_months(s, e)}
SELECT data_flag, count(*) AS outlet_count FROM outlet_months WHERE {cond} GROUP BY data_flag""")


def top_sku_class_a(s, e) -> str:
    return derive(["sales_header"], f"""
SELECT CAST(date_trunc('month', billing_date) AS DATE) AS month_, item_description, grp_brand,
       catg_theraptic, count(DISTINCT document_no) AS doc_cnt
FROM sales_header WHERE {metric_rows(s, e)} AND classification = 'A'
GROUP BY ALL
ORDER BY month_ DESC, doc_cnt DESC, item_description, grp_brand, catg_theraptic""")


def business_lines() -> str:
    return derive(["sales_header"],
                  "SELECT DISTINCT business_line_id, business_line_desc FROM sales_header")


def _line_list(bl: str, cols: str) -> str:
    return derive(["sales_header"],
                  f"SELECT DISTINCT {cols} FROM sales_header WHERE business_line_id = '{bl}'")


def products(bl: str) -> str:
    return _line_list(bl, "item_code, item_description")


def locations(bl: str) -> str:
    return _line_list(bl, "branch_id, branch_desc")


def regional_distributors(bl: str) -> str:
    return _line_list(bl, "distributor_code, distributor_desc")


# Operator-level queries ------------------------------------------------------------------

def operator_sql(s, e, ds, de, filters) -> dict[str, str]:
    c, b = filters["classification"], filters["branch"]
    closing = f"""(SELECT max(stock_closing_date) FROM stock
                   WHERE stock_closing_date BETWEEN {day(s)} AND {day(e)} AND busline_code IN {LINES})"""
    return {
        "filter_optional_in": derive(["sales"], f"""
SELECT classification, branch_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
FROM sales WHERE TRUE {text_in('classification', c)} {text_in('branch_id', b)}
GROUP BY classification, branch_id"""),
        "filter_lookback": derive(["sales"], f"""
SELECT CAST(date_trunc('month', billing_date) AS DATE) AS month, count(*) AS n,
       CAST(sum(amount) AS DOUBLE) AS amount
FROM sales
WHERE billing_date >= {month_of(e)} - INTERVAL 2 MONTH AND billing_date <= {day(e)}
GROUP BY 1"""),
        "latest_snapshot": derive(["stock"], f"""
SELECT item_code, subinventory_code, busline_code, CAST(qty AS DOUBLE) AS qty,
       CAST(trade_price AS DOUBLE) AS trade_price, CAST(item_cost AS DOUBLE) AS item_cost,
       stock_opening_date, stock_closing_date
FROM stock WHERE stock_closing_date = {closing}"""),
        "item_code_normalized": derive(["stock"], f"""
SELECT DISTINCT item_code, {short_code('item_code')} AS normalized_code FROM stock"""),
        "mapping_code_resolved": derive(["items"], f"""
SELECT matnr, {master_code('mapping_code', 'matnr')} AS mapping_code FROM items"""),
        "classified": derive(["stock", "items_class"], f"""
SELECT cv.classification, count(*) AS n, CAST(sum(st.qty) AS DOUBLE) AS qty
FROM stock st LEFT JOIN items_class cv ON cv.mapping_code = {short_code('st.item_code')}
GROUP BY cv.classification"""),
        "stock_value_by_class": derive(["stock", "items_class", "locations"], f"""
WITH {closing_stock_cte(s, e, None, None, None)}
SELECT cls AS classification, CAST(sum(at_price) AS DOUBLE) AS inv_val,
       CAST(sum(at_cost) AS DOUBLE) AS inv_val_efp, CAST(sum(qty) AS DOUBLE) AS quantity
FROM on_hand GROUP BY cls"""),
        "target_value_by_class": derive(["targets", "items_class"], f"""
WITH {month_targets_cte(e, None, None, None)}
SELECT coalesce(cls, {OTH}) AS classification, CAST(sum(target_value) AS DOUBLE) AS trg_value
FROM month_targets GROUP BY 1"""),
        "price_fixed_month": derive(["price_list"], f"""
SELECT a.item_code, CAST(pick.price AS DOUBLE) AS price
FROM (SELECT DISTINCT item_code FROM price_list
      WHERE first_date >= {month_of(e)} - INTERVAL 1 MONTH
        AND first_date < {month_of(e)} + INTERVAL 1 MONTH) a
{price_pick('a.item_code', day(e))}"""),
        "price_asof_month": derive(["price_list"], f"""
WITH months AS (
  SELECT DISTINCT item_code, CAST(date_trunc('month', first_date) AS DATE) AS month FROM price_list
  UNION
  SELECT DISTINCT item_code, CAST(date_trunc('month', first_date) + INTERVAL 1 MONTH AS DATE)
  FROM price_list)
SELECT a.item_code, a.month, CAST(pick.price AS DOUBLE) AS price
FROM months a
{price_pick('a.item_code', 'a.month')}"""),
        "common_filter": derive(["sales_header"], f"""
SELECT data_flag, channel, count(*) AS n, CAST(sum(gross_amount) AS DOUBLE) AS gross_amount
FROM sales_header WHERE {metric_rows(ds, de)} GROUP BY data_flag, channel"""),
    }
