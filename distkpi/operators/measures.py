"""Reusable measure blocks: stock and target values, actual-vs-target
alignment, pivots, threshold counts and total rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distkpi.functions.columns import normalize_item_code
from distkpi.constants import BUSINESS_LINES
from distkpi.operators.filters import (in_month, in_values, as_values,
                                       sellable_stock)
from distkpi.operators.lookup import (CLS_CLASS, CLS_CODE, ITM_MAPPING, LOC_CODE, with_class,
                                      with_item, with_item_class, with_location)
from distkpi.operators.snapshot import latest_opening_load, latest_snapshot, load_dates
from distkpi.sources.tables import Tables


def optional_in(df: DataFrame, column: str, values) -> DataFrame:
    """Filter on an already joined column (no-op without values)."""
    vals = as_values(values)
    if vals is None:
        return df
    return df.where(in_values(F.col(column), df.schema[column].dataType, vals))


def sellable_snapshot(t: Tables, by: str, start, end,
                      buslines: Iterable[str] = BUSINESS_LINES) -> DataFrame:
    """Sellable stock rows of the newest load (of those lines) inside ``[start, end]``,
    ``by`` its ``'closing'`` or ``'opening'`` date."""
    buslines = list(buslines)
    lines = F.col("busline_code").isin(buslines)
    if by == "opening":
        snap = latest_opening_load(t, start, end, lines)
    else:
        snap = latest_snapshot(t.stock, "stock_closing_date", start, end, lines, dates=load_dates(t, "stock"))
    return sellable_stock(snap, buslines)


def classified_stock(t: Tables, start, end, classification=None, sku=None, branch=None,
                     nonzero: bool = True) -> DataFrame:
    """Closing-date stock classified through the normalised item code.

    Rows of the newest closing load, sellable, joined to the class view on the
    normalised code and to the locations; class/sku filter the *view's*
    columns, branch the location code; optionally ``qty <> 0``.
    """
    s = sellable_snapshot(t, "closing", start, end)
    s = with_class(s, t.items_class, normalize_item_code(F.col("item_code")))
    s = with_location(s, t.locations, F.col("subinventory_code"))
    s = optional_in(s, CLS_CLASS, classification)
    s = optional_in(s, CLS_CODE, sku)
    s = optional_in(s, LOC_CODE, branch)
    if nonzero:
        s = s.where(F.col("qty") != 0)
    return s


def stock_value(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Inventory value at trade price and at cost, and quantity, per ``by``."""
    return rows.groupBy(*by).agg(
        F.sum(F.col("qty") * F.col("trade_price")).alias("inv_val"),
        F.sum(F.col("qty") * F.col("item_cost")).alias("inv_val_efp"),
        F.sum("qty").alias("quantity"))


def classified_targets(t: Tables, end, classification=None, sku=None, branch=None) -> DataFrame:
    """Target rows of the month of ``end`` joined to the class view on item code."""
    tg = in_month(t.targets, "target_date", end)
    tg = with_class(tg, t.items_class, F.col("item_code"))
    tg = optional_in(tg, CLS_CLASS, classification)
    tg = optional_in(tg, CLS_CODE, sku)
    tg = optional_in(tg, "loc_code", branch)
    return tg


def target_value(rows: DataFrame, *by: Column | str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("target_value").alias("trg_value"))


def opening_stock_by_mapping(t: Tables, start, end) -> DataFrame:
    """Opening-date sellable stock resolved to the item master's mapping code.

    Rows carry ``itm_mapping_code`` (resolved), ``itm_desc``, the class of the
    resolved code (``cls_*``) and the location (``loc_*``).
    """
    s = sellable_snapshot(t, "opening", start, end)
    # Two joins, each with its own size check. Joining the two dimensions first
    # would probe the fact once, but Spark (without CBO) estimates a join as
    # the product of its inputs, so the joined dimension would lose its static
    # broadcast and the fact would be shuffled instead.
    # Rows of a hot item, or without a mapping code, are spread by item and location.
    spread = ("item_code", "subinventory_code")
    s = with_item_class(s, t.items, t.items_class, F.col("item_code"), spread)
    return with_location(s, t.locations, F.col("subinventory_code"))


def targets_by_mapping(t: Tables, end, class_on: str = "item") -> DataFrame:
    """Month-of-``end`` targets resolved to the item master's mapping code.

    The master is joined on the target's own item code (``item_code = matnr``);
    a code that the master does not hold resolves to NULL. Source-specific key
    mappings belong to the load (``sources/external.py``). ``class_on='item'`` classifies by the target's own item code,
    ``'mapping'`` by the resolved mapping code.
    """
    tg = in_month(t.targets, "target_date", end)
    spread = ("item_code", "loc_code", "target_date")
    code = F.col("item_code")
    if class_on == "item":
        return with_class(with_item(tg, t.items, code, spread), t.items_class, code, spread)
    return with_item_class(tg, t.items, t.items_class, code, spread)


def actual_vs_target(actual: DataFrame, target: DataFrame, keys: list[str],
                     actual_col: str = "amount", target_col: str = "target_value") -> DataFrame:
    """Align two pre-aggregated sides by zero padding and re-aggregate.

    ``actual`` has ``keys + [actual_col]``, ``target`` has ``keys + [target_col]``.
    A side without rows contributes 0, not NULL (the union keeps the other
    side's literal zero).
    """
    a = actual.select(*keys, F.col(actual_col).alias("_a"), F.lit(0).alias("_t"))
    b = target.select(*keys, F.lit(0).alias("_a"), F.col(target_col).alias("_t"))
    u = a.unionByName(b)
    agg = [F.sum("_a").alias(actual_col), F.sum("_t").alias(target_col)]
    return u.groupBy(*keys).agg(*agg) if keys else u.agg(*agg)


def pivot_max(df: DataFrame, keys: list[Column | str], pivot_col: str,
              values: Mapping[str, str], value_col: str, *extra: Column) -> DataFrame:
    """Fixed-list pivot: one ``max(value)`` column per pivot value.

    Built as ``max(when(pivot == v, value))`` in a single aggregate, so extra
    aggregates (e.g. an average over all rows) share the same shuffle.
    """
    cols = [F.max(F.when(F.col(pivot_col).cast("string") == code, F.col(value_col))).alias(name)
            for code, name in values.items()]
    return df.groupBy(*keys).agg(*cols, *extra)


def threshold_counts(df: DataFrame, keys: list[str], cond_above: Column,
                     cond_below: Column, above: str, below: str) -> DataFrame:
    """Per group, the number of rows above and at-or-below their threshold."""
    return df.groupBy(*keys).agg(F.count(F.when(cond_above, 1)).alias(above),
                                 F.count(F.when(cond_below, 1)).alias(below))


def with_total_row(df: DataFrame, label_col: str, label: str, sum_cols: list[str],
                   recompute: Mapping[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Append one total row: ``label`` in ``label_col``, sums of ``sum_cols``,
    and columns recomputed from those sums (not summed themselves)."""
    total = df.agg(*[F.sum(c).alias(c) for c in sum_cols])
    total = total.select(F.lit(label).alias(label_col), *sum_cols)
    for name, fn in (recompute or {}).items():
        total = total.withColumn(name, fn(*[F.col(c) for c in sum_cols]))
    return df.unionByName(total.select(*df.columns))
