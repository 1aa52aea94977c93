"""Row filters of the reports (all pushable to the Parquet scan where possible)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distkpi.functions.columns import as_date

from distkpi.constants import (BUSINESS_LINES, EXCLUDED_FLAG_CHANNEL, SALES_REASON,
                               SUBINVENTORY_EXTRA, SUBINVENTORY_PREFIX)


def as_values(values) -> list[str] | None:
    """Normalise an optional filter argument.

    ``None``, ``''`` and ``[]`` mean "no filter"; a scalar becomes a one-item
    list; every item is compared as text, like the report parameters.
    """
    if values is None or values == "" or (not isinstance(values, str) and len(values) == 0):
        return None
    if isinstance(values, (str, int)):
        values = [values]
    return [str(v) for v in values]


def in_values(c: Column, dtype: T.DataType, values: list[str]) -> Column:
    """``cast(c as string) IN values`` without wrapping the column in a cast.

    For integral columns only canonical integer texts can equal the column's
    text form, so those are compared as numbers (pushable to Parquet) and
    the rest can never match.
    """
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        nums = [int(v) for v in values if v.lstrip("-").isdigit() and str(int(v)) == v]
        return c.isin(nums) if nums else F.lit(False)
    if isinstance(dtype, T.StringType):
        return c.isin(values)
    return c.cast("string").isin(values)


def in_filter(df: DataFrame, column: str, values) -> DataFrame:
    """Optional multi-value filter: applied only when ``values`` is given."""
    vals = as_values(values)
    if vals is None:
        return df
    return df.where(in_values(F.col(column), df.schema[column].dataType, vals))


def month_bounds(end, back: int = 0) -> tuple[dt.date, dt.date]:
    """Half-open ``[first day of month(end) - back months, first day of next month)``."""
    d = as_date(end)
    first = d.replace(day=1)
    y, m = divmod(first.month - 1 - back, 12)
    lo = dt.date(first.year + y, m + 1, 1)
    y2, m2 = divmod(first.month, 12)
    hi = dt.date(first.year + y2, m2 + 1, 1)
    return lo, hi


def in_month(df: DataFrame, column: str, end) -> DataFrame:
    """Rows whose date falls in the calendar month of ``end`` (range form)."""
    lo, hi = month_bounds(end)
    return df.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))


def lookback(df: DataFrame, column: str, end, months: int, through: str = "day") -> DataFrame:
    """``months`` calendar months ending with the month of ``end``.

    ``through='day'`` stops after ``end`` itself, ``'month'`` at the month's end.
    """
    lo, month_end = month_bounds(end, back=months - 1)
    hi = as_date(end) + dt.timedelta(days=1) if through == "day" else month_end
    return df.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))


def date_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """Closed range ``start <= column <= end`` on a date column."""
    return df.where(F.col(column).between(F.lit(as_date(start)), F.lit(as_date(end))))


def sellable_stock(df: DataFrame, buslines: Iterable[str] = BUSINESS_LINES,
                   prefix: str = SUBINVENTORY_PREFIX,
                   extra: Iterable[str] = SUBINVENTORY_EXTRA) -> DataFrame:
    """Stock of the sellable business lines held in sellable sub-inventories."""
    sub = F.col("subinventory_code")
    return df.where(F.col("busline_code").isin(list(buslines))
                    & (sub.startswith(prefix) | sub.isin(list(extra))))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where any of the key columns is NULL (the ``x = x`` idiom)."""
    cond = None
    for c in columns:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.where(cond)


def common_sales_filter(df: DataFrame, start, end, buslines: Iterable[str] = BUSINESS_LINES,
                        excluded: tuple[str, str] = EXCLUDED_FLAG_CHANNEL,
                        reason: str = SALES_REASON) -> DataFrame:
    """Filters every documented sales metric applies.

    Billing date in ``[start, end]``, business line in ``buslines``, reason
    ``reason``, and not (flag = excluded[0] and channel = excluded[1]); a NULL
    channel on a row of that flag makes the condition NULL, so it is dropped.
    """
    flag, channel = excluded
    return df.where(
        F.col("billing_date").between(F.lit(as_date(start)), F.lit(as_date(end)))
        & F.col("business_line_id").isin(list(buslines))
        & (F.col("reason_code") == reason)
        & ~((F.col("data_flag") == flag) & (F.col("channel") == channel)))
