"""Column expressions shared by the reports (all JVM-side, no UDFs)."""

from __future__ import annotations

import calendar
import datetime as dt
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from distkpi.constants import SNAP_EPSILON, THRESHOLD_DAYS


def as_date(value) -> dt.date:
    """Accept a ``date`` or an ISO ``'YYYY-MM-DD'`` string."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def days_in_month(end) -> int:
    """Number of days in the calendar month of ``end`` (29 for a leap February)."""
    d = as_date(end)
    return calendar.monthrange(d.year, d.month)[1]


def normalize_item_code(code: Column, strict: bool = True) -> Column:
    """Item code as the class view keys it: codes not starting with ``F`` lose
    their leading zeros through an integer cast; ``F`` codes and NULL pass.

    ``strict`` raises on a malformed code, whatever the session's ANSI mode;
    ``strict=False`` turns such codes into NULL instead.
    """
    as_int = code.try_cast("int").cast("string")
    if strict:
        as_int = F.coalesce(as_int, F.raise_error(F.concat(F.lit("malformed item code: "), code)))
    return F.when(~code.like("F%"), as_int).otherwise(code)


def resolve_mapping_code(mapping_code: Column, matnr: Column) -> Column:
    """Empty or NULL mapping code falls back to the item's own code."""
    return F.when((mapping_code == "") | mapping_code.isNull(), matnr).otherwise(mapping_code)


def month_label_padded(d: Column) -> Column:
    """``'Month YYYY'`` with the month name blank-padded to 9 characters."""
    return F.concat(F.rpad(F.date_format(d, "MMMM"), 9, " "), F.lit(" "), F.date_format(d, "yyyy"))


def month_label(d: Column) -> Column:
    """``'Month YYYY'`` without padding."""
    return F.date_format(d, "MMMM yyyy")


def snap_small(value: Column, eps: float = SNAP_EPSILON) -> Column:
    """NULL to 0, and any value with magnitude under ``eps`` to 0."""
    v = F.coalesce(value, F.lit(0))
    return F.when(F.abs(v) < eps, F.lit(0)).otherwise(v)


def round_ratio(num: Column, den: Column, digits: int, times: int = 1) -> Column:
    """``round(num * times / den, digits)`` of decimals, half away from zero, exactly.

    Both sides are scaled to integers (sums have at most 4 decimals) and
    divided once with ``div``, so no intermediate quotient is cut and no value
    passes through binary floating point. NULL when ``den`` is 0 or NULL.
    Returns a decimal with ``digits`` decimals.
    """
    n = (num.cast("decimal(28,4)") * F.lit(10_000)).cast("decimal(30,0)")
    d = F.nullif((den.cast("decimal(28,4)") * F.lit(10_000)).cast("decimal(30,0)"), F.lit(0))
    units = F.call_function("div", F.abs(n) * F.lit(2 * times * 10 ** digits) + F.abs(d), F.abs(d) * F.lit(2))
    signed = F.when((n < 0) != (d < 0), -units).otherwise(units)
    return (signed.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(24,{digits})")


def daily_target(target: Column, days: int) -> Column:
    """Target per day of the month, rounded to 1 decimal."""
    return round_ratio(target, F.lit(days), 1)


def cover_days(inventory: Column, target: Column, days: int, snap: bool = True) -> Column:
    """Days of sales the inventory covers: ``inventory / (target / days)``, rounded to 1 decimal.

    A zero or NULL target gives NULL.
    """
    inv = snap_small(inventory) if snap else F.coalesce(inventory, F.lit(0))
    return round_ratio(inv, target, 1, times=days)


def attainment(actual: Column, target: Column, zero: str = "zero",
               scale: int = 100, digits: int = 2) -> Column:
    """Actual over target, in percent by default, rounded exactly (:func:`round_ratio`).

    ``zero='zero'``: 0 when either side is 0 or NULL;
    ``zero='denominator'``: 0 when the target is 0 or NULL;
    ``zero='null'``: NULL when the target is 0;
    ``zero='raw'``: unrounded, unscaled ratio, NULL on a zero target.
    """
    if zero == "raw":
        return actual.cast("double") / F.nullif(target.cast("double"), F.lit(0.0))
    value = round_ratio(actual, target, digits, times=scale)
    if zero == "null":
        return value
    if zero == "zero":
        ok = (actual != 0) & (target != 0)
    elif zero == "denominator":
        ok = target != 0
    else:
        raise ValueError(f"unknown zero rule {zero!r}")
    return F.when(ok, value).otherwise(F.lit(0))


def count_share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``round(part / whole * 100, digits)`` for non-negative counts, exactly.

    Computed in integers (half-up, as decimal rounding does) and divided once
    at the end, so a tie such as 1/160 = 0.625 % cannot round differently
    through binary floating point. NULL when ``whole`` is 0.
    """
    scale = 10 ** digits
    num = part.cast("long") * F.lit(2 * 100 * scale) + whole.cast("long")
    den = F.nullif(whole.cast("long"), F.lit(0)) * F.lit(2)
    units = (num - num % den) / den          # exact: num - num % den is a multiple of den
    return units / F.lit(float(scale))


def threshold_for(cls: Column, thresholds: dict[str, int] | None = None) -> Column:
    """Target cover days of an item class (NULL for other classes)."""
    thresholds = thresholds or THRESHOLD_DAYS
    expr = None
    for key, days in thresholds.items():
        expr = (F.when(cls == key, F.lit(days)) if expr is None
                else expr.when(cls == key, F.lit(days)))
    return expr


def bucket_total(cols: list[str]) -> Column:
    """Row-wise sum of bucket columns; one NULL bucket makes the row total NULL."""
    return reduce(add, [F.col(c) for c in cols])
