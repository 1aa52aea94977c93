"""Latest-snapshot selection.

Snapshot tables (stock, WIP, valuation) hold one load per date. A report reads
the newest load inside its date range. The newest date is an uncorrelated
scalar subquery: Spark runs it once and pushes the equality into the scan, so
on a table partitioned by the snapshot date only one partition is read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distkpi.functions.columns import as_date


def latest_date(df: DataFrame, column: str, start, end, where: Column | None = None,
                by_day: bool = False) -> Column:
    """Scalar subquery: the newest ``column`` value inside ``[start, end]``.

    ``by_day=True`` is for timestamp columns: the range is compared on the
    calendar day (``[start 00:00, end + 1 day)``), the result keeps the time.
    """
    c = F.col(column)
    lo, hi = as_date(start), as_date(end)
    if by_day:
        cond = (c >= F.lit(f"{lo} 00:00:00").cast("timestamp_ntz")) & (
            c < F.lit(f"{hi + dt.timedelta(days=1)} 00:00:00").cast("timestamp_ntz"))
    else:
        cond = c.between(F.lit(lo), F.lit(hi))
    if where is not None:
        cond = cond & where
    return df.where(cond).agg(F.max(c)).scalar()


def load_dates(t, name: str) -> DataFrame:
    """Where the loads of a snapshot table are looked up: its index, else the table itself."""
    return getattr(t, name) if t.loads is None else t.loads[name]


def latest_opening_load(t, start, end, where: Column) -> DataFrame:
    """Stock rows of the newest opening date in ``[start, end]``.

    The stock mart is partitioned by closing date. In the index of the loads
    one aggregate gives the newest opening date and the closing dates of its
    rows, and the range of these closing dates prunes the stock partitions;
    without it the stock itself is asked, as for any other snapshot.
    """
    column = "stock_opening_date"
    if t.loads is None:
        return latest_snapshot(t.stock, column, start, end, where)
    opening, closing = F.col(column), F.col("stock_closing_date")
    per = (t.loads["stock"].where(opening.between(F.lit(as_date(start)), F.lit(as_date(end))))
           .groupBy(opening.alias("opened")).agg(F.min(closing).alias("first"), F.max(closing).alias("last"),
                                                 F.bool_or(where).alias("counts")).where("counts"))
    newest = per.agg(F.max(F.struct("opened", "first", "last"))).scalar()
    return t.stock.where((opening == newest.getField("opened")) & (closing >= newest.getField("first"))
                         & (closing <= newest.getField("last")))


def latest_snapshot(df: DataFrame, column: str, start, end, where: Column | None = None,
                    by_day: bool = False, dates: DataFrame | None = None) -> DataFrame:
    """Rows of the newest load in ``[start, end]``; the inner ``where`` only
    decides which loads count, it does not filter the returned rows. ``dates``:
    an index of the loads to look it up in."""
    return df.where(F.col(column) == latest_date(df if dates is None else dates, column, start, end, where, by_day))
