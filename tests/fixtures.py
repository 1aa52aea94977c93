"""Hand-made logical tables for operator tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from distkpi.sources.schemas import SCHEMAS
from distkpi.sources.tables import Tables


def D(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def frame(spark, name: str, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMAS[name])


def make_tables(spark, **rows) -> Tables:
    """Tables with the given rows per table name; every other table is empty."""
    return Tables(**{n: frame(spark, n, rows.get(n, [])) for n in SCHEMAS})
