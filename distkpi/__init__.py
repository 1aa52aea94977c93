"""distkpi: distribution and supply-chain KPI reports on Spark DataFrames.

Every report is a function ``report(t: Tables, start, end, **filters) -> DataFrame``
built from the reusable operators in :mod:`distkpi.operators` and the column
functions in :mod:`distkpi.functions`. Nothing is collected to the driver; the
returned DataFrame is lazy and the caller decides how to sink it.
"""

from distkpi.sources.tables import Tables

__all__ = ["Tables"]
