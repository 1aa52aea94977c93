"""The bundle of logical tables every report reads from."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from distkpi.sources.schemas import SCHEMAS, check_schema


@dataclass(frozen=True)
class Tables:
    """Logical tables as DataFrames (see FIXTURES.md section 1 for columns)."""

    sales: DataFrame
    targets: DataFrame
    budget: DataFrame
    stock: DataFrame
    items: DataFrame
    items_class: DataFrame
    locations: DataFrame
    price_list: DataFrame
    wip: DataFrame
    valuation: DataFrame
    dispatch: DataFrame
    target_items: DataFrame
    product_map: DataFrame
    branches: DataFrame
    sales_header: DataFrame
    # Small tables the marts keep beside the facts (see sources/marts.py). Without
    # them the reports read the facts themselves.
    loads: dict[str, DataFrame] | None = None
    header_lists: dict[str, DataFrame] | None = None

    def as_dict(self) -> dict[str, DataFrame]:
        """The logical tables by name (without the derived ones)."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name in SCHEMAS}

    def register(self, prefix: str = "") -> None:
        """Expose every table as a temp view (for SQL users and ``list_tables``)."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)

    @classmethod
    def from_catalog(cls, spark: SparkSession, prefix: str = "") -> "Tables":
        """Bind to tables or views already present in the catalog."""
        return cls(**{n: check_schema(n, spark.table(prefix + n)) for n in SCHEMAS})
