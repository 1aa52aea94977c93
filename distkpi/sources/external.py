"""Binding existing relations (files, catalog tables, JDBC) to the logical tables.

Source systems name and type columns their own way (codes stored as integers
or text, dates as text, amounts as floating point). :func:`conform` selects
the logical columns, renames where asked and casts once at load, so the
reports never cast inside a join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distkpi.sources.schemas import SCHEMAS
from distkpi.sources.tables import Tables


def conform(name: str, df: DataFrame, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Columns of logical table ``name`` from ``df``, cast to the declared types.

    ``rename`` maps source column names to logical ones. Extra source columns
    are dropped (and pruned from the scan); a missing column is an error. So is,
    when the rows are read, a value that the declared type would change (a
    fourth decimal of a price, a text that is no date, a time of day in a date):
    nothing is rounded away or turned into NULL at load.
    """
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    schema = SCHEMAS[name]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {name!r} misses columns {missing}")
    return df.select(*[_lossless(df, f, name).alias(f.name) for f in schema.fields])


def _same_number(c: Column, source: T.DataType, value: Column) -> Column:
    """Whether ``value``, a decimal or an integer, is the number ``c`` holds, at the source's own scale."""
    if isinstance(source, T.DecimalType):
        # A decimal of another scale is compared with all its digits: Spark widens both sides.
        return value == c
    if isinstance(source, T.IntegralType):
        return value == c.cast("decimal(20,0)")
    # Floating point by its shortest text, text as it stands: no digit may be lost on the way to the value.
    text = F.trim(c.cast("string"))
    digits = F.regexp_extract(text, r"^[-+]?[0-9]*\.?([0-9]*?)0*(?:[eE]([-+]?[0-9]+))?$", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    exact = F.length(digits) - power <= 18       # decimals that decimal(38,18) holds
    return exact & (value == text.try_cast("decimal(38,18)"))


def _lossless(df: DataFrame, field: T.StructField, table: str) -> Column:
    source, c = df.schema[field.name].dataType, F.col(field.name)
    if source == field.dataType or isinstance(field.dataType, T.StringType):
        return c.cast(field.dataType)
    value = c.try_cast(field.dataType)
    same = value.isNotNull()
    if isinstance(field.dataType, (T.DecimalType, T.IntegralType)):
        same = same & _same_number(c, source, value)
    elif isinstance(field.dataType, T.DateType) and isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        same = same & (value.cast(source) == c)                       # midnight of the day
    elif isinstance(field.dataType, T.DateType) and isinstance(source, T.StringType):
        at = c.try_cast("timestamp_ntz")
        same = same & (at.isNull() | (value.cast("timestamp_ntz") == at))
    message = F.concat(F.lit(f"{table}.{field.name} does not fit {field.dataType.simpleString()}: "), c.cast("string"))
    return F.when(c.isNull() | F.coalesce(same, F.lit(False)), value).otherwise(
        F.raise_error(message).cast(field.dataType))


def read_files(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
               options: Mapping[str, str] | None = None,
               renames: Mapping[str, Mapping[str, str]] | None = None) -> Tables:
    """Logical tables from files, one path per table name."""
    renames = renames or {}
    frames = {}
    for name in SCHEMAS:
        reader = spark.read.format(fmt).options(**dict(options or {}))
        frames[name] = conform(name, reader.load(paths[name]), renames.get(name))
    return Tables(**frames)


def read_catalog(spark: SparkSession, relations: Mapping[str, str],
                 renames: Mapping[str, Mapping[str, str]] | None = None) -> Tables:
    """Logical tables from catalog tables or views (``relations``: name -> table)."""
    renames = renames or {}
    return Tables(**{n: conform(n, spark.table(relations[n]), renames.get(n)) for n in SCHEMAS})


def read_jdbc(spark: SparkSession, url: str, relations: Mapping[str, str],
              properties: Mapping[str, str],
              partitions: Mapping[str, tuple[str, int, int, int]] | None = None,
              renames: Mapping[str, Mapping[str, str]] | None = None) -> Tables:
    """Logical tables read over JDBC.

    ``partitions`` gives, per large table, ``(column, lower, upper, num)`` so
    the read is split into ``num`` parallel range queries instead of one
    connection reading everything; filters and column pruning are pushed into
    the generated SQL by Spark's JDBC source.
    """
    partitions = partitions or {}
    renames = renames or {}
    frames = {}
    for name in SCHEMAS:
        props = dict(properties)
        if name in partitions:
            col, lower, upper, num = partitions[name]
            df = spark.read.jdbc(url, relations[name], column=col, lowerBound=lower,
                                 upperBound=upper, numPartitions=num, properties=props)
        else:
            df = spark.read.jdbc(url, relations[name], properties=props)
        frames[name] = conform(name, df, renames.get(name))
    return Tables(**frames)
