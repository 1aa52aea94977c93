"""Materialised logical tables ("marts") on Parquet, published version by version.

Layout, chosen for the reports' access paths:

* every load writes new folders, ``<table>/load=<id>``, and never touches an
  old one. What is valid is a *version*: a small table of (table, folder,
  partition) rows under ``_versions/<number>``, put there by one rename. A
  reader resolves a version once, so it sees all of a load or nothing of it,
  and keeps its version however many loads follow. A load that stops halfway
  leaves folders no version names; two loads at once cannot both take a number.
  :func:`vacuum` removes what the newest versions do not name;
* snapshot tables (stock, valuation, WIP) are partitioned by their snapshot
  date or load time, so the latest-snapshot scalar subquery prunes to one
  partition at run time (directory pruning also works for the WIP load
  timestamp, whose type Parquet row-group statistics cannot filter);
* fact tables are partitioned by their date (``fact_layout="day"``, the
  default: a report's date range reads its days only, and a load replaces only
  its days). ``"cluster"`` writes a fact as files sorted by date, split by
  month: for data of a few MB a day that are always written whole, where a
  folder per day would only make tiny files;
* every write goes through the ``rebalance`` hint, so AQE splits a date that
  holds a large share of the rows over several tasks, and no write samples or
  computes its input a second time;
* dimensions are written as they are.

Small tables are maintained beside the facts, from the rows of a load and the
entries of the days it replaces; no old fact partition is read:

* load indexes (``INDEXES``): the distinct snapshot dates (for stock also
  opening date and business line), in which the newest load is looked up;
* the lists of the sales header (``plans/documented.py``), twice: the distinct
  entries of every day, and the distinct entries with the number of days that
  hold them. A load adds its days' entries and takes off those of the days it
  replaces; an entry that no day holds any more disappears.
"""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from distkpi.plans.documented import LISTS
from distkpi.sources.schemas import SCHEMAS, check_schema
from distkpi.sources.tables import Tables

PARTITIONED = {"stock": "stock_closing_date", "valuation": "executiondate",
               "wip": "record_created_date"}
CLUSTERED = {"sales": "billing_date", "targets": "target_date", "budget": "target_date",
             "dispatch": "actual_gm_date", "sales_header": "billing_date",
             "price_list": "first_date"}
#: Index of the loads of a snapshot table: its columns, the partition column first.
INDEXES = {"stock": ["stock_closing_date", "stock_opening_date", "busline_code"],
           "valuation": ["executiondate"], "wip": ["record_created_date"]}
LIST_FACT, LIST_DAY = "sales_header", "billing_date"

WRITERS = 8          # tables written at a time; Spark deals their tasks to the same executors

VERSIONS = "_versions"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"

#: What a version names: per table its folders, per folder the partitions (None: all of it).
Version = dict[str, dict[str, list[str] | None]]


class LoadConflict(Exception):
    """Another load took the version number; this one published nothing."""


# ---- versions -------------------------------------------------------------------

def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none if there is no folder)."""
    p = _path(spark, path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published version numbers, ascending."""
    return [int(n) for n in _names(spark, f"{path}/{VERSIONS}") if n.isdigit()]


def _load_version(spark: SparkSession, path: str, number: int) -> Version:
    rows = spark.read.schema("name string, folder string, part string").json(
        f"{path}/{VERSIONS}/{number:010d}").collect()          # one row per table, folder and partition
    out: Version = {}
    for name, folder, part in rows:
        folders = out.setdefault(name, {})
        if part is None:
            folders[folder] = None
        else:
            folders.setdefault(folder, []).append(part)
    return out


def _publish(spark: SparkSession, path: str, number: int, version: Version) -> None:
    """The switch: a finished folder is renamed to its number; an existing number is an error."""
    rows = [(name, folder, part) for name, folders in version.items() for folder, parts in folders.items()
            for part in ([None] if parts is None else parts)]
    made = f"{path}/{VERSIONS}/_{number:010d}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "name string, folder string, part string").coalesce(1).write.json(made)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, made).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, made), _path(spark, f"{path}/{VERSIONS}/{number:010d}"), options)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            raise LoadConflict(f"version {number} of {path} was published by another load") from e
        raise


def _read(spark: SparkSession, path: str, name: str, schema: T.StructType, folders: dict[str, list[str] | None],
          keep_load: bool = False) -> DataFrame:
    """A table of a version: its folders and partitions, and no others."""
    paths = [f"{path}/{name}/{folder}" + (f"/{part}" if part else "")
             for folder, parts in folders.items() for part in ([None] if parts is None else parts)]
    columns = schema.fieldNames() + ["load"] * keep_load
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("load", T.StringType())])
                                     ).select(*columns)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*paths).select(*columns)


# ---- writing --------------------------------------------------------------------

def _write_table(df: DataFrame, name: str, path: str, folder: str, layout: str) -> list[str] | None:
    """Write a table's rows of a load; the partitions made (None: not partitioned)."""
    out = f"{path}/{name}/{folder}"
    if name in PARTITIONED or (layout == "day" and name in CLUSTERED):
        col = PARTITIONED.get(name) or CLUSTERED[name]
        df.hint("rebalance", col).sortWithinPartitions(col).write.partitionBy(col).parquet(out)
        return [n for n in _names(df.sparkSession, out) if "=" in n]
    if name in CLUSTERED:
        col = CLUSTERED[name]
        months = df.withColumn("_month", F.trunc(col, "MM")).hint("rebalance", "_month")
        months.sortWithinPartitions(col).drop("_month").write.parquet(out)
    else:
        df.hint("rebalance").write.parquet(out)
    return None


def _each(function, items: list) -> list:
    """``function`` of every item, several at a time; the first error after all have ended."""
    with ThreadPoolExecutor(WRITERS) as pool:
        return list(pool.map(lambda x: function(*x), items))


def _folder(number: int) -> str:
    return f"load=v{number}-{uuid.uuid4().hex[:12]}"


def _next(spark: SparkSession, path: str) -> int:
    return (versions(spark, path) or [0])[-1] + 1


def write_marts(tables: Tables, path: str, fact_layout: str = "day") -> int:
    """Publish a version that holds the given tables and nothing else; returns its number."""
    if fact_layout not in ("cluster", "day"):
        raise ValueError(f"unknown fact layout {fact_layout!r}")
    spark = tables.stock.sparkSession
    number = _next(spark, path)
    folder = _folder(number)
    _each(lambda name, df: _write_table(df, name, path, folder, fact_layout), list(tables.as_dict().items()))
    version: Version = {name: {folder: None} for name in SCHEMAS}
    _maintain(spark, path, folder, version, {}, {})
    _publish(spark, path, number, version)
    return number


def write_load(tables: Tables, path: str) -> int:
    """Publish a version that merges a load into marts of the ``day`` layout; returns its number.

    Fact and snapshot rows replace the partitions of the dates that occur in
    them; dimensions are replaced whole, unless the load holds no row of them.
    """
    spark = tables.stock.sparkSession
    base = versions(spark, path)
    if not base:
        return write_marts(tables, path)
    number, old = base[-1] + 1, _load_version(spark, path, base[-1])
    folder, version, replaced = _folder(number), {n: dict(f) for n, f in old.items()}, {}

    def write(name: str, df: DataFrame) -> list[str] | None:
        dated = name in PARTITIONED or name in CLUSTERED
        return [] if not dated and df.isEmpty() else _write_table(df, name, path, folder, "day")

    made = dict(zip(SCHEMAS, _each(write, [(n, getattr(tables, n)) for n in SCHEMAS])))
    for name, parts in made.items():
        if parts is None:
            version[name] = {folder: None}
        elif parts:
            version[name], replaced[name] = _replace(spark, path, name, old[name], set(parts))
            version[name][folder] = parts
    _maintain(spark, path, folder, version, old, replaced)
    _publish(spark, path, number, version)
    return number


def _replace(spark: SparkSession, path: str, name: str, folders: dict[str, list[str] | None],
             new: set[str]) -> tuple[dict, list[tuple[str, str]]]:
    """The folders without the partitions that are new, and those taken out as (folder, partition)."""
    left, gone = {}, []
    for folder, parts in folders.items():
        held = parts if parts is not None else [n for n in _names(spark, f"{path}/{name}/{folder}") if "=" in n]
        if parts is None and not held and any(n.endswith(".parquet") for n in _names(spark, f"{path}/{name}/{folder}")):
            raise ValueError(f"{name} was written in the 'cluster' layout: it can only be written whole")
        taken = [p for p in held if p in new]
        gone += [(folder, p) for p in taken]
        if not taken:
            left[folder] = parts
        elif len(taken) < len(held):
            left[folder] = [p for p in held if p not in new]
    return left, gone


# ---- the small tables -----------------------------------------------------------

def _index_schema(name: str) -> T.StructType:
    return T.StructType([SCHEMAS[name][c] for c in INDEXES[name]])


def _list_schema(name: str, *extra: T.StructField) -> T.StructType:
    return T.StructType([*[SCHEMAS[LIST_FACT][c] for c in LISTS[name]], *extra])


def _days_schema(name: str) -> T.StructType:
    return T.StructType([SCHEMAS[LIST_FACT][LIST_DAY], *_list_schema(name).fields])


_COUNT = T.StructField("days", T.LongType())


def _maintain(spark: SparkSession, path: str, folder: str, version: Version, old: Version,
              replaced: dict[str, list[tuple[str, str]]]) -> None:
    """Bring indexes and lists up to a load, from the folders it wrote and the small tables of ``old``."""
    def loaded(name: str) -> DataFrame:
        return _read(spark, path, name, SCHEMAS[name], {folder: None})

    def index(name: str, columns: list[str]) -> None:
        new = loaded(name).select(*columns).distinct()
        kept = _read(spark, path, f"{name}_loads", _index_schema(name), old.get(f"{name}_loads", {}))
        dates = new.select(F.col(columns[0]).alias("_d")).distinct()
        kept = kept.join(dates, F.col(columns[0]).eqNullSafe(F.col("_d")), "left_anti")
        kept.unionByName(new).coalesce(1).write.parquet(f"{path}/{name}_loads/{folder}")
        version[f"{name}_loads"] = {folder: None}

    def entries(name: str, columns: list[str]) -> None:
        days, whole = f"list_{name}_days", f"list_{name}"
        (loaded(LIST_FACT).select(LIST_DAY, *columns).distinct().hint("rebalance", LIST_DAY)
         .sortWithinPartitions(LIST_DAY).write.parquet(f"{path}/{days}/{folder}"))
        plus = _read(spark, path, days, _days_schema(name), {folder: None}).select(*columns, F.lit(1).alias("days"))
        total = plus.unionByName(_read(spark, path, whole, _list_schema(name, _COUNT), old.get(whole, {})))
        gone = replaced.get(LIST_FACT, [])
        if gone:
            total = total.unionByName(_entries(spark, path, days, name, gone).select(*columns, F.lit(-1).alias("days")))
        total.groupBy(*columns).agg(F.sum("days").alias("days")).where("days > 0").hint("rebalance").write.parquet(
            f"{path}/{whole}/{folder}")
        version[days] = {**old.get(days, {}), folder: None}
        version[whole] = {folder: None}

    _each(index, [x for x in INDEXES.items() if folder in version[x[0]]])
    _each(entries, list(LISTS.items()) if folder in version[LIST_FACT] else [])


def _entries(spark: SparkSession, path: str, days: str, name: str, gone: list[tuple[str, str]]) -> DataFrame:
    """The daily entries of the given (folder, partition) pairs."""
    dates = [(f.split("=", 1)[1], None if p.endswith(NULL_PARTITION) else dt.date.fromisoformat(p.split("=", 1)[1]))
             for f, p in gone]
    pairs = spark.createDataFrame(dates, "_load string, _day date")     # one row per replaced day
    rows = _read(spark, path, days, _days_schema(name), {f: None for f, _ in gone}, keep_load=True)
    known = [d for _, d in dates if d is not None]
    span: Column = F.col(LIST_DAY).isNull()
    if known:                                                           # files are sorted by day
        span = span | F.col(LIST_DAY).between(F.lit(min(known)), F.lit(max(known)))
    return rows.where(span).join(pairs, (F.col("load") == F.col("_load")) & F.col(LIST_DAY).eqNullSafe(F.col("_day")),
                                 "left_semi")


# ---- reading --------------------------------------------------------------------

def read_marts(spark: SparkSession, path: str, version: int | None = None) -> Tables:
    """Bind a version (the newest by default) with the declared schemas (no inference)."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version or ''} of marts at {path}")
    v = _load_version(spark, path, known[-1] if version is None else version)
    frames = {name: check_schema(name, _read(spark, path, name, schema, v[name])) for name, schema in SCHEMAS.items()}
    loads = {name: _read(spark, path, f"{name}_loads", _index_schema(name), v.get(f"{name}_loads", {}))
             for name in INDEXES}
    lists = {name: _read(spark, path, f"list_{name}", _list_schema(name), v.get(f"list_{name}", {})) for name in LISTS}
    return Tables(**frames, loads=loads, header_lists=lists)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove folders and partitions that none of the newest ``keep`` versions names; returns them.

    For a time without loads: a load that is being written has no version yet.
    """
    if keep < 1:
        raise ValueError("at least the newest version stays")
    known = versions(spark, path)
    held: dict[tuple[str, str], set[str] | None] = {}
    for number in known[-keep:]:
        for name, folders in _load_version(spark, path, number).items():
            for folder, parts in folders.items():
                before = held.get((name, folder), set())
                held[name, folder] = None if parts is None or before is None else before | set(parts)
    gone = []
    for name in (n for n in _names(spark, path) if n != VERSIONS):
        for folder in (f for f in _names(spark, f"{path}/{name}") if f.startswith("load=")):
            if (name, folder) not in held:
                gone.append(f"{name}/{folder}")
            elif held[name, folder] is not None:
                gone += [f"{name}/{folder}/{p}" for p in _names(spark, f"{path}/{name}/{folder}")
                         if "=" in p and p not in held[name, folder]]
    gone += [f"{VERSIONS}/{n}" for n in _names(spark, f"{path}/{VERSIONS}")
             if not n.isdigit() or int(n) not in known[-keep:]]
    for g in gone:
        p = _path(spark, f"{path}/{g}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone
