"""Command line: run one report and write its rows with Spark's writers.

    python -m distkpi.run cover_days --marts PATH --start 2000-03-01 --end 2000-03-31 \
        --classification A,B --out /shared/out/cover_days --format parquet

``--marts`` reads materialised tables (``distkpi.sources.marts``), ``--testdata``
derives them from the generated TPC-H-like tables. The result is written by
the executors (no collect); without ``--out`` the first 50 rows are shown, and said to be.
"""

from __future__ import annotations

import argparse

from distkpi.plans.registry import REPORTS, run
from distkpi.session import get_session
from distkpi.sources.marts import read_marts
from distkpi.sources.testdata import load_tables


SHOWN = 50


def _list(value: str | None):
    return [v for v in value.split(",") if v] if value else None


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="distkpi.run")
    ap.add_argument("report", choices=sorted(REPORTS))
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--marts")
    src.add_argument("--testdata")
    ap.add_argument("--start")
    ap.add_argument("--end")
    ap.add_argument("--classification")
    ap.add_argument("--sku")
    ap.add_argument("--branch")
    ap.add_argument("--business-line")
    ap.add_argument("--n", type=int)
    ap.add_argument("--table", dest="name")
    ap.add_argument("--limit", type=int, default=1000)
    ap.add_argument("--offset", type=int, default=0)
    ap.add_argument("--order-by", help="sort key of a page")
    ap.add_argument("--after", help="sort key of the last row of the page before")
    ap.add_argument("--out")
    ap.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "orc"])
    ap.add_argument("--master")
    a = ap.parse_args(argv)

    spark = get_session(a.master)
    tables = read_marts(spark, a.marts) if a.marts else load_tables(spark, a.testdata)
    df = run(a.report, tables, start=a.start, end=a.end, classification=_list(a.classification),
             sku=_list(a.sku), branch=_list(a.branch), business_line=a.business_line, n=a.n,
             name=a.name, limit=a.limit, offset=a.offset,
             order_by=_list(a.order_by), after=_list(a.after))
    if a.out:
        writer = df.write.mode("overwrite")
        if a.format == "csv":
            writer = writer.option("header", "true")
        writer.format(a.format).save(a.out)
    else:
        df.show(SHOWN, truncate=False)
        print(f"shown: at most {SHOWN} rows; --out writes the whole result")


if __name__ == "__main__":
    main()
