"""Versions of the marts: what a load reads, what a reader sees, what a replaced day leaves."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from distkpi.plans import documented, stock, supply
from distkpi.session import scratch_path
from distkpi.sources import marts
from tests.fixtures import D, day, make_tables

LINE = "P07"


def sale(doc, date, item, customer="c1", line=LINE):
    return ("S", "x", line, f"line {line}", "Sales", customer, "8001", "North", "d1", "dist", doc, day(date) if date else None,
            item, f"item {item}", "b", "t", "A", D(1))


def load(spark, sales=(), loads=(), wip=(), items=(("1", "one", "1", "A"),)):
    return make_tables(
        spark, sales_header=[sale(*s) for s in sales], items=list(items), items_class=[("1", "A")] if items else [],
        locations=[("8001", "North")] if items else [],
        stock=[("1", "8001", LINE, D(q), D(1), D(1), day(o), day(c)) for o, c, q in loads],
        wip=list(wip))


@pytest.fixture
def path(spark):
    return scratch_path(spark, f"loads-{uuid.uuid4().hex[:8]}")


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def entries(t):
    return sorted(r[0] for r in documented.products(t, LINE).collect())


def spoil(path, table):
    """Make every data file of a table unreadable."""
    files = glob.glob(f"{local(path)}/{table}/**/*.parquet", recursive=True)
    for f in files:
        with open(f, "r+b") as out:
            out.truncate(3)
    for f in glob.glob(f"{local(path)}/{table}/**/.*.crc", recursive=True):
        os.remove(f)
    return files


def test_lists_follow_the_days(spark, path):
    marts.write_marts(load(spark, [(1, "2000-01-01", "a"), (2, "2000-01-01", "b"), (3, "2000-01-02", "b"),
                                   (4, None, "n")]), path)
    assert entries(marts.read_marts(spark, path)) == ["a", "b", "n"]
    # A load reads none of the facts that are there.
    for table in ("sales_header", "stock", "sales"):
        spoil(path, table)
    marts.write_load(load(spark, [(5, "2000-01-01", "c")]), path)            # replaces the day: a goes, b stays
    assert entries(marts.read_marts(spark, path)) == ["b", "c", "n"]
    marts.write_load(load(spark, [(6, "2000-01-02", "c"), (7, "2000-01-03", "d")]), path)
    assert entries(marts.read_marts(spark, path)) == ["c", "d", "n"]
    marts.write_load(load(spark, [(8, None, "m")]), path)                    # rows without a date are a day
    assert entries(marts.read_marts(spark, path)) == ["c", "d", "m"]
    for name in documented.LISTS:
        assert marts.read_marts(spark, path).header_lists[name].columns == documented.LISTS[name]
    assert sorted(r[0] for r in documented.locations(marts.read_marts(spark, path), LINE).collect()) == ["8001"]


def test_lists_equal_the_header_after_random_loads(spark, path):
    import random
    rng = random.Random(4)

    def rows(k):
        days = rng.sample(["2000-01-01", "2000-01-02", "2000-01-03", None], 2)
        return [(100 * k + i, rng.choice(days), rng.choice("abcdef")) for i in range(6)]
    marts.write_marts(load(spark, rows(0)), path)
    for k in range(1, 3):
        marts.write_load(load(spark, rows(k)), path)
        t = marts.read_marts(spark, path)
        assert entries(t) == sorted(r[0] for r in t.sales_header.select("item_code").distinct().collect())


def test_a_reader_keeps_its_version(spark, path):
    first = marts.write_marts(load(spark, [(1, "2000-01-01", "a")], [("2000-03-01", "2000-03-31", 5)]), path)
    before = marts.read_marts(spark, path)
    second = marts.write_load(load(spark, [(2, "2000-01-01", "z")], [("2000-03-01", "2000-03-31", 7)],
                                   items=[("2", "two", "2", "B")]), path)
    after = marts.read_marts(spark, path)
    assert (first, second) == (1, 2) and marts.versions(spark, path) == [1, 2]
    for t, item, qty, name in ((before, "a", 5, "one"), (after, "z", 7, "two"),
                               (marts.read_marts(spark, path, version=1), "a", 5, "one")):
        assert entries(t) == [item]
        assert [r["item_code"] for r in t.sales_header.collect()] == [item]
        assert [r["qty"] for r in t.stock.collect()] == [D(qty)]
        assert [r["matnr_desc"] for r in t.items.collect()] == [name]
    with pytest.raises(FileNotFoundError):
        marts.read_marts(spark, path, version=9)


def test_a_load_that_stops_changes_nothing(spark, path, monkeypatch):
    marts.write_marts(load(spark, [(1, "2000-01-01", "a")], [("2000-03-01", "2000-03-31", 5)]), path)
    second = load(spark, [(2, "2000-01-01", "z")], [("2000-03-01", "2000-03-31", 7)])
    written = []

    def failing(df, name, *rest):
        if len(written) == 6:
            raise RuntimeError("stopped")
        written.append(name)
        return write(df, name, *rest)
    write = marts._write_table
    monkeypatch.setattr(marts, "_write_table", failing)
    with pytest.raises(RuntimeError):
        marts.write_load(second, path)
    monkeypatch.undo()
    t = marts.read_marts(spark, path)
    assert marts.versions(spark, path) == [1] and entries(t) == ["a"]
    assert [r["qty"] for r in t.stock.collect()] == [D(5)]
    # The next load goes through; what the stopped one left goes with the next clean-up.
    marts.write_load(second, path)
    gone = marts.vacuum(spark, path)
    assert any("load=v2-" in g for g in gone) and any("load=v1-" in g for g in gone)
    t = marts.read_marts(spark, path)
    assert entries(t) == ["z"] and [r["qty"] for r in t.stock.collect()] == [D(7)]
    assert marts.vacuum(spark, path) == [] and marts.versions(spark, path) == [2]


def test_two_loads_cannot_take_one_number(spark, path):
    marts.write_marts(load(spark, [(1, "2000-01-01", "a")]), path)
    version = marts._load_version(spark, path, 1)
    marts._publish(spark, path, 2, version)
    with pytest.raises(marts.LoadConflict):
        marts._publish(spark, path, 2, version)
    assert marts.versions(spark, path) == [1, 2]


def test_cluster_marts_are_written_whole(spark, path):
    marts.write_marts(load(spark, [(1, "2000-01-01", "a")]), path, fact_layout="cluster")
    assert entries(marts.read_marts(spark, path)) == ["a"]
    with pytest.raises(ValueError, match="cluster"):
        marts.write_load(load(spark, [(2, "2000-01-01", "z")]), path)
    marts.write_marts(load(spark, [(2, "2000-01-01", "z")]), path)
    assert entries(marts.read_marts(spark, path)) == ["z"]
    with pytest.raises(ValueError):
        marts.write_marts(load(spark), path, fact_layout="other")


def test_load_index_answers_the_snapshots(spark, path):
    def wip(at, order):
        return (1, "s", 1, "p", "m", "t", order, D(1), D(1), D(1), D(1), "1", at)
    import datetime as dt
    one, two = dt.datetime(2000, 3, 5, 8), dt.datetime(2000, 3, 5, 17, 30)
    marts.write_marts(load(spark, loads=[("2000-03-01", "2000-03-10", 1), ("2000-03-02", "2000-03-11", 2),
                                         ("2000-03-02", "2000-03-12", 3)], wip=[wip(one, 1)]), path)
    t = marts.read_marts(spark, path)
    got = {r["qty"] for r in stock.opening_stock_by_mapping(t, "2000-03-01", "2000-03-31").collect()}
    assert got == {D(2), D(3)}
    marts.write_load(load(spark, loads=[("2000-03-01", "2000-03-12", 9), ("2000-03-04", "2000-03-13", 4)], wip=[wip(two, 2)]), path)
    t = marts.read_marts(spark, path)
    assert sorted(map(tuple, t.loads["stock"].select("stock_closing_date", "stock_opening_date").collect())) == [
        (day("2000-03-10"), day("2000-03-01")), (day("2000-03-11"), day("2000-03-02")),
        (day("2000-03-12"), day("2000-03-01")), (day("2000-03-13"), day("2000-03-04"))]
    assert {r["qty"] for r in stock.opening_stock_by_mapping(t, "2000-03-01", "2000-03-31").collect()} == {D(4)}
    assert {r["qty"] for r in stock.opening_stock_by_mapping(t, "2000-03-01", "2000-03-03").collect()} == {D(2)}
    assert stock.opening_stock_by_mapping(t, "2001-03-01", "2001-03-03").count() == 0
    assert [r["order_number"] for r in supply.wip(t, "2000-03-01", "2000-03-31").collect()] == [2]
    plain = t.__class__(**t.as_dict())
    for a, b in (("2000-03-01", "2000-03-31"), ("2001-01-01", "2001-01-31")):
        for report in (stock.inventory_days, supply.wip, supply.stock_valuation):
            assert sorted(map(repr, report(t, a, b).collect())) == sorted(map(repr, report(plain, a, b).collect()))


def test_random_dates_by_index_and_by_table(spark, path):
    import random
    rng = random.Random(8)
    rows = [(f"2000-03-{rng.randint(1, 9):02d}", f"2000-03-{rng.randint(1, 20):02d}", k) for k in range(25)]
    marts.write_marts(load(spark, loads=rows), path)
    t = marts.read_marts(spark, path)
    for start in range(1, 9, 3):
        a, b = f"2000-03-{start:02d}", f"2000-03-{start + 3:02d}"
        newest = max((o for o, _, _ in rows if a <= o <= b), default=None)
        got = sorted(int(r["qty"]) for r in stock.opening_stock_by_mapping(t, a, b).collect())
        assert got == sorted(q for o, _, q in rows if o == newest)


def test_lists_are_read_from_their_table(spark, path):
    marts.write_marts(load(spark, [(1, "2000-01-01", "a")]), path)
    t = marts.read_marts(spark, path)
    spoil(path, "sales_header")
    spoil(path, "list_products_days")
    assert entries(t) == ["a"]
    assert t.header_lists["products"].where(F.col("item_code") == "a").count() == 1
