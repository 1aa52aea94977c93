"""Operator edge cases on hand-made rows (one group per reusable operator)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from distkpi.functions import columns as C
from distkpi.operators import filters as flt
from distkpi.operators.lookup import duplicate_keys, price_asof, price_fixed
from distkpi.operators.measures import actual_vs_target, with_total_row
from distkpi.operators.snapshot import latest_snapshot
from distkpi.plans import documented, lists, sales, stock, supply
from tests.fixtures import D, day, frame, make_tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else \
        sorted(tuple(r) for r in df.collect())


# K1 optional multi-value filter ------------------------------------------------

def test_in_filter_absent_values_mean_no_filter(spark):
    df = frame(spark, "sales", [("1", "A", 8001, day("2000-03-01"), D(1), D(1)),
                                ("2", "B", 8002, day("2000-03-01"), D(1), D(1))])
    for empty in (None, "", []):
        assert flt.in_filter(df, "classification", empty).count() == 2
    assert flt.in_filter(df, "classification", "A").count() == 1
    assert flt.in_filter(df, "classification", ["A", "B"]).count() == 2


def test_in_filter_numeric_column_compared_as_text(spark):
    df = frame(spark, "sales", [("1", "A", 8001, day("2000-03-01"), D(1), D(1))])
    assert flt.in_filter(df, "branch_id", "8001").count() == 1
    assert flt.in_filter(df, "branch_id", ["08001"]).count() == 0   # text '8001' != '08001'
    assert flt.in_filter(df, "branch_id", [8001]).count() == 1


# P5 / P14 sales summary ------------------------------------------------------

def test_sales_summary_nulls_and_cancelling_items(spark):
    d = day("2000-03-05")
    t = make_tables(spark, sales=[
        ("1", "A", 8001, d, D(1), D(100)),
        ("2", "A", 8001, d, D(1), D(50)), ("2", "A", 8001, d, D(1), D(-50)),   # cancels
        ("3", "A", 8001, d, D(1), None),                                      # all NULL
        ("4", None, 8001, d, D(1), D(7)), ("5", "A", None, d, D(1), D(7)),    # NULL keys
        (None, "A", 8001, d, D(1), D(7)),
        ("6", "B", 8001, day("2000-04-01"), D(1), D(9)),                      # out of range
    ])
    out = rows(sales.sales_summary(t, "2000-03-01", "2000-03-31"))
    assert out == [("A", 1, 100.0)]


# K5 / K6 codes ----------------------------------------------------------------

def test_normalize_item_code(spark):
    df = spark.createDataFrame([("0001013",), ("F0012",), (None,)], "c string")
    got = [r[0] for r in df.select(C.normalize_item_code(F.col("c"))).collect()]
    assert got == ["1013", "F0012", None]


def test_normalize_item_code_malformed(spark):
    df = spark.createDataFrame([("X01",)], "c string")
    with pytest.raises(Exception):
        df.select(C.normalize_item_code(F.col("c"))).collect()
    assert df.select(C.normalize_item_code(F.col("c"), strict=False)).collect()[0][0] is None


def test_resolve_mapping_code(spark):
    df = spark.createDataFrame([("M1", ""), ("M2", None), ("M3", "X"), (None, None)],
                               "matnr string, mapping string")
    got = [r[0] for r in df.select(C.resolve_mapping_code(F.col("mapping"), F.col("matnr"))).collect()]
    assert got == ["M1", "M2", "X", None]


# K4 sellable stock -------------------------------------------------------------

def test_sellable_stock_subinventories(spark):
    d = day("2000-03-31")
    df = frame(spark, "stock", [("1", s, "P07", D(1), D(1), D(1), d, d)
                                for s in ["8001", "8206", "8210", "8207", "9001", None]])
    got = sorted(r[0] for r in flt.sellable_stock(df).select("subinventory_code").collect())
    assert got == ["8001", "8206", "8210"]


# K3 latest snapshot ------------------------------------------------------------

def test_latest_snapshot_rules(spark):
    def r(bl, d):
        return ("1", "8001", bl, D(1), D(1), D(1), day(d), day(d))
    df = frame(spark, "stock", [r("P07", "2000-03-10"), r("P07", "2000-03-20"),
                                r("P99", "2000-03-25"),           # newer, other line
                                r("P07", "2000-04-02")])          # newer, outside range
    snap = latest_snapshot(df, "stock_closing_date", "2000-03-01", "2000-03-31",
                           where=F.col("busline_code").isin("P07", "P08", "P12"))
    assert rows(snap, "stock_closing_date") == [(day("2000-03-20"),)]
    empty = latest_snapshot(df, "stock_closing_date", "1990-01-01", "1990-01-31")
    assert empty.count() == 0


def test_wip_snapshot_keeps_later_load_of_the_day(spark):
    def w(ts, value):
        return (8001, "SL", 1, "P", "T", "N", 1, D(1), D(0), D(value), D(1), "1", ts)
    t = make_tables(spark, wip=[w(dt.datetime(2000, 3, 31, 8), 10),
                                w(dt.datetime(2000, 3, 31, 17), 20),
                                w(dt.datetime(2000, 4, 1, 1), 40)])
    out = supply.wip(t, "2000-03-01", "2000-03-31").collect()
    assert [r["wip_value"] for r in out] == [20.0]


# K10-K13 cover days ------------------------------------------------------------

def _stock_row(code, qty, cls_date="2000-03-31", sub="8001", price=10):
    return (code, sub, "P07", D(qty), D(price), D(price * 0.8), day("2000-03-01"), day(cls_date))


def test_cover_days_quirks(spark):
    t = make_tables(
        spark,
        stock=[_stock_row("0000000001", 10), _stock_row("0000000002", 5),
               _stock_row("0000000003", 0), _stock_row("0000000004", None),
               _stock_row("0000000005", -2)],
        items_class=[("1", "A"), ("2", None), ("3", "A"), ("5", "Others")],
        targets=[("1", 8001, "A", day("2000-03-01"), D(310)),
                 ("9", 8001, None, day("2000-03-01"), D(620))],
    )
    out = {r["classification"]: r for r in stock.cover_days(t, "2000-03-01", "2000-03-31").collect()}
    # qty 0 and NULL dropped; class A: 10*10=100 value vs 310/31=10 per day
    assert out["A"]["inv_val"] == 100.0 and out["A"]["cover_days"] == 10.0
    assert out["A"]["daily_target"] == 10.0
    # NULL class and literal 'Others' stay two stock rows: the target row joins twice
    others = [r for r in stock.cover_days(t, "2000-03-01", "2000-03-31").collect()
              if r["classification"] == "Others"]
    assert sorted(r["inv_val"] for r in others) == [-20.0, 50.0]


def test_cover_days_expression_edges(spark):
    df = spark.createDataFrame(
        [(D("0.0005"), D(31)), (None, D(31)), (D(10), D(0)), (D(10), None)],
        "inv decimal(18,4), trg decimal(18,4)")
    got = [r[0] for r in df.select(C.cover_days(F.col("inv"), F.col("trg"), 31)).collect()]
    assert got == [0.0, 0.0, None, None]
    assert C.days_in_month("2024-02-10") == 29 and C.days_in_month("2023-02-10") == 28


# K17 thresholds ------------------------------------------------------------------

def test_above_below_threshold_boundaries(spark):
    # Class A threshold 30: cover exactly 30 counts as "below"; no target: neither.
    t = make_tables(
        spark,
        items=[("1", "one", "1", "A"), ("2", "two", "2", "A"), ("3", "three", "3", "A")],
        items_class=[("1", "A"), ("2", "A"), ("3", "A")],
        stock=[_stock_row("1", 30, price=1), _stock_row("2", 31, price=1),
               _stock_row("3", 5, price=1)],
        targets=[("1", 8001, "A", day("2000-03-01"), D(31)),
                 ("2", 8001, "A", day("2000-03-01"), D(31))],
    )
    t = t.__class__(**{**t.as_dict(), "stock": t.stock.withColumn(
        "stock_opening_date", F.lit(day("2000-03-01")))})
    out = rows(stock.above_below_threshold(t, "2000-03-01", "2000-03-31"))
    assert out == [("A", 1, 1)]


# K8 / K9 price pick --------------------------------------------------------------

PRICE_CASES = [
    # (item, [(first_date, price)], expected for March 2000)
    ("own", [("2000-03-01", 5), ("2000-02-01", 4)], 5.0),
    ("own0_prev", [("2000-03-01", 0), ("2000-02-01", 4)], 4.0),
    ("own0_prev0", [("2000-03-01", 0), ("2000-02-01", 0)], 0.0),
    ("only_own0", [("2000-03-01", None)], None),
    ("only_prev", [("2000-02-29", 7)], 7.0),
    ("two_dates", [("2000-03-01", 5), ("2000-03-31", 6)], 6.0),
]


def _prices(spark):
    data = [(item, day(d), D(p)) for item, entries, _ in PRICE_CASES for d, p in entries]
    data.append(("none", day("1999-01-01"), D(3)))
    return frame(spark, "price_list", data)


def test_price_fixed_preferences(spark):
    got = dict(price_fixed(_prices(spark), "2000-03-31").collect())
    for item, _, want in PRICE_CASES:
        assert got[item] == (None if want is None else D(want)), item
    assert "none" not in got


def test_price_asof_matches_fixed_per_month(spark):
    got = {(r[0], r[1]): r[2] for r in price_asof(_prices(spark)).collect()}
    for item, _, want in PRICE_CASES:
        assert got[(item, day("2000-03-01"))] == (None if want is None else D(want)), item


def test_price_asof_aggregates_only_after_the_shuffle(spark):
    """A task before the shuffle keeps no table of its (item, month) pairs, nearly all different."""
    plan = price_asof(_prices(spark))._jdf.queryExecution().executedPlan().toString()
    above, below = plan[:plan.rindex("Exchange")], plan[plan.rindex("Exchange"):]
    assert "partial_min_by" in above and "Aggregate" not in below
    assert plan.count("Exchange hashpartitioning") == 1


# K14 attainment, K15 alignment, K18 total row --------------------------------------

def test_attainment_zero_rules(spark):
    df = spark.createDataFrame([(0.0, 5.0), (5.0, 0.0), (None, 5.0), (1.0, 3.0)], "a double, t double")
    got = [r[0] for r in df.select(C.attainment(F.col("a"), F.col("t"))).collect()]
    assert got == [0, 0, 0, D("33.33")]
    raw = [r[0] for r in df.select(C.attainment(F.col("a"), F.col("t"), zero="raw")).collect()]
    assert raw[1] is None and raw[3] == pytest.approx(1 / 3)


def test_actual_vs_target_missing_side_is_zero(spark):
    a = spark.createDataFrame([("A", 5)], "k string, amount int")
    b = spark.createDataFrame([("B", 7)], "k string, target_value int")
    got = rows(actual_vs_target(a, b, ["k"]))
    assert got == [("A", 5, 0), ("B", 0, 7)]


def test_distributor_vs_company_full_outer_and_total(spark):
    m = day("2000-03-01")
    t = make_tables(spark,
                    targets=[("1", 8001, "A", m, D(50))],
                    budget=[("2", "B", m, D(200))])
    got = {r[0]: tuple(r[1:]) for r in sales.distributor_vs_company_target(t, "2000-03-31").collect()}
    assert got["A"] == (50.0, 0.0, 0.0)
    assert got["B"] == (0.0, 200.0, 0.0)
    assert got["Total"] == (50.0, 200.0, 25.0)
    empty = make_tables(spark)
    only = sales.distributor_vs_company_target(empty, "2000-03-31").collect()
    assert [tuple(r) for r in only] == [("Total", None, None, 0.0)]


def test_with_total_row_recomputes(spark):
    df = spark.createDataFrame([("A", 1, 4), ("B", 3, 4)], "k string, a int, b int")
    out = with_total_row(df, "k", "Total", ["a", "b"], {})
    assert rows(out)[-1] == ("Total", 4, 8)


# F9 / F10 month labels ---------------------------------------------------------------

def test_month_labels(spark):
    df = spark.createDataFrame([(day("2026-05-01"),), (day("2026-09-01"),)], "d date")
    padded = [r[0] for r in df.select(C.month_label_padded(F.col("d"))).collect()]
    plain = [r[0] for r in df.select(C.month_label(F.col("d"))).collect()]
    assert padded == ["May       2026", "September 2026"]
    assert plain == ["May 2026", "September 2026"]


# K19 bucket totals, fill rate ----------------------------------------------------------

def test_bucket_total_null_drops_row(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, None, 3)], "a int, b int, c int")
    got = df.agg(F.sum(C.bucket_total(["a", "b", "c"])), F.sum("a")).collect()[0]
    assert tuple(got) == (6, 2)


def test_fill_rate(spark):
    d = day("2000-03-05")
    t = make_tables(spark, dispatch=[("m1", "1", "c", D(0), D(0), d), ("m2", "2", "c", D(10), D(12), d)])
    got = {r["material_name"]: r["delivery_pct"] for r in supply.dispatch_vs_order(t, "2000-03-01", "2000-03-31").collect()}
    assert got == {"m1": None, "m2": 120.0}


# K20 common filter, purchase frequency ----------------------------------------------------

def _header(flag, channel, customer, doc, d="2000-03-05", reason="Sales", bl="P07"):
    return (flag, channel, bl, "Line", reason, customer, 8001, "b", "D001", "n", doc, day(d),
            "1", "item", "brand", "cat", "A", D(10))


def test_common_filter_exclusion(spark):
    t = make_tables(spark, sales_header=[
        _header("Primary Sales", "Distributor - A", 1, 1),
        _header("Primary Sales", None, 2, 2),
        _header("Secondary Sales", "Distributor - A", 3, 3),
        _header("Secondary Sales", "X", 4, 4, reason="Return"),
        _header("Secondary Sales", "X", 5, 5, bl="P99"),
    ])
    got = rows(flt.common_sales_filter(t.sales_header, "2000-03-01", "2000-03-31"), "customer_code")
    assert got == [("3",)]


def test_purchase_frequency_buckets(spark):
    data = []
    for cust, n in [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]:
        data += [_header("Secondary Sales", "X", cust, cust * 100 + i) for i in range(n)]
    data.append(_header("Secondary Sales", "X", 1, 999, d="2000-02-10"))   # second month
    data.append(_header("Secondary Sales", "X", 2, 200))                   # same document again
    t = make_tables(spark, sales_header=data)
    got = rows(documented.purchase_frequency(t, "2000-01-01", "2000-03-31"))
    assert got == [("Secondary Sales", 2, 1, 1, 2)]
    four = rows(documented.outlets_with_n_purchases(t, "2000-01-01", "2000-03-31", 4))
    assert four == [("Secondary Sales", 2)]


# Dimension duplicates, sort, paging, catalog ----------------------------------------------

def test_dimension_duplicates_fan_out_and_are_reported(spark):
    d = day("2000-03-05")
    t = make_tables(spark, dispatch=[("m1", "1", "c", D(10), D(10), d)],
                    items_class=[("1", "A"), ("1", "B")])
    assert rows(duplicate_keys(t.items_class, "mapping_code")) == [("1", 2)]
    got = supply.dispatch_vs_order(t, "2000-03-01", "2000-03-31").collect()[0]
    assert got["total_order_qty"] == 20.0


def test_inventory_days_null_label_sorts_last(spark):
    op = "2000-03-01"
    t = make_tables(
        spark,
        items=[("0000000001", "zeta", "1", "A"), ("0000000002", None, "2", "A")],
        items_class=[("1", "A"), ("2", "A")],
        locations=[(8006, "X SELL")],
        stock=[("0000000001", "8006", "P07", D(1), D(1), D(1), day(op), day("2000-03-31")),
               ("0000000002", "8006", "P07", D(1), D(1), D(1), day(op), day("2000-03-31"))],
    )
    got = [r["item_desc"] for r in stock.inventory_days(t, "2000-03-01", "2000-03-31").collect()]
    assert got == ["zeta", "Unknown"]


def test_table_page_and_list_tables(spark):
    t = make_tables(spark, branches=[(8000 + i, f"b{i}") for i in range(10)])
    page = lists.table_page(t.branches, ["branch_id"], limit=3, offset=2).collect()
    assert [r[0] for r in page] == ["8002", "8003", "8004"]
    after = lists.table_page(t.branches, ["branch_id"], limit=3, after=["8004"])
    assert [r[0] for r in after.collect()] == ["8005", "8006", "8007"]
    with pytest.raises(ValueError):
        lists.table_page(t.branches, [])
    t.register(prefix="ut_")
    names = {r["tableName"] for r in lists.list_tables(spark).collect()}
    assert {"ut_sales", "ut_branches"} <= names


def test_month_bounds_and_lookback(spark):
    assert flt.month_bounds("2000-03-31") == (day("2000-03-01"), day("2000-04-01"))
    assert flt.month_bounds("2000-01-15", back=2) == (day("1999-11-01"), day("2000-02-01"))
    df = spark.createDataFrame([(day(s),) for s in ["1999-12-31", "2000-01-01", "2000-03-15",
                                                   "2000-03-20", "2000-03-31"]], "d date")
    assert flt.lookback(df, "d", "2000-03-15", 3).count() == 2
    assert flt.lookback(df, "d", "2000-03-15", 3, through="month").count() == 4


# S1 binding external relations ---------------------------------------------------------

def test_conform_casts_renames_and_prunes(spark):
    from distkpi.sources.external import conform, read_catalog
    from distkpi.sources.schemas import SCHEMAS
    src = spark.createDataFrame(
        [(1013, "A", "8001", "2000-03-05", 2.0, 10.5, "extra")],
        "material bigint, classification string, branch_id string, billing_date string, "
        "sold_qty double, amount double, note string")
    df = conform("sales", src, {"material": "item_code"})
    assert df.schema == SCHEMAS["sales"]
    assert tuple(df.collect()[0]) == ("1013", "A", "8001", day("2000-03-05"), D("2.00"), D("10.5000"))
    with pytest.raises(ValueError):
        conform("sales", src)
    make_tables(spark).register(prefix="cat_")
    t = read_catalog(spark, {n: f"cat_{n}" for n in SCHEMAS})
    assert t.sales.schema == SCHEMAS["sales"]


def test_check_dimensions_reports_duplicates(spark):
    from distkpi.operators.lookup import check_dimensions
    t = make_tables(spark, items_class=[("1", "A"), ("1", "B"), ("2", "A")],
                    locations=[(8001, "x"), (8001, "y")])
    assert rows(check_dimensions(t)) == [("items_class", "1", 2), ("locations", "8001", 2)]


def test_service_measure_threshold_edges(spark):
    # Branch 8006, class A (threshold 30): cover exactly 30 -> not above; NULL cover
    # (no stock and zero target) -> not above; cover >= 9999 -> not above; 31 -> above.
    op, cl = day("2000-03-01"), day("2000-03-31")
    items = [(str(i), f"d{i}", str(i), "A") for i in range(1, 5)]
    t = make_tables(
        spark,
        items=items, items_class=[(str(i), "A") for i in range(1, 5)],
        locations=[(8006, "North SELL")],
        stock=[("1", "8006", "P07", D(30), D(1), D(1), op, cl),
               ("3", "8006", "P07", D(310000), D(1), D(1), op, cl),
               ("4", "8006", "P07", D(31), D(1), D(1), op, cl)],
        targets=[("1", 8006, "A", op, D(31)), ("2", 8006, "A", op, D(0)),
                 ("3", 8006, "A", op, D(31)), ("4", 8006, "A", op, D(31))],
    )
    got = [tuple(r) for r in stock.service_measure(t, "2000-03-01", "2000-03-31").collect()]
    assert got == [("North", 25.0, None, None)]


def test_registry_runs_reports_with_their_parameters(spark):
    from distkpi.plans.registry import REPORTS, parameters, run
    t = make_tables(spark)
    assert "start" not in parameters("forecast_accuracy_category_monthly")
    df = run("forecast_accuracy_category_monthly", t, start="2000-01-01", end="2000-03-31")
    assert df.count() == 0
    with pytest.raises(TypeError):
        run("branch_list", t, strict=True, start="2000-01-01")
    assert len(REPORTS) == 33


def test_page_by_table_name(spark):
    from distkpi.plans.lists import page
    t = make_tables(spark, branches=[(8000 + i, f"b{i % 3}") for i in range(7)])
    first = page(t, "branches", limit=4).collect()
    rest = page(t, "branches", limit=4, offset=4).collect()
    assert len(first) == 4 and len(rest) == 3
    assert {r[0] for r in first} | {r[0] for r in rest} == {str(i) for i in range(8000, 8007)}
    with pytest.raises(KeyError):
        page(t, "nope")


def test_count_share_pct_is_exact_half_up(spark):
    df = spark.createDataFrame([(1, 160), (1, 3), (2, 3), (1, 8), (0, 5), (3, 0), (5, 5)],
                               "a long, b long")
    got = [r[0] for r in df.select(C.count_share_pct(F.col("a"), F.col("b"))).collect()]
    assert got == [0.63, 33.33, 66.67, 12.5, 0.0, None, 100.0]



def test_distinct_counts_exact_and_approximate(spark):
    data = [_header("Secondary Sales", "X", c % 7, c) for c in range(40)]
    t = make_tables(spark, sales_header=data)
    exact = rows(documented.customer_universe(t, "2000-03-01", "2000-03-31"))
    approx = rows(documented.customer_universe(t, "2000-03-01", "2000-03-31", approx=True))
    assert exact == [("Secondary Sales", 7)] and approx == exact
    assert rows(documented.gross_summary(t, "2000-03-01", "2000-03-31", approx=True)) == \
        [("Secondary Sales", 400.0, 7)]


def test_read_files_and_catalog_binding(spark, tmp_path):
    from distkpi.sources.external import read_files
    from distkpi.sources.schemas import SCHEMAS
    from distkpi.sources.tables import Tables
    t = make_tables(spark, branches=[(8001, "one"), (8002, "two")])
    paths = {}
    for name, df in t.as_dict().items():
        paths[name] = str(tmp_path / name)
        df.write.parquet(paths[name])
    back = read_files(spark, paths)
    assert rows(back.branches) == [("8001", "one"), ("8002", "two")]
    assert all(getattr(back, n).schema == SCHEMAS[n] for n in SCHEMAS)
    back.register(prefix="files_")
    cat = Tables.from_catalog(spark, prefix="files_")
    assert rows(lists.branch_list(cat)) == [("8001", "one"), ("8002", "two")]


def test_snapshot_day_range_on_timestamps(spark):
    def w(ts):
        return (8001, "SL", 1, "P", "T", "N", 1, D(1), D(0), D(1), D(1), "1", ts)
    df = frame(spark, "wip", [w(dt.datetime(2000, 2, 29, 23, 0)), w(dt.datetime(2000, 3, 31, 23, 59, 59)),
                              w(dt.datetime(2000, 4, 1, 0, 0, 0))])
    snap = latest_snapshot(df, "record_created_date", "2000-03-01", "2000-03-31", by_day=True)
    assert [r[0] for r in snap.select("record_created_date").collect()] == \
        [dt.datetime(2000, 3, 31, 23, 59, 59)]
    early = latest_snapshot(df, "record_created_date", "2000-02-01", "2000-02-29", by_day=True)
    assert [r[0] for r in early.select("record_created_date").collect()] == \
        [dt.datetime(2000, 2, 29, 23, 0)]


def test_cover_days_has_no_negative_zero(spark):
    import math
    df = spark.createDataFrame([(D("-1"), D("1000"))], "inv decimal(18,4), trg decimal(18,4)")
    v = df.select(C.cover_days(F.col("inv"), F.col("trg"), 31)).collect()[0][0]
    assert v == 0.0 and math.copysign(1.0, v) == 1.0
