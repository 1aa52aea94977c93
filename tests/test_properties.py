"""Cross-report properties on the sf0.01 tables and plan-shape checks."""

import contextlib
import io
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from distkpi.plans import documented, sales, stock
from distkpi.session import scratch_path
from distkpi.sources.marts import read_marts, write_load, write_marts
from distkpi.sources.testdata import load_tables

SF = "/root/testdata/sf0.01"
S, E = entry.S, entry.E


@pytest.fixture(scope="module")
def t(spark):
    return load_tables(spark, SF)


def _window(t, lo, hi):
    """Date-keyed tables restricted to [lo, hi) (dimensions untouched)."""
    from distkpi.sources.marts import CLUSTERED, PARTITIONED

    def cut(df, c):
        typ = df.schema[c].dataType
        return df.where((F.col(c) >= F.lit(lo).cast(typ)) & (F.col(c) < F.lit(hi).cast(typ)))
    return t.__class__(**{**t.as_dict(), **{
        n: cut(getattr(t, n), c) for n, c in {**CLUSTERED, **PARTITIONED}.items()}})


@pytest.fixture(scope="module")
def marts(spark, t):
    # The months the March report window and its three-month look-back touch
    # (prices from December), so the mart tests stay quick.
    path = scratch_path(spark, f"marts-{uuid.uuid4().hex[:8]}")
    write_marts(_window(t, "1999-12-01", "2000-04-01"), path, fact_layout="cluster")
    return read_marts(spark, path)


def test_total_cover_equals_sum_of_classes(t):
    per = stock.cover_days(t, S, E).collect()
    tot = stock.cover_days_total(t, S, E).collect()[0]
    # no class lost: every stock class has a target row here. The NULL class and the literal
    # 'Others' are two stock rows that meet the same target row.
    assert sum({r["classification"]: r["trg_value"] for r in per}.values()) == tot["trg_value"]
    assert sum(r["inv_val"] or 0 for r in per) == tot["inv_val"]


def test_total_row_is_sum_of_rows(t):
    rows = sales.distributor_vs_company_target(t, E).collect()
    body = [r for r in rows if r["classification"] != "Total"]
    total = [r for r in rows if r["classification"] == "Total"][0]
    assert sum(r["distributor_target"] for r in body) == pytest.approx(total["distributor_target"])
    assert sum(r["company_target"] for r in body) == pytest.approx(total["company_target"])


def test_purchase_buckets_cover_all_outlet_months(t):
    freq = {r["data_flag"]: r for r in documented.purchase_frequency(t, entry.DS, entry.DE).collect()}
    pairs = documented.purchases_per_outlet_month(t, entry.DS, entry.DE).groupBy("data_flag").count()
    for r in pairs.collect():
        f = freq[r["data_flag"]]
        assert f["outlets_4_plus"] + f["outlets_3"] + f["outlets_2"] + f["outlets_1"] == r["count"]


def test_threshold_counts_bounded_by_base(t):
    base = dict(t.items_class.where(F.col("classification").isin("A", "B", "C"))
                .groupBy("classification").count().collect())
    for r in stock.above_below_threshold(t, S, E).collect():
        assert r["skus_above"] + r["skus_below"] <= base[r["classification"]]


def test_summary_independent_of_partitioning(spark, t):
    a = sorted(tuple(r) for r in sales.sales_summary(t, S, E).collect())
    shuffled = t.__class__(**{**t.as_dict(), "sales": t.sales.repartition(13).sortWithinPartitions(F.rand(7))})
    b = sorted(tuple(r) for r in sales.sales_summary(shuffled, S, E).collect())
    assert a == b


def test_day_partitioned_marts_give_the_same_results(spark, t):
    path = scratch_path(spark, f"marts-day-{uuid.uuid4().hex[:8]}")
    # Layout test on the quarter around the report month (keeps the number of
    # folders small; the March report is unchanged).
    small = _window(t, "2000-01-01", "2000-04-01")
    write_marts(small, path, fact_layout="day")
    day = read_marts(spark, path)
    a = sorted(map(repr, sales.sales_summary(t, S, E).collect()))
    b = sorted(map(repr, sales.sales_summary(day, S, E).collect()))
    assert a == b
    text = _formatted(sales.sales_summary(day, S, E))
    assert "PartitionFilters: [isnotnull(billing_date" in text


def test_marts_give_the_same_results(spark, t, marts):
    for name in ["cover_days", "inventory_days", "service_measure", "forecast_accuracy_category_yearly",
                 "stock_valuation", "wip"]:
        a = sorted(map(repr, entry.CASES[name](t).collect()))
        b = sorted(map(repr, entry.CASES[name](marts).collect()))
        assert a == b, name


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cartesian_in_any_plan(marts):
    for name, fn in entry.CASES.items():
        plan = _plan(fn(marts))
        assert "EvalPython" not in plan and "PythonUDF" not in plan, name
        assert "CartesianProduct" not in plan, name
        if not name.startswith("cover_days_total"):   # 1 x 1 cross join of global aggregates
            assert "BroadcastNestedLoopJoin" not in plan, name


def _formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_snapshot_prunes_partitions_and_pushes_filters(marts):
    text = _formatted(stock.cover_days(marts, S, E))
    assert "PartitionFilters: [isnotnull(stock_closing_date" in text
    assert "stock_closing_date#" in text and "= Subquery subquery" in text
    assert "PushedFilters: [IsNotNull(target_date), GreaterThanOrEqual(target_date,2000-03-01)" in text


def test_scan_reads_only_needed_columns(marts):
    text = _formatted(sales.sales_summary(marts, S, E))
    assert "ReadSchema: struct<item_code:string,classification:string,branch_id:string," \
           "billing_date:date,amount:decimal(18,4)>" in text


def test_figures_of_the_survey_probe(t):
    """Numbers recorded by an earlier, independent probe at sf0.01 (FIXTURES.md section 3),
    those that the rule-deciding rows added to the derivations do not touch."""
    from distkpi.plans import supply
    r12 = {r["classification"]: r for r in sales.distributor_vs_company_target(t, E).collect()}
    assert float(r12["A"]["distributor_vs_company_pct"]) == 46.56 and len(r12) == 5
    assert stock.service_measure(t, S, E).count() == 14
    assert supply.dispatch_vs_order(t, S, E).count() == 287
    assert documented.top_sku_class_a(t, entry.DS, entry.DE).count() == 241
    assert supply.stock_valuation(t, S, E).count() == 747


def test_rules_decide_rows(t):
    """The fixture holds rows that each rule turns away or keeps (survey P8, P10, P14, A14, J11, D5, K8)."""
    from distkpi.operators.lookup import duplicate_keys
    from distkpi.operators.measures import classified_stock
    kept = classified_stock(t, S, E)
    subs = {r[0] for r in kept.select("subinventory_code").distinct().collect()}
    assert {"8206", "8210"} <= subs and not any(s.startswith("99") for s in subs)
    snap = t.stock.where(F.col("stock_closing_date") == E)
    assert snap.where(F.col("subinventory_code").like("99%")).count() > 0
    assert classified_stock(t, S, E, nonzero=False).count() > kept.count()
    assert t.sales.where("amount = 0").count() > 0
    assert t.items_class.where("classification = 'Others'").count() > 0
    assert duplicate_keys(t.items_class, "mapping_code").count() > 0
    assert t.price_list.groupBy("item_code", "first_date").count().where("count > 1").count() > 0
    assert documented.outlets_with_n_purchases(t, "1995-01-01", "2001-12-31", 4).count() > 0
    matched = t.targets.join(t.items, t.targets.item_code == t.items.matnr, "left_semi").count()
    assert 0 < matched < t.targets.count()


@pytest.mark.parametrize("report", ["cover_days", "cover_days_total", "inventory_days", "service_measure",
                                    "above_below_threshold", "target_vs_actual_cover", "stock_value_by_class"])
def test_every_stock_snapshot_prunes_partitions(marts, report):
    scans = [x for x in _formatted(entry.CASES[report](marts)).split("\n\n")
             if "/stock/load=" in x and x.lstrip().startswith("(")]
    assert scans
    for scan in scans:
        assert "PartitionFilters: [isnotnull(stock_closing_date" in scan and "Subquery" in scan, scan


def test_small_tables_answer_lists_and_dates(marts):
    for report in ("closing_inventory_date", "business_lines", "products", "locations", "regional_distributors"):
        text = _formatted(entry.CASES[report](marts))
        assert "/sales_header/" not in text and "/stock/" not in text, report


def test_a_load_leaves_other_days_alone(spark, t):
    import glob
    from pyarrow.fs import FileSystem
    path = scratch_path(spark, f"marts-load-{uuid.uuid4().hex[:8]}")
    first, second = _window(t, "2000-02-01", "2000-03-01"), _window(t, "2000-03-01", "2000-04-01")
    write_marts(first, path)
    root = FileSystem.from_uri(path)[1] if "://" in path or path.startswith("file:") else path

    def files(name):
        return {f for f in glob.glob(f"{root}/{name}/*/*/*.parquet")}
    before = {n: files(n) for n in ("sales", "stock", "wip", "targets")}
    write_load(second, path)
    for n, old in before.items():
        assert old < files(n), n
    whole, merged = _window(t, "2000-02-01", "2000-04-01"), read_marts(spark, path)
    for name in ("sales_summary", "inventory_days", "service_measure", "products", "closing_inventory_date"):
        assert sorted(map(repr, entry.CASES[name](merged).collect())) == \
            sorted(map(repr, entry.CASES[name](whole).collect())), name


@pytest.mark.parametrize("report, index", [("inventory_days", "stock_loads"), ("above_below_threshold", "stock_loads"),
                                           ("service_measure", "stock_loads"), ("wip", "wip_loads"),
                                           ("stock_valuation", "valuation_loads")])
def test_newest_load_is_looked_up_once(marts, report, index):
    df = entry.CASES[report](marts)
    df.collect()
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # The initial and the final plan are both shown: a scan is known by its columns.
    scans = {x.split("Output")[1].split("\n")[0]: x for x in text.split("\n\n")
             if "Location:" in x and x.lstrip().startswith("(")}
    assert len([x for x in scans.values() if f"/{index}/load=" in x]) == 1
    fact = index.split("_")[0]
    facts = [x for x in scans.values() if f"/{fact}/load=" in x]
    assert len(facts) == 1 and "Subquery" in facts[0]      # read for its rows only, not for its dates


def test_every_report_runs_on_an_empty_window(spark):
    """No data in the window and every filter set: no errors, and the
    one-row reports keep their single row."""
    from distkpi.plans.registry import REPORTS, run
    small = load_tables(spark, "/root/testdata/sf0.001")
    counts = {}
    for name in REPORTS:
        counts[name] = run(name, small, start="2030-01-01", end="2030-01-31", business_line="P07",
                           n=2, name="branches", classification=["A"], sku=["1"],
                           branch=["8001"]).count()
    for one_row in ["cover_days_total", "forecast_accuracy_monthly", "target_to_date",
                    "forecast_accuracy_yearly", "distributor_vs_company_target"]:
        assert counts[one_row] == 1, one_row
    assert counts["cover_days"] == 0 and counts["sales_summary"] == 0


def test_no_window_operator_in_any_plan(marts):
    # The ordered picks are aggregates (min_by), so no plan sorts a whole item or month.
    for name, fn in entry.CASES.items():
        assert "Window" not in _plan(fn(marts)), name


def test_stock_scan_reads_only_its_columns(marts):
    text = _formatted(stock.cover_days(marts, S, E))
    assert ("ReadSchema: struct<item_code:string,subinventory_code:string,busline_code:string,"
            "qty:decimal(18,2),trade_price:decimal(12,2),item_cost:decimal(12,2)>") in text


def test_scale_profile_keys_are_valid_settings(spark):
    from distkpi.session import SCALE_CONF
    for key, value in SCALE_CONF.items():
        old = spark.conf.get(key, None)
        spark.conf.set(key, value)
        assert spark.conf.get(key) == value
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
