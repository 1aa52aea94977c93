"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"
# The reports and their operators; optional subpackages test their own queries.
QUERIES = {n: f for n, f in entry.queries().items() if n in entry.CASES}
ORACLE = {n: q for n, q in entry.oracle_sql().items() if n in entry.CASES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert res["columns_match"], res
    assert res["types_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["values_match"], res


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small_con():
    return duck(SMALL)


@pytest.mark.parametrize("name", ["cover_days", "inventory_days", "service_measure",
                                  "above_below_threshold", "forecast_accuracy_category_yearly",
                                  "distributor_vs_company_target", "purchase_frequency"])
def test_query_matches_oracle_on_sparse_data(spark, small_con, name):
    # sf0.001: 10 suppliers, one of the 14 whitelisted branches, sparse classes.
    res = compare(QUERIES[name](spark, SMALL), small_con, ORACLE[name])
    assert res["columns_match"] and res["types_match"], res
    assert res["spark_rows"] == res["oracle_rows"] and res["values_match"], res



@pytest.fixture
def no_broadcast(spark):
    """Every join as a shuffle join: the path large dimensions take on a cluster."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["cover_days", "inventory_days", "service_measure",
                                  "above_below_threshold", "forecast_accuracy_yearly",
                                  "forecast_accuracy_category_yearly", "dispatch_vs_order", "wip",
                                  "item_filter_list"])
def test_query_matches_oracle_without_broadcast(no_broadcast, con, name):
    df = QUERIES[name](no_broadcast, SF)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    res = compare(df, con, ORACLE[name])
    assert res["columns_match"] and res["types_match"], res
    assert res["spark_rows"] == res["oracle_rows"] and res["values_match"], res


@pytest.mark.parametrize("table", ["sales", "targets", "budget", "stock", "items", "items_class",
                                   "locations", "price_list", "wip", "valuation", "dispatch",
                                   "target_items", "product_map", "branches", "sales_header"])
def test_derivations_equal_in_both_engines(spark, small_con, table):
    from distkpi.sources.testdata import derivation_sql, load_tables
    df = getattr(load_tables(spark, SMALL), table)
    res = compare(df.select(*[c for c in df.columns]), small_con, derivation_sql(table))
    assert res["columns_match"] and res["spark_rows"] == res["oracle_rows"], res
    assert res["values_match"], res
