"""Exact rounding, direct keys, lossless load, determined picks, fixed values."""

import itertools

import pytest
from pyspark.sql import functions as F

from distkpi import constants
from distkpi.functions import columns as C
from distkpi.operators.lookup import price_asof, price_fixed
from distkpi.operators.measures import targets_by_mapping
from distkpi.plans import documented, stock
from distkpi.sources.external import conform
from tests.fixtures import D, day, frame, make_tables

S, E = "2000-03-01", "2000-03-31"


@pytest.mark.parametrize("num, den, times, digits, want", [
    ("23", "160", 100, 2, "14.38"), ("-23", "160", 100, 2, "-14.38"), ("23", "-160", 100, 2, "-14.38"),
    ("0.1601", "2", 100, 2, "8.01"), ("6.05", "11", 31, 1, "17.1"), ("-6.05", "11", 31, 1, "-17.1"),
    ("2.6", "4", 1, 1, "0.7"), ("0", "-3", 100, 2, "0.00"), ("1", "0", 100, 2, None), (None, "2", 100, 2, None),
    ("999999999999999.9999", "3", 1, 1, "333333333333333.3"), ("-0.0001", "7", 100, 2, "0.00")])
def test_round_ratio(spark, num, den, times, digits, want):
    df = spark.createDataFrame([(D(num), D(den))], "n decimal(38,4), d decimal(18,4)")
    assert df.select(C.round_ratio(F.col("n"), F.col("d"), digits, times)).first()[0] == D(want)


def test_rounded_measures(spark):
    df = spark.createDataFrame([(D("6.05"), D("11"))], "i decimal(18,4), t decimal(18,4)")
    got = df.select(C.cover_days(F.col("i"), F.col("t"), 31), C.daily_target(F.col("t"), 8),
                    C.attainment(F.lit(23), F.lit(160))).first()
    assert tuple(got) == (D("17.1"), D("1.4"), D("14.38"))


def test_average_of_cover_days_is_exact(spark):
    op, cl = day(S), day(E)
    parts = [("8001", "0.1"), ("8002", "0.1"), ("8003", "0.1"), ("8004", "2.3")]
    t = make_tables(spark, items=[("1", "one", "1", "A")], items_class=[("1", "A")],
                    locations=[(b, b) for b, _ in parts],
                    stock=[("1", b, "P07", D(v), D(1), D(1), op, cl) for b, v in parts],
                    targets=[("1", b, "A", op, D(31)) for b, _ in parts])
    assert [r["total"] for r in stock.inventory_days(t, S, E).collect()] == [D("0.7")]


def test_targets_join_the_master_on_the_whole_code(spark):
    a, b = "101300007199", "101300007188"        # equal in their first ten characters
    t = make_tables(spark, items=[(a, "a", "", "A"), ("1013000071", "other", "", "A")],
                    targets=[(a, "8001", "A", day(S), D(1)), (b, "8001", "A", day(S), D(2))])
    got = {r["item_code"]: r["itm_mapping_code"] for r in targets_by_mapping(t, E).collect()}
    assert got == {a: a, b: None}


def test_price_on_one_date_is_determined(spark):
    data = [("i", day("2000-03-05"), p) for p in (D(5), D(7), None)]
    for order in itertools.permutations(data):
        p = frame(spark, "price_list", list(order)).coalesce(1)
        assert [r["price"] for r in price_fixed(p, E).collect()] == [D(7)]
        assert {r["month"]: r["price"] for r in price_asof(p).collect()} == {day("2000-03-01"): D(7), day("2000-04-01"): D(7)}


def test_load_keeps_every_digit_or_fails(spark):
    def load(price, kind):
        src = spark.createDataFrame([("1", day(S), price)], f"item_code string, first_date date, price {kind}")
        return conform("price_list", src).collect()[0]["price"]
    assert load(D("10.50"), "decimal(18,3)") == D("10.5") and load(10.5, "double") == D("10.5")
    assert load(None, "double") is None
    for value, kind in ((D("10.505"), "decimal(18,3)"), (10.505, "double"), ("abc", "string")):
        with pytest.raises(Exception, match="does not fit"):
            load(value, kind)


@pytest.mark.parametrize("value, kind, want", [
    ("10.5000000000001", "decimal(38,13)", None), ("10.5000000000000", "decimal(38,13)", "10.50"),
    (10.5000000000001, "double", None), ("10.5000000000000000000000001", "string", None), (" 1.05e1 ", "string", "10.50"),
    ("1e-30", "string", None), ("10.500000000000000000000000000000", "string", "10.50"), (7, "bigint", "7.00"), (1.5, "float", "1.50")])
def test_no_decimal_is_too_far_to_be_seen(spark, value, kind, want):
    value = D(value) if kind.startswith("decimal") else value
    src = spark.createDataFrame([("1", day(S), value)], f"item_code string, first_date date, price {kind}")
    if want is None:
        with pytest.raises(Exception, match="does not fit"):
            conform("price_list", src).collect()
    else:
        assert conform("price_list", src).collect()[0]["price"] == D(want)


@pytest.mark.parametrize("text, kind, fits", [
    ("2000-03-05 00:00:00", "timestamp", True), ("2000-03-05 10:30:00", "timestamp", False),
    ("2000-03-05 00:00:00", "timestamp_ntz", True), ("2000-03-05 00:00:01", "timestamp_ntz", False),
    ("2000-03-05", "string", True), ("2000-03-05 00:00:00", "string", True), ("2000-03-05 10:30:00", "string", False),
    ("no date", "string", False)])
def test_a_time_of_day_is_no_date(spark, text, kind, fits):
    src = spark.createDataFrame([("1", text, D(1))], "item_code string, t string, price decimal(12,2)").select(
        "item_code", F.col("t").cast(kind).alias("first_date"), "price")
    if fits:
        assert conform("price_list", src).collect()[0]["first_date"] == day("2000-03-05")
    else:
        with pytest.raises(Exception, match="does not fit"):
            conform("price_list", src).collect()


def test_text_branch_keys(spark):
    src = spark.createDataFrame([("B001", "North")], "branch_id string, branch_desc string")
    assert [tuple(r) for r in conform("branches", src).collect()] == [("B001", "North")]


def test_malformed_item_code_is_an_error_in_any_mode(spark):
    df = spark.createDataFrame([("x1",)], "c string")
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="malformed item code"):
            df.select(C.normalize_item_code(F.col("c"))).collect()
        assert df.select(C.normalize_item_code(F.col("c"), strict=False)).first()[0] is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_purchase_counts_above_four_are_rejected(spark):
    with pytest.raises(ValueError):
        documented.outlets_with_n_purchases(make_tables(spark), S, E, 5)


def test_fixed_values():
    assert constants.THRESHOLD_DAYS == {"A": 30, "B": 20, "C": 15}
    assert constants.COVER_CEILING == 9999
    assert tuple(constants.BUSINESS_LINES) == ("P07", "P08", "P12")
    assert constants.SUBINVENTORY_PREFIX == "80" and set(constants.SUBINVENTORY_EXTRA) == {"8206", "8210"}
    assert constants.OTHERS == "Others" and constants.TOTAL == "Total" and constants.UNKNOWN == "Unknown"
    assert len(constants.BRANCH_COLUMNS) == 14
