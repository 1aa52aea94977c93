"""Dimension joins on hot and missing keys: same rows as the plain join, no task with a large share."""

import random

import pytest
from pyspark.sql import functions as F

from distkpi.operators import lookup
from distkpi.operators.measures import opening_stock_by_mapping
from distkpi.plans import stock
from tests.fixtures import D, day, make_tables

CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}


@pytest.fixture
def shuffled(spark):
    """No broadcast of dimensions, and as many shuffle partitions as said."""
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def facts(spark, rows=6000):
    """A third without a key, a third with one key, the rest spread; some keys unknown to the dimension."""
    rng = random.Random(1)
    keys = [None] * (rows // 3) + ["hot"] * (rows // 3) + [f"k{rng.randrange(500)}" for _ in range(rows - 2 * (rows // 3))]
    return spark.createDataFrame([(i, k, f"l{i % 50}") for i, k in enumerate(keys)], "id bigint, code string, place string")


def test_same_rows_and_no_full_task(shuffled):
    df = facts(shuffled)
    dim = shuffled.createDataFrame([("hot", "x"), ("hot", "y"), ("", "empty"), (None, "null")]
                                   + [(f"k{i}", f"v{i}") for i in range(400)], "d_code string, d_value string")
    plain = df.join(dim, F.col("code") == F.col("d_code"), "left")
    spread = lookup.spread_left_join(df, dim, F.col("code"), "d_code", ("id", "place"))
    assert spread.columns == plain.columns
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))

    def largest(x):
        per = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
        return max(per) / sum(per)
    assert largest(plain) > 0.25 and largest(spread) < 0.12


def test_empty_sides(shuffled):
    df, dim = facts(shuffled, 30), shuffled.createDataFrame([], "d_code string, d_value string")
    assert lookup.spread_left_join(df, dim, F.col("code"), "d_code", ("id",)).count() == 30
    assert lookup.spread_left_join(df.limit(0), dim, F.col("code"), "d_code", ("id",)).count() == 0


def test_choice_by_size(spark, shuffled):
    dim = spark.range(10).select(F.col("id").cast("string").alias("mapping_code"))
    assert not lookup._fits_broadcast(dim)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    assert lookup._fits_broadcast(dim)


def test_reports_with_missing_mappings(shuffled, monkeypatch):
    spark, rng = shuffled, random.Random(2)
    op, cl = day("2000-03-01"), day("2000-03-31")
    items = [(f"{i}", f"item {i}", f"{i % 7}" if i % 3 else "", "A") for i in range(30)]
    t = make_tables(
        spark, items=items, items_class=[(f"{i}", rng.choice("ABC")) for i in range(25)],
        locations=[(f"80{i:02d}", f"b{i}") for i in range(6)],
        stock=[(rng.choice(["1", "404", f"{rng.randrange(30)}"]), f"80{rng.randrange(6):02d}", "P07", D(rng.randrange(1, 9)),
                D("2.5"), D(1), op, cl) for _ in range(200)],
        targets=[(rng.choice(["1", "404", f"{rng.randrange(30)}"]), f"80{rng.randrange(6):02d}", "A", op, D(rng.randrange(1, 50)))
                 for _ in range(200)])
    rows = opening_stock_by_mapping(t, "2000-03-01", "2000-03-31")
    assert rows.where("itm_mapping_code IS NULL").count() > 20
    got = {r: sorted(map(repr, getattr(stock, r)(t, "2000-03-01", "2000-03-31").collect()))
           for r in ("inventory_days",)}
    monkeypatch.setattr(lookup, "_fits_broadcast", lambda dim: True)
    for r, want in got.items():
        assert want == sorted(map(repr, getattr(stock, r)(t, "2000-03-01", "2000-03-31").collect())) and want
