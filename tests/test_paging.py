"""Pages by number from fence keys: the same rows as an offset, whatever the ties and NULLs."""

import random
import re

import pytest

from distkpi.plans import lists


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 5, 8]), rng.choice([None, "a", "b", "é", ""]), i) for i in range(700)]
    rows += [(2, "a", 1000 + i) for i in range(400)]                     # a key with a third of the rows
    return spark.createDataFrame(rows, "k int, name string, id int").repartition(5)


def ordered(rows, by):
    return sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in by])


def position_of(rows, by, fence):
    return sum([(r[c] is None, r[c] or 0) for c in by] < [(fence[c] is None, fence[c] or 0) for c in by] for r in rows)


@pytest.mark.parametrize("every", [1, 7, 100_000])
def test_pages_at_any_offset(table, every):
    by = ["k", "name", "id"]
    fences = lists.page_fences(table, by, every)
    want = ordered(table.collect(), by)
    for offset in (0, 1, 6, 7, 350, 777, 1090, 1099, 1100, 5000):
        got = lists.table_page_at(table, fences, by, limit=13, offset=offset).collect()
        assert got == want[offset:offset + 13]


def test_fences_stand_before_all_rows_of_a_key(table):
    rows = table.collect()
    fences = lists.page_fences(table, ["k"], 2).collect()
    assert len(fences) >= 3
    for f in fences:
        assert f["position"] == position_of(rows, ["k"], f)
    want = [r["k"] for r in ordered(rows, ["k"])]
    made = table.sparkSession.createDataFrame(fences)
    for offset in (0, 100, 333, 600, 1095):
        assert [r["k"] for r in lists.table_page_at(table, made, ["k"], 20, offset).collect()] == want[offset:offset + 20]


def test_little_is_skipped_and_the_filter_reaches_the_scan(spark, tmp_path, table):
    table.where("id < 1000").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    fences = lists.page_fences(stored, ["id"], 50)
    page = lists.table_page_at(stored, fences, ["id"], limit=10, offset=640)
    assert [r["id"] for r in page.collect()] == list(range(640, 650))
    plan = page._jdf.queryExecution().toString()
    skipped = int(re.search(r"Offset (\d+)", plan).group(1))
    assert skipped < 50 and "GreaterThan(id" in plan


def test_empty_table(table):
    fences = lists.page_fences(table.limit(0), ["id"])
    assert fences.count() == 0 and lists.table_page_at(table.limit(0), fences, ["id"]).count() == 0
