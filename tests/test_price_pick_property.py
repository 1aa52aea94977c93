"""Price picks against a brute-force reading of the top-1 rule on random inputs."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from distkpi.operators.lookup import price_asof, price_fixed
from tests.fixtures import frame

ITEMS = ["a", "b", "F3"]
DAYS = [dt.date(2000, m, d) for m in (1, 2, 3) for d in (1, 15, 28)] + [dt.date(2000, 2, 29)]
PRICE = st.one_of(st.none(), st.just(Decimal("0.00")),
                  st.integers(1, 9).map(lambda v: Decimal(f"{v}.00")))
ROWS = st.lists(st.tuples(st.sampled_from(ITEMS), st.sampled_from(DAYS), PRICE),
                max_size=14, unique_by=lambda r: (r[0], r[1]))


def month(d: dt.date) -> dt.date:
    return d.replace(day=1)


def prev_month(m: dt.date) -> dt.date:
    return (m - dt.timedelta(days=1)).replace(day=1)


def brute_pick(rows, item, anchor):
    """The rule as written: candidates in the anchor month or the month before;
    order by (own & non-zero -> 0, previous -> 1, own -> 2), then newest date."""
    own, prev = month(anchor), prev_month(month(anchor))
    cands = [(d, p) for i, d, p in rows if i == item and month(d) in (own, prev)]
    if not cands:
        return "none"

    def rank(c):
        d, p = c
        if month(d) == own and (p or 0) != 0:
            return 0
        return 1 if month(d) == prev else 2
    return sorted(cands, key=lambda c: (rank(c), -c[0].toordinal()))[0][1]


SETTINGS = settings(max_examples=25, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=ROWS)
def test_price_fixed_equals_brute_force(spark, rows):
    got = dict(price_fixed(frame(spark, "price_list", rows), "2000-03-31").collect())
    for item in ITEMS:
        want = brute_pick(rows, item, dt.date(2000, 3, 31))
        assert got.get(item, "none") == want, (item, rows)


@SETTINGS
@given(rows=ROWS)
def test_price_asof_equals_brute_force(spark, rows):
    got = {(r[0], r[1]): r[2] for r in price_asof(frame(spark, "price_list", rows)).collect()}
    for item in ITEMS:
        for m in (dt.date(2000, 1, 1), dt.date(2000, 2, 1), dt.date(2000, 3, 1), dt.date(2000, 4, 1)):
            assert got.get((item, m), "none") == brute_pick(rows, item, m), (item, m, rows)
