"""The optional filter on an integer column equals comparing the column's text form."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from distkpi.operators.filters import in_filter

NUMS = st.integers(-20, 20)
TEXTS = st.one_of(NUMS.map(str), st.sampled_from(["08", "+5", " 7", "7 ", "-0", "00", "1e1", "٣", ""]))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(column=st.lists(st.one_of(st.none(), NUMS), max_size=12), values=st.lists(TEXTS, max_size=5))
def test_integer_filter_is_text_comparison(spark, column, values):
    df = spark.createDataFrame([(v,) for v in column], "b int")
    got = sorted((r[0] for r in in_filter(df, "b", values).collect()), key=repr)
    if not values:
        want = column                                  # no values: no filter
    else:
        texts = {str(v) for v in values}
        want = [v for v in column if v is not None and str(v) in texts]
    assert got == sorted(want, key=repr)
    # the same rule written as a cast, for reference
    if values:
        cast = sorted((r[0] for r in df.where(F.col("b").cast("string").isin(
            [str(v) for v in values])).collect()), key=repr)
        assert got == cast
